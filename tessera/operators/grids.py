"""Stencils and resampling on gridded cells.

A grid is rows (keys, y, x, values).  ``width`` and ``height`` are an int or a Column; a missing cell
counts as 0.  Stencils run on square tiles that carry a halo of their neighbours' cells, so one shuffle
serves both axes and no task ever holds more than one tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

TILE = 256
Kernel = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def _size(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def sized(df: DataFrame, key: str, width: int | None, height: int | None, sizes: DataFrame | None, names: tuple[str, str]) -> DataFrame:
    """Adds the output size as two columns: the same for all keys, or from ``sizes`` (key, width, height)."""
    if sizes is None:
        if width is None or height is None:
            raise ValueError("give width and height, or sizes")
        return df.withColumns({names[0]: F.lit(int(width)), names[1]: F.lit(int(height))})
    return df.join(sizes.select(key, F.col("width").cast("int").alias(names[0]), F.col("height").cast("int").alias(names[1])), key)


def tiles_of(c: str, size: Column, halo: int, tile: int = TILE) -> Column:
    """The tiles along one axis, one row each, that need position ``c`` as their own or within ``halo`` of them."""
    first = F.greatest(F.lit(0), F.floor((F.col(c) - halo) / tile))
    last = F.least(F.floor((size - 1) / tile), F.floor((F.col(c) + halo) / tile))
    return F.explode(F.sequence(first, last))


def tile_stencil(cells: DataFrame, keys: list[str], width, height, halo: int, inputs: list[str],
                 kernel: Kernel, outputs: list[str], carry: list[str] | None = None,
                 tile: int = TILE, chained: bool = False) -> DataFrame:
    """Apply ``kernel`` to every tile.

    The kernel gets each input padded by ``halo`` on all sides (edge values repeated beyond the grid)
    and returns arrays of the tile's own size.  A ``chained`` kernel also gets how many rows and columns of the padding lie beyond the grid
    and returns arrays of the padded size.  ``carry`` columns pass through unchanged.
    """
    carry = carry or []
    values = list(dict.fromkeys([*inputs, *carry]))
    spread = (cells.select(*keys, "y", "x", *values, _size(width).cast("int").alias("_w"),
                           _size(height).cast("int").alias("_h"))
              .withColumn("_ty", tiles_of("y", F.col("_h"), halo, tile)).withColumn("_tx", tiles_of("x", F.col("_w"), halo, tile)))
    types = dict(cells.dtypes)
    names = [*keys, "y", "x", *carry, *outputs]
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["y int", "x int"]
                       + [f"`{c}` double" for c in [*carry, *outputs]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf._w.iloc[0]), int(pdf._h.iloc[0])
        y0, x0 = int(pdf._ty.iloc[0]) * tile, int(pdf._tx.iloc[0]) * tile
        y1, x1 = min(y0 + tile, h), min(x0 + tile, w)
        wy0, wx0, wy1, wx1 = max(0, y0 - halo), max(0, x0 - halo), min(h, y1 + halo), min(w, x1 + halo)
        at = (pdf.y.to_numpy() - wy0, pdf.x.to_numpy() - wx0)
        pad = ((halo - (y0 - wy0), halo - (wy1 - y1)), (halo - (x0 - wx0), halo - (wx1 - x1)))
        padded = {}
        for c in values:
            a = np.zeros((wy1 - wy0, wx1 - wx0))
            a[at] = pdf[c].to_numpy()
            padded[c] = np.pad(a, pad, mode="edge")
        core = (slice(halo, halo + y1 - y0), slice(halo, halo + x1 - x0))
        given = {c: padded[c] for c in inputs}
        done = {c: a[core] for c, a in kernel(given, pad).items()} if chained else kernel(given)
        yy, xx = np.mgrid[y0:y1, x0:x1]
        out = {k: pd.Series([pdf[k].iloc[0]]).repeat(yy.size).to_numpy() for k in keys}
        out.update({"y": yy.ravel().astype("int32"), "x": xx.ravel().astype("int32")})
        out.update({c: padded[c][core].ravel() for c in carry})
        out.update({c: np.asarray(done[c], dtype=float).ravel() for c in outputs})
        return pd.DataFrame(out)[names]

    return spread.groupBy(*keys, "_ty", "_tx").applyInPandas(run, schema)


def gaussian_taps(sigma: float) -> list[float]:
    radius = max(1, math.ceil(4 * sigma))
    raw = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    total = sum(raw)
    return [t / total for t in raw]


def _separable(a: np.ndarray, taps: list[float]) -> np.ndarray:
    n = len(taps)
    rows = sum(t * a[:, k:a.shape[1] - n + 1 + k] for k, t in enumerate(taps))
    return sum(t * rows[k:a.shape[0] - n + 1 + k, :] for k, t in enumerate(taps))


def gaussian_smooth(cells: DataFrame, keys: list[str], width, height, sigma: float,
                    values: list[str] | None = None, into: list[str] | None = None,
                    carry: list[str] | None = None) -> DataFrame:
    """Gaussian blur along both axes with edges repeated; sigma up to 0.01 changes nothing."""
    values = values or ["v"]
    into = into or values
    if sigma <= 0.01:
        return cells.select(*keys, "y", "x", *(carry or []), *[F.col(a).alias(b) for a, b in zip(values, into)])
    taps = gaussian_taps(sigma)

    def kernel(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {dst: _separable(a[src], taps) for src, dst in zip(values, into)}

    return tile_stencil(cells, keys, width, height, len(taps) // 2, values, kernel, into, carry)


ROW_BLOCK = 4096


def dense_grid(cells: DataFrame, keys: list[str], width: int | None = None, height: int | None = None, value: str = "v") -> DataFrame:
    """Every cell of every grid, 0 where there was none.

    Without a size the grids reach as far as any of their cells; cells beyond a given size are left out.  Rows are laid out in blocks, so
    neither a tall grid nor few grids end up in few tasks.
    """
    if width is None or height is None:
        far = cells.agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
        width = (far["x"] if far["x"] is not None else -1) + 1 if width is None else width
        height = (far["y"] if far["y"] is not None else -1) + 1 if height is None else height
    blocks = F.explode(F.sequence(F.lit(0), F.lit(max(0, height - 1) // ROW_BLOCK)))
    laid = cells.select(*keys).distinct().withColumn("_block", blocks).repartition(*keys, "_block")
    rows = F.explode(F.sequence(F.col("_block") * ROW_BLOCK, F.least(F.lit(height - 1), F.col("_block") * ROW_BLOCK + ROW_BLOCK - 1)))
    full = laid.withColumn("y", rows).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).drop("_block")
    return full.join(cells.select(*keys, "y", "x", value), [*keys, "y", "x"], "left").withColumn(
        value, F.coalesce(value, F.lit(0.0)))


def decimate2(cells: DataFrame, width, height) -> DataFrame:
    """Keep even rows and columns; the new size is half, rounded down, at least 1."""
    half_w = F.greatest(F.lit(1), F.floor(_size(width) / 2))
    half_h = F.greatest(F.lit(1), F.floor(_size(height) / 2))
    return (cells.filter((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0))
            .withColumn("x", (F.col("x") / 2).cast("int")).withColumn("y", (F.col("y") / 2).cast("int"))
            .filter((F.col("x") < half_w) & (F.col("y") < half_h)))


def _axis(c: str, size: Column, new: Column, corner: bool) -> tuple[Column, Column, Callable[[Column], Column]]:
    """Range of output positions an input position reaches, and the weight at each."""
    step = size / new
    shift = 0.0 if corner else 0.5
    x = F.col(c)
    lo = F.when(x == 0, 0).otherwise(F.ceil((x - 1 + shift) / step - shift))
    hi = F.when(x == size - 1, new - 1).otherwise(F.floor((x + 1 + shift) / step - shift))

    def weight(o: Column) -> Column:
        at = F.least(F.greatest((o + shift) * step - shift, F.lit(0.0)), (size - 1).cast("double"))
        return F.greatest(F.lit(0.0), 1 - F.abs(at - x))

    return F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, new - 1).cast("int"), weight


def _scatter(cells: DataFrame, keys: list[str], width, height, new_w, new_h, values: list[str],
             corner: bool) -> DataFrame:
    """Bilinear resampling by sending every cell to the output cells it contributes to.

    No join: contributions are summed, map side first.
    """
    w, h, nw, nh = (_size(v) for v in (width, height, new_w, new_h))
    xlo, xhi, xweight = _axis("x", w, nw, corner)
    ylo, yhi, yweight = _axis("y", h, nh, corner)
    reach = (cells.withColumns({"_xl": xlo, "_xh": xhi, "_yl": ylo, "_yh": yhi})
             .filter("_xl <= _xh and _yl <= _yh")
             .withColumn("_oy", F.explode(F.sequence("_yl", "_yh")))
             .withColumn("_ox", F.explode(F.sequence("_xl", "_xh"))))
    wt = xweight(F.col("_ox")) * yweight(F.col("_oy"))
    return (reach.withColumn("_wt", wt).filter("_wt > 0")
            .groupBy(*keys, F.col("_oy").alias("y"), F.col("_ox").alias("x"))
            .agg(*[F.sum(F.col(v) * F.col("_wt")).alias(v) for v in values]))


def upsample2(cells: DataFrame, keys: list[str], width, height, values: list[str] | None = None) -> DataFrame:
    """Twice the size, output (x, y) read at (x / 2, y / 2), edges held."""
    return _scatter(cells, keys, width, height, _size(width) * 2, _size(height) * 2, values or ["v"], True)


def resize(cells: DataFrame, keys: list[str], width, height, new_w, new_h,
           values: list[str] | None = None) -> DataFrame:
    """Centre-aligned bilinear resampling to any size, edges held."""
    return _scatter(cells, keys, width, height, new_w, new_h, values or ["v"], False)


def difference(a: DataFrame, b: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    return (a.select(*keys, "y", "x", F.col(value).alias("_l"))
            .join(b.select(*keys, "y", "x", F.col(value).alias("_r")), [*keys, "y", "x"])
            .select(*keys, "y", "x", (F.col("_l") - F.col("_r")).alias(value)))


def _squares(cells: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every 2 x 2 square that has a cell: keys, _y0, _x0 (its upper left), _n0.._n3 (which corners are there), values _0v.._3v."""
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(k // 2).alias("dy"), F.lit(k % 2).alias("dx")) for k in range(4)]))
    sent = cells.select(*keys, "y", "x", *values, corner.alias("_c"))
    here = [F.max(F.when(F.col("_c.k") == k, F.lit(1))).alias(f"_n{k}") for k in range(4)]
    held = [F.max(F.when(F.col("_c.k") == k, F.col(v))).alias(f"_{k}{v}") for v in values for k in range(4)]
    return sent.groupBy(*keys, (F.col("y") - F.col("_c.dy")).cast("int").alias("_y0"), (F.col("x") - F.col("_c.dx")).cast("int").alias("_x0")).agg(*here, *held)


def bilinear_sample(points: DataFrame, cells: DataFrame, keys: list[str], point_key: list[str],
                    width, height, values: list[str] | None = None) -> DataFrame:
    """Values at fractional positions px, py (clamped to the grid): keys, point_key, values.

    A position next to a hole, where a cell that it needs is missing, has no value and no row.  Cells are gathered into their squares, so a
    position is joined once and nothing is summed afterwards.
    """
    values = values or ["v"]
    w, h = _size(width), _size(height)
    cx = F.least(F.greatest(F.col("px"), F.lit(0.0)), (w - 1).cast("double"))
    cy = F.least(F.greatest(F.col("py"), F.lit(0.0)), (h - 1).cast("double"))
    placed = points.withColumns({"_cx": cx, "_cy": cy}).withColumns({"_x0": F.floor("_cx").cast("int"), "_y0": F.floor("_cy").cast("int")})
    placed = placed.select(*keys, *point_key, "_x0", "_y0", (F.col("_cx") - F.col("_x0")).alias("_fx"), (F.col("_cy") - F.col("_y0")).alias("_fy"))
    met = placed.join(_squares(cells, keys, values), [*keys, "_y0", "_x0"])
    fx, fy = F.col("_fx"), F.col("_fy")
    weight = [(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy]
    whole = F.lit(True)
    for k in range(4):
        whole = whole & (F.col(f"_n{k}").isNotNull() | (weight[k] <= 0))

    def blend(v: str) -> Column:
        parts = [F.when(weight[k] > 0, weight[k] * F.col(f"_{k}{v}")).otherwise(0.0) for k in range(4)]
        return parts[0] + parts[1] + parts[2] + parts[3]

    return met.filter(whole).select(*keys, *point_key, *[blend(v).alias(v) for v in values])


def crop_cells(cells: DataFrame, x0, y0, width, height) -> DataFrame:
    x0, y0, w, h = (_size(v) for v in (x0, y0, width, height))
    inside = (F.col("x") >= x0) & (F.col("x") < x0 + w) & (F.col("y") >= y0) & (F.col("y") < y0 + h)
    return (cells.filter(inside).withColumn("x", (F.col("x") - x0).cast("int"))
            .withColumn("y", (F.col("y") - y0).cast("int")))


def base_sigma(sigma0: float = 1.6, assumed: float = 0.5, double: bool = False) -> float:
    """Blur still missing from a grid that already carries ``assumed``."""
    have = assumed * (2 if double else 1)
    return math.sqrt(max(sigma0 * sigma0 - have * have, 0.01))


def level_sigmas(steps: int, sigma0: float) -> list[float]:
    totals = [sigma0 * 2 ** (i / steps) for i in range(steps + 3)]
    return [math.sqrt(b * b - a * a) for a, b in zip(totals, totals[1:])]


def octave_count(width: int, height: int) -> int:
    return max(1, int(math.floor(math.log2(min(width, height)))) - 3)


def _blur_chain(sigmas: list[float]) -> tuple[int, Callable]:
    """Halo and kernel that blur level 0 into all levels of an octave.

    Every level is padded anew from its own edge values where the grid ends, so a tile holds what the whole grid would.
    """
    taps = [gaussian_taps(s) for s in sigmas]

    def kernel(a: dict[str, np.ndarray], beyond: tuple) -> dict[str, np.ndarray]:
        (top, bottom), (left, right) = beyond
        level, out = a["g0"], {}
        rows, cols = level.shape
        for i, t in enumerate(taps, start=1):
            level = _separable(np.pad(level, len(t) // 2, mode="edge"), t)
            inner = level[top:rows - bottom, left:cols - right]
            level = np.pad(inner, ((top, bottom), (left, right)), mode="edge")
            out[f"g{i}"] = level
        return out

    return sum(len(t) // 2 for t in taps), kernel


def scale_space(cells: DataFrame, keys: list[str], width: int, height: int, steps: int = 3,
                sigma0: float = 1.6, double: bool = False) -> DataFrame:
    """Blur levels g0..g{S+2} and their differences d0..d{S+1} for every octave.

    One wide row per cell: keys, octave, width, height, y, x, g*, d*.  Each level is blurred from the one before, all levels of an
    octave inside one pass over its tiles; the next octave starts from level S with every other row and column.
    """
    w, h = width, height
    base = cells.select(*keys, "y", "x", "v")
    if double:
        base, w, h = upsample2(base, keys, w, h), w * 2, h * 2
    level = gaussian_smooth(base, keys, w, h, base_sigma(sigma0, double=double), ["v"], ["g0"])
    halo, kernel = _blur_chain(level_sigmas(steps, sigma0))
    names = [f"g{i}" for i in range(1, steps + 3)]
    octaves = []
    for octave in range(octave_count(w, h)):
        level = cut(tile_stencil(level, keys, w, h, halo, ["g0"], kernel, names, carry=["g0"], chained=True))
        octaves.append(level.select(
            *keys, F.lit(octave).alias("octave"), F.lit(w).alias("width"), F.lit(h).alias("height"), "y", "x", "g0", *names,
            *[(F.col(f"g{i + 1}") - F.col(f"g{i}")).alias(f"d{i}") for i in range(steps + 2)]))
        level = decimate2(level.select(*keys, "y", "x", F.col(f"g{steps}").alias("g0")), w, h)
        w, h = max(1, w // 2), max(1, h // 2)
    out = octaves[0]
    for o in octaves[1:]:
        out = out.unionByName(o)
    return out
