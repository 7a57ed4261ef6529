"""Peaks of a scale space: detection, sub-cell refinement and stability filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.grids import TILE, tile_stencil
from tessera.session import cut

BORDER = 5
MAX_MOVES = 5
REACH = 6


def local_extrema(space: DataFrame, keys: list[str], steps: int = 3, threshold: float | None = None,
                  contrast: float = 0.04, border: int = BORDER) -> DataFrame:
    """Cells that no neighbour beats among the 26 around them in x, y and level (ties pass).

    Only values beyond ``threshold`` (default half the contrast rule) count, ``border`` cells in from
    every edge.  Result: keys, octave, width, height, level, y, x, v.
    """
    limit = 0.5 * contrast / steps if threshold is None else threshold
    cols = [f"d{i}" for i in range(steps + 2)]

    def kernel(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        stack = np.stack([a[c] for c in cols])
        h, w = stack.shape[1] - 2, stack.shape[2] - 2
        views = np.stack([stack[:, i:i + h, j:j + w] for i in range(3) for j in range(3)])
        top, low = views.max(axis=0), views.min(axis=0)
        out = {}
        for level in range(1, steps + 1):
            v = stack[level, 1:-1, 1:-1]
            peak = (v > 0) & (v >= top[level - 1:level + 2].max(axis=0))
            pit = (v <= 0) & (v <= low[level - 1:level + 2].min(axis=0))
            out[f"e{level}"] = (peak | pit) & (np.abs(v) > limit)
        return out

    key = [*keys, "octave", "width", "height"]
    hit = tile_stencil(space, key, F.col("width"), F.col("height"), 1, cols, kernel,
                       [f"e{i}" for i in range(1, steps + 1)], carry=cols[1:-1])
    inside = ((F.col("x") >= border) & (F.col("x") < F.col("width") - border)
              & (F.col("y") >= border) & (F.col("y") < F.col("height") - border))
    found = F.filter(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"d{i}").alias("v"), F.col(f"e{i}").alias("e"))
                               for i in range(1, steps + 1)]), lambda s: s["e"] > 0)
    return (hit.filter(inside).select(*key, "y", "x", F.explode(found).alias("s"))
            .select(*key, "s.level", "y", "x", "s.v"))


def _fits(d: np.ndarray, s: np.ndarray, y: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Quadratic fits around positions (level, row, column) of a stack of levels: gradient, stationary offset and spatial curvature."""
    def at(dx, dy, ds):
        return d[s + ds, y + dy, x + dx]

    def first(lo, hi):
        return (hi - lo) * 0.5

    def mixed(pp, np_, pn, nn):
        return (pp - np_ - pn + nn) * 0.25

    c0 = at(0, 0, 0)

    def second(lo, hi):
        return hi + lo - c0 * 2

    def det3(m):
        return (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
                + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))

    gx, gy, gs = first(at(-1, 0, 0), at(1, 0, 0)), first(at(0, -1, 0), at(0, 1, 0)), first(at(0, 0, -1), at(0, 0, 1))
    dxx, dyy, dss = second(at(-1, 0, 0), at(1, 0, 0)), second(at(0, -1, 0), at(0, 1, 0)), second(at(0, 0, -1), at(0, 0, 1))
    dxy = mixed(at(1, 1, 0), at(-1, 1, 0), at(1, -1, 0), at(-1, -1, 0))
    dxs = mixed(at(1, 0, 1), at(-1, 0, 1), at(1, 0, -1), at(-1, 0, -1))
    dys = mixed(at(0, 1, 1), at(0, -1, 1), at(0, 1, -1), at(0, -1, -1))
    hess, rhs = [[dxx, dxy, dxs], [dxy, dyy, dys], [dxs, dys, dss]], (-gx, -gy, -gs)
    det = det3(hess)
    with np.errstate(divide="ignore", invalid="ignore"):
        offsets = [det3([[rhs[r] if c == k else hess[r][c] for c in range(3)] for r in range(3)]) / det for k in range(3)]
    return {"c0": c0, "gx": gx, "gy": gy, "gs": gs, "dxx": dxx, "dyy": dyy, "dxy": dxy,
            "ox": offsets[0], "oy": offsets[1], "os": offsets[2], "_det": det}


def _half_away(a: np.ndarray) -> np.ndarray:
    return (np.sign(a) * np.floor(np.clip(np.abs(a), 0, 1e8) + 0.5)).astype(np.int64)


_FIT = ["c0", "gx", "gy", "gs", "dxx", "dyy", "dxy", "ox", "oy", "os"]
_AT = ["level0", "y0", "x0", "level", "y", "x"]


def _walk(pdf: pd.DataFrame, cells: pd.DataFrame, keys: list[str], steps: int, border: int, tile: int) -> pd.DataFrame:
    """Moves of the extrema of one tile until they settle, drop out or leave the cells at hand; the last wait for another tile (_wait)."""
    top, left = int(pdf._ty.iloc[0]) * tile - REACH, int(pdf._tx.iloc[0]) * tile - REACH
    side = tile + 2 * REACH
    d = np.full((steps + 2, side, side), np.nan)
    d[:, cells.y.to_numpy() - top, cells.x.to_numpy() - left] = cells[[f"d{i}" for i in range(steps + 2)]].to_numpy().T
    go, out = pdf.drop(columns=["_ty", "_tx"]), []
    while len(go):
        at = go["level"].to_numpy(), go["y"].to_numpy() - top, go["x"].to_numpy() - left
        here = np.logical_and.reduce([(p >= 1) & (p < side - 1) for p in at[1:]])
        out.append(go[~here].assign(_wait=True, **{c: np.nan for c in _FIT}))
        go, at = go[here], [p[here] for p in at]
        fit = _fits(d, *at)
        sound = np.abs(fit.pop("_det")) > 1e-12
        small = sound & np.logical_and.reduce([np.abs(fit[c]) < 0.5 for c in ("ox", "oy", "os")])
        out.append(go[small].assign(_wait=False, **{c: v[small] for c, v in fit.items()}))
        more = sound & ~small & (go._moves.to_numpy() < MAX_MOVES)
        go = go[more].assign(_moves=go._moves[more] + 1)
        for c, o in (("level", "os"), ("y", "oy"), ("x", "ox")):
            go[c] = go[c].to_numpy() + _half_away(fit[o][more])
        inside = go["level"].between(1, steps)
        for c, size in (("x", "width"), ("y", "height")):
            inside &= (go[c] >= border) & (go[c] < go[size] - border)
        go = go[inside]
    found = pd.concat(out, ignore_index=True)
    return found[[*keys, "octave", "width", "height", *_AT, "_moves", *_FIT, "_wait"]]


def refine_extrema(extrema: DataFrame, space: DataFrame, keys: list[str], steps: int = 3,
                   border: int = BORDER, tile: int = TILE) -> DataFrame:
    """Move each extremum to the cell its quadratic fit points at, up to five times.

    Settles when every offset is under half a cell; drops out when singular, outside, next to a missing cell or still
    moving.  Adds ox, oy, os and the fit's gradient and curvature at the final cell.

    Extrema meet the cells of their tile and a rim of ``REACH`` cells once and move there; only those that a far jump takes beyond the
    rim meet another tile in a further round (each such round is a move, so five at most).
    """
    key = [*keys, "octave", "width", "height"]
    levels = [f"d{i}" for i in range(steps + 2)]
    types = dict(extrema.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in key] + [f"`{c}` int" for c in (*_AT, "_moves")] + [f"`{c}` double" for c in _FIT] + ["_wait boolean"])
    # cells near a tile's edge go to the neighbours too
    near = [F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + o) / tile) for o in (0, REACH, -REACH)]))) for c in ("y", "x")]
    cells = space.select(*key, "y", "x", *levels, near[0].alias("_ty")).withColumn("_tx", near[1])
    active = extrema.select(*key, F.col("level").alias("level0"), F.col("y").alias("y0"), F.col("x").alias("x0"),
                            "level", "y", "x", F.lit(0).alias("_moves"))
    tiled = [*key, "_ty", "_tx"]
    settled = None
    for _ in range(MAX_MOVES + 1):
        placed = active.withColumn("_ty", F.floor(F.col("y") / tile)).withColumn("_tx", F.floor(F.col("x") / tile))
        wanted = cells.join(placed.select(*tiled).distinct(), tiled, "left_semi")

        def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if len(left) == 0:
                return pd.DataFrame()
            return _walk(left, right, keys, steps, border, tile)

        moved = cut(placed.groupBy(*tiled).cogroup(wanted.groupBy(*tiled)).applyInPandas(walk, schema))
        done = moved.filter("not _wait").drop("_wait", "_moves")
        settled = done if settled is None else settled.unionByName(done)
        active = moved.filter("_wait").select(*key, *_AT, "_moves")
        if active.isEmpty():
            break
    return settled.select(*key, *_AT, *_FIT)


def contrast_edge_filter(refined: DataFrame, steps: int = 3, sigma0: float = 1.6, contrast: float = 0.04,
                         edge: float = 10.0, doubled: bool = False) -> DataFrame:
    """Keep well-contrasted, blob-like peaks and map them to base-grid position and scale."""
    response = F.col("c0") + 0.5 * (F.col("gx") * F.col("ox") + F.col("gy") * F.col("oy") + F.col("gs") * F.col("os"))
    trace = F.col("dxx") + F.col("dyy")
    det = F.col("dxx") * F.col("dyy") - F.col("dxy") * F.col("dxy")
    back = F.pow(F.lit(2.0), F.col("octave")) * (0.5 if doubled else 1.0)
    kept = refined.withColumn("response", response).filter(
        (F.abs("response") * steps >= contrast) & (det > 0)
        & (trace * trace * edge < (edge + 1) ** 2 * det))
    own = sigma0 * F.pow(F.lit(2.0), (F.col("level") + F.col("os")) / steps)
    drop = {"c0", "gx", "gy", "gs", "dxx", "dyy", "dxy", "ox", "oy", "os", "x", "y"}
    return kept.select(*[c for c in kept.columns if c not in drop],
                       ((F.col("x") + F.col("ox")) * back).alias("px"),
                       ((F.col("y") + F.col("oy")) * back).alias("py"), (own * back).alias("scale"))
