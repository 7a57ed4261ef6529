"""Smooth per-source offset surfaces on a coarse vertex grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tessera.functions.projective import cam_homography, h_apply
from tessera.functions.similarity import sim_apply, sim_compose, sim_inverse
from tessera.operators.solve import PIVOT, solve_spd
from tessera.session import cut, release

CUTOFF = 40.0
SOURCE = ["set_id", "source_id"]
#: Cells of the largest factor that one task takes (32 MB), and of the factors that are solved with together.
BAND_CELLS = 4_000_000
#: Observations of the largest set whose sweeps run in one task.
SET_ROWS = 100_000
#: About so many observations, and cells of factors, of whole sets go to a task together.
BUCKET_ROWS, BUCKET_CELLS = 25_000, 1_000_000
_SETTLED = pa.schema([("set_id", pa.int64()), ("source_id", pa.int64()), ("cols", pa.int32()), ("ax", pa.list_(pa.float64())), ("ay", pa.list_(pa.float64())),
                      ("before", pa.float64()), ("after", pa.float64())])


def mesh_shape(width: Column, height: Column, spacing: int) -> tuple[Column, Column]:
    """Vertex columns and rows, at most ``spacing`` apart, at least 2 x 2."""
    cols = F.greatest(F.lit(2), (F.ceil(width / spacing) + 1).cast("int"))
    rows = F.greatest(F.lit(2), (F.ceil(height / spacing) + 1).cast("int"))
    return cols, rows


def mesh_stencil(x: Column, y: Column, width: Column, height: Column, spacing: int) -> Column:
    """ARRAY of four STRUCT<vr, vc, weight>: the bilinear vertices around a point."""
    cols, rows = mesh_shape(width, height, spacing)
    gx = F.least(F.greatest(x, F.lit(0.0)), width.cast("double")) / width * (cols - 1)
    gy = F.least(F.greatest(y, F.lit(0.0)), height.cast("double")) / height * (rows - 1)
    c0 = F.least(F.floor(gx).cast("int"), cols - 2)
    r0 = F.least(F.floor(gy).cast("int"), rows - 2)
    fx, fy = gx - c0, gy - r0

    def vertex(r, c, w):
        return F.struct(r.alias("vr"), c.alias("vc"), w.alias("weight"))

    return F.array(vertex(r0, c0, (1 - fx) * (1 - fy)), vertex(r0, c0 + 1, fx * (1 - fy)),
                   vertex(r0 + 1, c0, (1 - fx) * fy), vertex(r0 + 1, c0 + 1, fx * fy))


def mesh_offset(points: DataFrame, mesh: DataFrame, key: list[str], spacing: int) -> DataFrame:
    """Interpolated offset at every point (set_id, source_id, x, y, width, height): key, ox, oy.

    A point meets the vertices of its source once, as an array, so it is not copied for each vertex around it.  Vertices that a mesh
    lacks add nothing; a point with none of its vertices has no row.  Points with one key add up.
    """
    once = mesh.groupBy(*SOURCE, "vr", "vc").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"), F.lit(True).alias("there"))
    far = once.groupBy(*SOURCE).agg(F.max("vr").cast("int").alias("_far_r"), F.max("vc").cast("int").alias("_far_c"))
    grid = far.withColumn("vr", F.explode(F.sequence(F.lit(0), F.col("_far_r")))).withColumn("vc", F.explode(F.sequence(F.lit(0), F.col("_far_c"))))
    row = F.sort_array(F.collect_list(F.struct("vr", "vc", "dx", "dy", "there")))
    packed = grid.join(once, [*SOURCE, "vr", "vc"], "left").groupBy(*SOURCE, "_far_r", "_far_c").agg(row.alias("_mesh"))
    names = list(dict.fromkeys([*key, *SOURCE]))
    taps = mesh_stencil(F.col("x"), F.col("y"), F.col("width"), F.col("height"), spacing)
    placed = points.select(*names, taps[0]["vr"].alias("_r"), taps[0]["vc"].alias("_c"), *[taps[k]["weight"].alias(f"_w{k}") for k in range(4)])

    def tap(k: int) -> Column:
        c = F.col("_c") + k % 2
        return F.when(c <= F.col("_far_c"), F.get("_mesh", (F.col("_r") + k // 2) * (F.col("_far_c") + 1) + c)).alias(f"_v{k}")

    met = placed.join(packed, SOURCE).select(*names, *[f"_w{k}" for k in range(4)], *[tap(k) for k in range(4)])
    met = met.filter(" OR ".join(f"_v{k}.there" for k in range(4)))

    def offset(d: str) -> Column:
        parts = [F.col(f"_w{k}") * F.col(f"_v{k}")[d] for k in range(4)]
        return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(q, F.lit(0.0)) for q in parts), F.lit(0.0)))

    return met.groupBy(*key).agg(F.sum(offset("dx")).alias("ox"), F.sum(offset("dy")).alias("oy"))


def mesh_max_offset(mesh: DataFrame) -> DataFrame:
    return mesh.groupBy(*SOURCE).agg(F.max(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)).alias("max_offset"))


def _flat_stencil(x: Column, y: Column, width: Column, height: Column, spacing: int) -> Column:
    """The same with the vertex number instead of row and column."""
    cols, _ = mesh_shape(width, height, spacing)
    return F.transform(mesh_stencil(x, y, width, height, spacing), lambda s: F.struct(
        (s["vr"] * cols + s["vc"]).cast("bigint").alias("i"), s["weight"].alias("weight")))


def _vertices(sources: DataFrame, spacing: int) -> DataFrame:
    cols, rows = mesh_shape(F.col("width"), F.col("height"), spacing)
    return (sources.select(*SOURCE, cols.alias("cols"), rows.alias("rows"))
            .withColumn("vr", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
            .withColumn("vc", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))))


def _regularity(vertices: DataFrame, smoothness: float, rigidity: float) -> DataFrame:
    """Graph-Laplacian and zero-prior matrix cells of every source's vertex grid."""
    own = (F.col("vr") * F.col("cols") + F.col("vc")).cast("bigint")
    right = F.when(F.col("vc") + 1 < F.col("cols"), own + 1)
    below = F.when(F.col("vr") + 1 < F.col("rows"), own + F.col("cols"))

    def cell(i, j, val):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(val).alias("val"))

    terms = [cell(own, own, rigidity)]
    for n in (right, below):
        terms += [cell(F.when(n.isNotNull(), own), own, smoothness), cell(n, n, smoothness),
                  cell(F.when(n.isNotNull(), own), n, -smoothness), cell(n, own, -smoothness)]
    return (vertices.select(*SOURCE, F.explode(F.array(*terms)).alias("c"))
            .select(*SOURCE, "c.*").filter("i is not null and j is not null"))


def band_factor(i: np.ndarray, j: np.ndarray, val: np.ndarray, n: int, width: int) -> np.ndarray | None:
    """Cholesky factor of a banded matrix (cells of its lower half suffice) as [k, j] = L[j + k, j], k up to ``width``; None if singular."""
    band = np.zeros((width + 1, n + width + 1))
    low = i >= j
    np.add.at(band, (i[low] - j[low], j[low]), val[low])
    own = band[0, :n].copy()
    # the window holds what earlier columns have left of rows and columns j .. j + width
    window = np.zeros((width + 1, width + 1))
    for k in range(width + 1):
        window[k:, k] = band[:width + 1 - k, k]
    out = np.zeros((width + 1, n))
    for at in range(n):
        if not window[0, 0] > PIVOT * own[at]:
            return None
        column = window[:, 0] / np.sqrt(window[0, 0])
        out[:, at] = column
        window -= np.outer(column, column)
        window[:-1, :-1] = window[1:, 1:]
        # only the lower half counts: a new last row comes in, one cell for each column of the window
        window[-1] = band[np.arange(width, -1, -1), at + 1 + np.arange(width + 1)]
    return out


def band_solve(factors: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of many systems of one shape: factors [system, k, j], right-hand sides [system, j, side]."""
    return _substitute(np.ascontiguousarray(factors.transpose(2, 1, 0)), right)


def _substitute(factors: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same with factors as [j, k, system], so that each step works on neighbouring numbers."""
    n, width = factors.shape[0], factors.shape[1] - 1
    x = np.concatenate([right.transpose(1, 2, 0), np.zeros((width, right.shape[2], len(right)))])
    for at in range(n):
        x[at] /= factors[at, 0]
        x[at + 1:at + 1 + width] -= factors[at, 1:, None] * x[at]
    for at in range(n - 1, -1, -1):
        x[at] = (x[at] - (factors[at, 1:, None] * x[at + 1:at + 1 + width]).sum(axis=0)) / factors[at, 0]
    return x[:n].transpose(2, 0, 1)


class _Factors:
    """The matrices of all sources, factored once; sweeps only bring new right-hand sides."""

    def __init__(self, matrix: DataFrame, verts: DataFrame, band_cells: int) -> None:
        shape = verts.select(*SOURCE, (F.col("cols") * F.col("rows")).alias("n"), (F.col("cols") + 1).alias("width")).distinct()
        self.shape = cut(shape.withColumn("cells", F.col("n").cast("bigint") * (F.col("width") + 1)))
        small = self.shape.filter(F.col("cells") <= band_cells)
        self.buckets = max(1, -(-(small.agg(F.sum("cells")).first()[0] or 0) // band_cells))
        self.factors = cut(matrix.join(small.drop("cells"), SOURCE).select(*SOURCE, "n", "width", "i", "j", "val").filter("i >= j").groupBy(*SOURCE).applyInArrow(
            self._factor, "set_id bigint, source_id bigint, n int, width int, factor binary"))
        self.wide = cut(self.shape.filter(F.col("cells") > band_cells).select(*SOURCE))
        self.matrix = None if self.wide.isEmpty() else cut(matrix.join(self.wide, SOURCE, "left_semi"))

    @staticmethod
    def _factor(t: pa.Table) -> pa.Table:
        n, width = t["n"][0].as_py(), t["width"][0].as_py()
        found = band_factor(t["i"].to_numpy(), t["j"].to_numpy(), t["val"].to_numpy(), n, width)
        t = t.slice(0, 0 if found is None else 1).select([*SOURCE, "n", "width"])
        return t.append_column("factor", pa.array([] if found is None else [found.tobytes()], pa.binary()))

    def solve(self, taps: DataFrame) -> DataFrame:
        """Right-hand sides (SOURCE, i, dx, dy; repeated ones add up) -> SOURCE, nx, ny: row-major arrays of the solutions."""
        sides = taps.groupBy(*SOURCE, "i").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
        bucket = F.pmod(F.xxhash64(*SOURCE), F.lit(self.buckets)).alias("bucket")
        kind = pa.schema([("set_id", pa.int64()), ("source_id", pa.int64()), ("nx", pa.list_(pa.float64())), ("ny", pa.list_(pa.float64()))])

        def work(factors: pa.Table, right: pa.Table) -> pa.Table:
            keys = list(zip(factors["set_id"].to_pylist(), factors["source_id"].to_pylist()))
            at = {k: p for p, k in enumerate(keys)}
            n, width = factors["n"].to_numpy(), factors["width"].to_numpy()
            owner = np.array([at.get(k, -1) for k in zip(right["set_id"].to_pylist(), right["source_id"].to_pylist())], np.int64)
            i, d = right["i"].to_numpy(), np.column_stack([right["dx"].to_numpy(), right["dy"].to_numpy()])
            out: list[list] = [[], [], [], []]
            for one, w in sorted(set(zip(n.tolist(), width.tolist()))):
                some = np.flatnonzero((n == one) & (width == w))
                place = np.full(len(keys) + 1, -1)
                place[some] = np.arange(len(some))
                mine = place[owner] >= 0
                b = np.zeros((len(some), one, 2))
                b[place[owner[mine]], i[mine]] = d[mine]
                held = np.stack([np.frombuffer(factors["factor"][int(p)].as_py()).reshape(w + 1, one) for p in some])
                x = band_solve(held, b)
                for p, v in zip(some.tolist(), x):
                    for column, value in zip(out, (*keys[p], v[:, 0], v[:, 1])):
                        column.append(value)
            return pa.table([pa.array(c, f.type) for c, f in zip(out, kind)], schema=kind)

        solved = (self.factors.withColumn("bucket", bucket).groupBy("bucket").cogroup(sides.withColumn("bucket", bucket).groupBy("bucket"))
                  .applyInArrow(work, "set_id bigint, source_id bigint, nx array<double>, ny array<double>"))
        if self.matrix is None:
            return solved
        found = solve_spd(self.matrix, sides.join(self.wide, SOURCE, "left_semi"), SOURCE, ["dx", "dy"])
        listed = found.groupBy(*SOURCE).agg(F.array_sort(F.collect_list(F.struct("i", "dx", "dy"))).alias("v"))
        return solved.unionByName(listed.select(*SOURCE, F.col("v.dx").alias("nx"), F.col("v.dy").alias("ny")))


def band_factors(bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``band_factor`` for many matrices of one shape, bands [j, k, system] = M[j + k, j]: factors [j, k, system] and which systems are regular."""
    n, wide, m = bands.shape
    bands = np.concatenate([bands, np.zeros((wide, wide, m))])
    out, sound, own = np.zeros((n, wide, m)), np.ones(m, bool), bands[:n, 0]
    window, corner = np.zeros((wide, wide, m)), np.arange(wide)
    for k in range(wide):
        window[k:, k] = bands[k, :wide - k]
    for at in range(n):
        fine = window[0, 0] > PIVOT * own[at]
        sound &= fine
        column = window[:, 0] / np.sqrt(np.where(fine, window[0, 0], 1.0))
        out[at] = column
        window -= column[:, None] * column
        window[:-1, :-1] = window[1:, 1:]
        window[-1] = bands[at + 1 + corner, corner[::-1]]
    return out, sound


def _at(names: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """Places of the wanted combinations among the named ones, -1 where there is none."""
    return pd.MultiIndex.from_arrays(names).get_indexer(pd.MultiIndex.from_arrays(wanted))


class _Taps:
    """The four vertices around each point, as numbers over all meshes of a task, and their weights."""

    def __init__(self, x: np.ndarray, y: np.ndarray, source: np.ndarray, width: np.ndarray, height: np.ndarray, cols: np.ndarray, rows: np.ndarray, first: np.ndarray) -> None:
        w, h, c, r = width[source], height[source], cols[source], rows[source]
        gx, gy = np.clip(x, 0, w) / w * (c - 1), np.clip(y, 0, h) / h * (r - 1)
        c0, r0 = np.minimum(np.floor(gx).astype(np.int64), c - 2), np.minimum(np.floor(gy).astype(np.int64), r - 2)
        fx, fy = gx - c0, gy - r0
        own = r0 * c + c0
        self.local = np.stack([own, own + 1, own + c, own + c + 1])
        self.index = self.local + first[source]
        self.weight = np.stack([(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy])

    def read(self, offsets: np.ndarray) -> np.ndarray:
        return (self.weight * offsets[self.index]).sum(axis=0)

    def spread(self, pull: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index.ravel(), (self.weight * pull).ravel(), size)


def _settle(seen: pa.Table, about: pa.Table, spacing: int, sweeps: int, damping: float, smoothness: float, rigidity: float) -> pa.Table:
    """All sweeps of some whole sets.

    ``seen``: set_id, i, j, px, py, qx, qy.  ``about``: set_id, source_id, width, height of every source (other null) and, of every two that were seen together, in
    either order, source_id, other and rel (4 numbers of a similarity or 9 of a homography between centred points).
    """
    def column(t: pa.Table, name: str, kind: type = float) -> np.ndarray:
        return t[name].to_numpy().astype(kind)

    single = about["other"].is_null().to_numpy()
    src, ties = about.filter(pa.array(single)), about.filter(pa.array(~single))
    width, height = column(src, "width"), column(src, "height")
    cols, rows = (np.maximum(2, np.ceil(v / spacing).astype(np.int64) + 1) for v in (width, height))
    # meshes of one shape lie next to each other
    order = np.lexsort([rows, cols])
    src, width, height, cols, rows = src.take(pa.array(order)), width[order], height[order], cols[order], rows[order]
    sets, ids, n = column(src, "set_id", np.int64), column(src, "source_id", np.int64), cols * rows
    first = np.cumsum(n) - n
    size = int(n.sum())
    tied = [_at([sets, ids], [column(ties, "set_id", np.int64), column(ties, c, np.int64)]) for c in ("source_id", "other")]
    rel = ties["rel"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(ties.num_rows, -1 if ties.num_rows else 4)
    each, (px, py, qx, qy) = column(seen, "set_id", np.int64), (column(seen, c) for c in ("px", "py", "qx", "qy"))
    i, j = (_at([sets, ids], [each, column(seen, c, np.int64)]) for c in ("i", "j"))
    own, other, x, y, ux, uy = (np.concatenate(v) for v in ((i, j), (j, i), (px, qx), (py, qy), (qx, px), (qy, py)))
    tie = _at(tied, [own, other]) if ties.num_rows else np.full(len(own), -1)

    def lands(ux: np.ndarray, uy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = rel[tie].T
        if len(m) == 4:
            return m[0] * ux - m[1] * uy + m[2], m[1] * ux + m[0] * uy + m[3]
        u, v = ux - width[other] / 2, uy - height[other] / 2
        w = m[6] * u + m[7] * v + m[8]
        return (m[0] * u + m[1] * v + m[2]) / w + width[own] / 2, (m[3] * u + m[4] * v + m[5]) / w + height[own] / 2

    def kept(some: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(v[some] for v in (own, other, tie, x, y, ux, uy))

    own, other, tie, x, y, ux, uy = kept(tie >= 0)
    with np.errstate(all="ignore"):
        gx, gy = lands(ux, uy)
        near = np.sqrt((gx - x) ** 2 + (gy - y) ** 2) < CUTOFF
    own, other, tie, x, y, ux, uy = kept(near)
    here = _Taps(x, y, own, width, height, cols, rows, first)
    there = _Taps(ux, uy, other, width, height, cols, rows, first)
    active = np.bincount(own, minlength=len(n)) > 0

    groups = []
    for c, r in sorted(set(zip(cols[active].tolist(), rows[active].tolist()))):
        some = np.flatnonzero(active & (cols == c) & (rows == r))
        m, k = int(c * r), np.full(len(n), -1)
        k[some] = np.arange(len(some))
        mine = k[own] >= 0
        system, local, weight = k[own[mine]], here.local[:, mine], here.weight[:, mine]
        band = np.zeros(m * (c + 2) * len(some))
        for a in range(4):
            for b in range(a + 1):
                band += np.bincount((local[b] * (c + 2) + local[a] - local[b]) * len(some) + system, weight[a] * weight[b], len(band))
        band = band.reshape(m, c + 2, len(some))
        vertex = np.arange(m)
        right, below = (vertex + 1) % c > 0, vertex + c < m
        ends = right.astype(float) + below + (vertex % c > 0) + (vertex >= c)
        band[:, 0] += (rigidity + smoothness * ends)[:, None]
        band[:, 1] -= smoothness * right[:, None]
        band[:, c] -= smoothness * below[:, None]
        factors, sound = band_factors(band)
        groups.append((first[some[sound], None] + vertex, factors if sound.all() else factors[:, :, sound]))

    dx, dy = np.zeros(size), np.zeros(size)
    numbers, set_of = np.unique(sets, return_inverse=True)
    count = np.bincount(set_of[own], minlength=len(numbers))

    def pulls() -> tuple[np.ndarray, np.ndarray]:
        """How far every constraint still wants to move its own point."""
        gx, gy = lands(ux + there.read(dx), uy + there.read(dy))
        return gx - x, gy - y

    def rms() -> np.ndarray:
        bx, by = pulls()
        miss = (bx - here.read(dx)) ** 2 + (by - here.read(dy)) ** 2
        return np.sqrt(np.bincount(set_of[own], miss, len(numbers)) / np.maximum(count, 1))

    with np.errstate(all="ignore"):
        before = rms()
        for _ in range(sweeps):
            bx, by = pulls()
            sides = np.stack([here.spread(bx, size), here.spread(by, size)], axis=1)
            for slots, factors in groups:
                new = _substitute(factors, sides[slots])
                dx[slots] += damping * (new[:, :, 0] - dx[slots])
                dy[slots] += damping * (new[:, :, 1] - dy[slots])
        after = rms()
    told = pa.array(count[set_of] == 0)
    offsets = pa.array(np.append(first, size).astype(np.int32))
    figures = [pa.array(v[set_of], mask=told.to_numpy(zero_copy_only=False)) for v in (before, after)]
    return pa.table([pa.array(sets), pa.array(ids), pa.array(cols.astype(np.int32)), *[pa.ListArray.from_arrays(offsets, pa.array(d)) for d in (dx, dy)], *figures], schema=_SETTLED)


def _in_tasks(observations: DataFrame, sources: DataFrame, ties: DataFrame, buckets: int, *how) -> DataFrame:
    """Whole sets in ``buckets`` groups: SOURCE, cols, ax, ay (row-major offsets) and the rms before and after of the set."""
    bucket = F.pmod(F.xxhash64("set_id"), F.lit(buckets)).alias("bucket")
    blank = sources.select(*SOURCE, F.lit(None).cast("bigint").alias("other"), F.lit(None).cast("array<double>").alias("rel"), F.col("width").cast("double"), F.col("height").cast("double"))
    tie = ties.select(*SOURCE, "other", "rel", F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"))
    seen = observations.select(bucket, "set_id", "i", "j", *[F.col(c).cast("double") for c in ("px", "py", "qx", "qy")]).dropna(subset=["i", "j"])
    return (seen.groupBy("bucket").cogroup(blank.unionByName(tie).withColumn("bucket", bucket).groupBy("bucket"))
            .applyInArrow(lambda o, s: _settle(o, s, *how), from_arrow_schema(_SETTLED)))


def _by_sweeps(observations: DataFrame, placements: DataFrame, spacing: int, sweeps: int, damping: float, smoothness: float,
               rigidity: float, band_cells: int) -> tuple[DataFrame, DataFrame]:
    """The same for sets of any size: SOURCE, cols, ax, ay and metrics.  Every sweep is a round of joins.

    The matrix of a source never changes, so it is factored once, as a band; a sweep brings new right-hand sides to the stored factors, many sources
    in one task.  A mesh whose band would not fit (``band_cells``) goes through the general solver.
    """
    ends = [observations.select("set_id", *[F.col(s).alias(d) for s, d in zip(src, dst)])
            for src, dst in ((("i", "px", "py", "j", "qx", "qy"), ("source_id", "x", "y", "other", "ux", "uy")),
                             (("j", "qx", "qy", "i", "px", "py"), ("source_id", "x", "y", "other", "ux", "uy")))]
    both = ends[0].unionByName(ends[1])
    flat = "t" in placements.columns
    how = ["t"] if flat else ["rot", "focal"]
    own = placements.select(*SOURCE, *how, "width", "height")
    other = placements.select("set_id", F.col("source_id").alias("other"), *[F.col(c).alias(c + "_other") for c in how],
                              F.col("width").alias("w_other"), F.col("height").alias("h_other"))
    rel = (sim_compose(sim_inverse(F.col("t")), F.col("t_other")) if flat
           else cam_homography(F.col("rot"), F.col("focal"), F.col("rot_other"), F.col("focal_other")))
    placed = both.join(own, SOURCE).join(other, ["set_id", "other"]).withColumn("rel", rel)

    def lands(x: Column, y: Column) -> tuple[Column, Column]:
        """Where a point of the other source falls in the own one."""
        if flat:
            return sim_apply(F.col("rel"), x, y)
        hx, hy = h_apply(F.col("rel"), x - F.col("w_other") / 2, y - F.col("h_other") / 2)
        return hx + F.col("width") / 2, hy + F.col("height") / 2

    tx, ty = lands(F.col("ux"), F.col("uy"))
    near = F.sqrt((tx - F.col("x")) ** 2 + (ty - F.col("y")) ** 2) < CUTOFF
    # the vertices around both ends never change, so they are worked out once and ride along
    cons = cut(placed.filter(near).select(
        *SOURCE, "x", "y", "other", "ux", "uy", "rel", "width", "height", "w_other", "h_other",
        _flat_stencil(F.col("x"), F.col("y"), F.col("width"), F.col("height"), spacing).alias("here"),
        _flat_stencil(F.col("ux"), F.col("uy"), F.col("w_other"), F.col("h_other"), spacing).alias("there")))
    verts = cut(_vertices(placements.select(*SOURCE, "width", "height").distinct(), spacing))
    first, second = cons.select(*SOURCE, "here", F.explode("here").alias("s")), F.explode("here").alias("z")
    data = first.select(*SOURCE, "s", second).select(
        *SOURCE, F.col("s.i").alias("i"), F.col("z.i").alias("j"), (F.col("s.weight") * F.col("z.weight")).alias("val"))
    active = cons.select(*SOURCE).distinct()
    fixed = _regularity(verts, smoothness, rigidity).join(active, SOURCE, "left_semi")
    matrix = cut(data.unionByName(fixed).groupBy(*SOURCE, "i", "j").agg(F.sum("val").alias("val")))
    slot = (F.col("vr") * F.col("cols") + F.col("vc")).cast("bigint")
    factors = _Factors(matrix, verts.join(active, SOURCE, "left_semi"), band_cells)
    nothing = F.array_repeat(F.lit(0.0), F.col("cols") * F.col("rows"))
    mesh = cut(verts.select(*SOURCE, "cols", "rows").distinct().select(*SOURCE, nothing.alias("ax"), nothing.alias("ay")))
    zeros = verts.join(active, SOURCE, "left_semi").select(*SOURCE, slot.alias("i"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))

    def read(stencil: str, offsets: str):
        return F.aggregate(stencil, F.lit(0.0), lambda acc, v: acc + v["weight"] * F.element_at(offsets, (v["i"] + 1).cast("int")))

    def pulls(current: DataFrame) -> DataFrame:
        """How far every constraint still wants to move its own point."""
        moved = (cons.join(current.withColumnRenamed("source_id", "other"), ["set_id", "other"])
                 .withColumns({"ox": read("there", "ax"), "oy": read("there", "ay")}).drop("ax", "ay"))
        gx, gy = lands(F.col("ux") + F.col("ox"), F.col("uy") + F.col("oy"))
        return moved.select(*SOURCE, "here", (gx - F.col("x")).alias("bx"), (gy - F.col("y")).alias("by"))

    def rms(current: DataFrame) -> DataFrame:
        both_ends = pulls(current).join(current, SOURCE)
        miss = (F.col("bx") - read("here", "ax")) ** 2 + (F.col("by") - read("here", "ay")) ** 2
        return both_ends.groupBy("set_id").agg(F.coalesce(F.sqrt(F.avg(miss)), F.lit(0.0)).alias("rms"))

    def toward(old: str, new: str) -> Column:
        """Part of the way to the solution; a source without one stays."""
        return F.coalesce(F.zip_with(old, new, lambda a, b: a + damping * (b - a)), F.col(old)).alias(old)

    before = cut(rms(mesh).withColumn("stage", F.lit("before")))
    for _ in range(sweeps):
        taps = (pulls(mesh).select(*SOURCE, "bx", "by", F.explode("here").alias("s"))
                .select(*SOURCE, F.col("s.i").alias("i"), (F.col("s.weight") * F.col("bx")).alias("dx"),
                        (F.col("s.weight") * F.col("by")).alias("dy")))
        # a general solver needs a side for every unknown, banded factors do not
        solved = factors.solve(taps if factors.matrix is None else taps.unionByName(zeros))
        last, mesh = mesh, cut(mesh.join(solved, SOURCE, "left").select(*SOURCE, toward("ax", "nx"), toward("ay", "ny")))
        release(last)
    after = rms(mesh).withColumn("stage", F.lit("after"))
    return mesh.join(verts.select(*SOURCE, "cols").distinct(), SOURCE).select(*SOURCE, "cols", "ax", "ay"), before.unionByName(after)


def fit_offset_surface(observations: DataFrame, placements: DataFrame, spacing: int = 100,
                       sweeps: int = 8, damping: float = 0.5, smoothness: float = 1.0,
                       rigidity: float = 0.02, band_cells: int = BAND_CELLS, set_rows: int = SET_ROWS) -> tuple[DataFrame, DataFrame]:
    """Offset surfaces that pull the two ends of every match together.

    ``observations``: set_id, i, j, px, py, qx, qy.  ``placements``: set_id, source_id, width, height and either t (similarities
    into one frame) or rot and focal (cameras).  Each match constrains both ends: where the partner (with its current offset) lands in the
    own source, minus the own point.  Constraints off by 40 or more are dropped once at the start.  All
    sources move together, half way (``damping``) to their own least-squares surface per sweep.

    Sets of up to ``set_rows`` observations whose factors fit (``band_cells``) run all their sweeps in one task, many sets together, so their observations are
    shuffled once; a sweep of larger sets is a round of joins.

    Returns mesh (set_id, source_id, vr, vc, dx, dy) and metrics (set_id, stage, rms).
    """
    flat = "t" in placements.columns
    how = ["t"] if flat else ["rot", "focal"]
    known = cut(placements.select(*[F.col(c).cast("bigint").alias(c) for c in SOURCE], *how, "width", "height").dropna(subset=[*SOURCE, "width", "height"]))
    pairs = cut(observations.groupBy("set_id", "i", "j").agg(F.count(F.lit(1)).alias("n")))
    cols, rows = mesh_shape(F.col("width"), F.col("height"), spacing)
    room = known.groupBy("set_id").agg(F.sum(cols.cast("bigint") * rows * (cols + 2)).alias("cells"))
    sets = room.join(pairs.groupBy("set_id").agg(F.sum("n").alias("n")), "set_id", "left").select("set_id", "cells", F.coalesce("n", F.lit(0)).alias("n"))
    sets = cut(sets.withColumn("small", (F.col("cells") <= band_cells) & (F.col("n") <= set_rows)))
    small = sets.filter("small").select("set_id")
    few = sets.agg(F.sum(F.when(F.col("small"), F.col("n"))).alias("n"), F.sum(F.when(F.col("small"), F.col("cells"))).alias("cells"),
                   F.count(F.when(~F.col("small"), 1)).alias("large")).first()
    meshes, metrics = [], []
    if few["n"] is not None:
        own = known.select(*SOURCE, *how)
        other = known.select("set_id", F.col("source_id").alias("other"), *[F.col(c).alias(c + "_other") for c in how])
        ends = pairs.select("set_id", F.col("i").alias("source_id"), F.col("j").alias("other"))
        ends = ends.union(pairs.select("set_id", "j", "i")).distinct().join(own, SOURCE).join(other, ["set_id", "other"])
        if flat:
            rel = sim_compose(sim_inverse(F.col("t")), F.col("t_other"))
            rel = F.array(*[rel[c] for c in ("a", "b", "tx", "ty")])
        else:
            rel = cam_homography(F.col("rot"), F.col("focal"), F.col("rot_other"), F.col("focal_other"))
        ties = ends.select(*SOURCE, "other", rel.alias("rel")).filter("rel is not null")
        buckets = max(1, -(-few["n"] // BUCKET_ROWS), -(-few["cells"] // BUCKET_CELLS))
        done = cut(_in_tasks(*[t.join(small, "set_id", "left_semi") for t in (observations, known, ties)], buckets,
                             spacing, sweeps, damping, smoothness, rigidity))
        meshes.append(done.select(*SOURCE, "cols", "ax", "ay"))
        told = done.filter("before is not null").groupBy("set_id").agg(F.max("before").alias("before"), F.max("after").alias("after"))
        metrics.append(told.select("set_id", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("rms")) for s in ("before", "after")])).alias("m")).select("set_id", "m.rms", "m.stage"))
    if few["large"] or few["n"] is None:
        large = sets.filter("not small").select("set_id")
        mesh, rms = _by_sweeps(*[t.join(large, "set_id", "left_semi") for t in (observations, known)], spacing, sweeps, damping, smoothness, rigidity, band_cells)
        meshes.append(mesh)
        metrics.append(rms)
    mesh, rms = meshes[0], metrics[0]
    for m, r in zip(meshes[1:], metrics[1:]):
        mesh, rms = mesh.unionByName(m), rms.unionByName(r)
    listed = mesh.select(*SOURCE, "cols", F.posexplode(F.arrays_zip("ax", "ay")).alias("at", "d"))
    spread = listed.select(*SOURCE, F.expr("cast(at div cols as int)").alias("vr"), F.expr("at % cols").alias("vc"), F.col("d.ax").alias("dx"), F.col("d.ay").alias("dy"))
    return spread, rms
