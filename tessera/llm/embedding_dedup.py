"""Near-duplicate vectors: tiles of vectors in PCA order, compared from the leading dimensions on.

Unit vectors are turned into the basis of their principal components, so that the first dimensions hold most of every product.  Two vectors whose
cosine reaches t are at most w = sqrt(2 - 2t) apart, and so in every coordinate: a grid of cells of side w over the first
coordinates puts each such pair into the same or a neighbouring cell.  Cells are cut into tiles of bounded size, and tiles of neighbouring
cells meet in one task.  There the products of the leading dimensions are accumulated first, together with the product of the norms of what
is left, which bounds what the other dimensions can add; pairs whose bound stays below t stop, the others go on a block of dimensions at a
time.  Pairs that come through are decided on the given vectors in double precision.

Equal vectors are compared once, as a class.  A pair of tiles returns the number of links of each vector and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.simhash import _settle
from tessera.llm.vectors import by_groups, matrix, usable
from tessera.operators.graph import connected_components
from tessera.session import cut

THRESHOLD = 0.95
TILE = 4096
GRID_DIMS = 2
LEAD = 16
#: Slack of the bounds against rounding; the decision itself has none.
SLACK = 1e-9
#: Principal axes are found for the most frequent vector lengths only; rarer lengths keep their own axes.
BASES = 4
#: A pair of tiles: cell and part of the one, cell and part of the other.
PAIR = ("px", "py", "pp", "qx", "qy", "qp")
_NO_ID = (1 << 63) - 1


def principal_axes(vectors: DataFrame, bases: int = BASES) -> dict[int, np.ndarray]:
    """dim -> axes by falling share of the second moments of all unit vectors (columns); sums of dim x dim numbers reach the driver."""
    dims = [r["dim"] for r in vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(bases).collect()]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {d: np.zeros((d, d)) for d in dims}
        for batch in batches:
            of = batch.column(1).to_numpy()
            for d in dims:
                v = matrix(batch.column(0).filter(pa.array(of == d)), d)
                if len(v):
                    v = _unit(v)
                    sums[d] += v.T @ v
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(list(m))], names=["dim", "i", "row"])

    parts = vectors.filter(F.col("dim").isin(dims)).select("v", "dim").mapInArrow(moments, "dim int, i int, row array<double>")
    sums = parts.select("dim", "i", F.posexplode("row").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).collect()
    total = {d: np.zeros((d, d)) for d in dims}
    for r in sums:
        total[r["dim"]][r["i"], r["j"]] = r["x"]
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in total.items()}


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1)[:, None]  # no overflow in the squares
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _placed(classes: DataFrame, axes: dict[int, np.ndarray], width: float, grid: int) -> DataFrame:
    """Add the grid cell (x, y) of each vector."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            cell = np.zeros((batch.num_rows, 2), np.int32)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                v = _unit(matrix(batch.column("v").take(pa.array(at)), int(d)))
                lead = (v @ axes[d] if d in axes else v)[:, :grid]
                cell[at, :lead.shape[1]] = np.floor(lead / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell[:, 0]), pa.array(cell[:, 1])], names=[*batch.schema.names, "x", "y"])

    return classes.mapInArrow(place, f"{', '.join(f'{n} {t}' for n, t in classes.dtypes)}, x int, y int")


def _tile_pairs(placed: DataFrame, tile: int) -> DataFrame:
    """dim, x, y, part, the columns of a pair, side: the tile pairs that each tile takes part in, once for each unordered pair."""
    cells = cut(placed.groupBy("dim", "x", "y").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts")))
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    near = cells.withColumn("s", F.explode(steps)).select("dim", "x", "y", "parts", (F.col("x") + F.col("s.dx")).alias("x2"), (F.col("y") + F.col("s.dy")).alias("y2"))
    met = near.join(cells.select("dim", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("parts").alias("parts2")), ["dim", "x2", "y2"])
    met = (met.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("p2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
           .filter((F.col("x") != F.col("x2")) | (F.col("y") != F.col("y2")) | (F.col("p") <= F.col("p2"))))
    met = met.select("dim", *[F.col(a).alias(b) for a, b in zip(("x", "y", "p", "x2", "y2", "p2"), PAIR)], "x", "y", "p", "x2", "y2", "p2")
    same = (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")) & (F.col("p") == F.col("p2"))
    return (met.select("dim", "x", "y", F.col("p").alias("part"), *PAIR, F.lit(0).alias("side"))
            .unionByName(met.filter(~same).select("dim", F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("p2").alias("part"), *PAIR, F.lit(1).alias("side"))))


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float, lead: int = LEAD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of two tiles whose cosine reaches the threshold, a block of rows at a time."""
    ua, ub = _unit(a), _unit(b)
    ra, rb = (ua @ axes, ub @ axes) if axes is not None else (ua, ub)
    d = a.shape[1]
    steps = list(range(lead, d, lead)) or [d]

    def rest(x: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt((x[:, k:] ** 2).sum(axis=1))

    k = steps[0]
    # one product gives the leading part plus the bound of what is left
    la, lb = np.column_stack([ra[:, :k], rest(ra, k)]), np.column_stack([rb[:, :k], rest(rb, k)])
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    plain = np.isfinite(na).all() and np.isfinite(nb).all() and na.min(initial=1) > 1e-150 and nb.min(initial=1) > 1e-150
    tails = [(k2, rest(ra, k2), rest(rb, k2)) for k2 in steps[1:]]
    for at in range(0, len(a), 512):
        i, j = np.nonzero(la[at:at + 512] @ lb.T >= threshold - SLACK)
        i += at
        for low in range(0, len(i), 1 << 16):
            p, q = i[low:low + (1 << 16)], j[low:low + (1 << 16)]
            part, done = (ra[p, :k] * rb[q, :k]).sum(axis=1), k
            for k2, ta, tb in tails:
                part = part + (ra[p, done:k2] * rb[q, done:k2]).sum(axis=1)
                go = part + ta[p] * tb[q] >= threshold - SLACK
                p, q, part, done = p[go], q[go], part[go], k2
            cosine = (a[p] * b[q]).sum(axis=1) / (na[p] * nb[q]) if plain else (ua[p] * ub[q]).sum(axis=1)
            hit = cosine >= threshold
            yield p[hit], q[hit]


def _tile_work(axes: dict[int, np.ndarray], threshold: float):
    def work(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        d = key[0]
        side = t.column("side").to_numpy()
        v = matrix(t.column("v").combine_chunks(), d)
        low, h, n = (t.column(c).to_numpy() for c in ("low", "h", "n"))
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        own = key[1:4] == key[4:7]
        if own:
            right = left
        count, label = np.zeros(len(v), np.int64), np.arange(len(v))
        if len(left) and len(right):
            for p, q in linked(v[left], v[right], axes.get(d), threshold):
                i, j = left[p], right[q]
                if own:
                    i, j = i[p < q], j[p < q]
                np.add.at(count, i, n[j])
                np.add.at(count, j, n[i])
                label = _settle(label, i, j)
        hit = np.flatnonzero(count)
        if len(hit):
            to = label[hit]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (low[hit], h[hit], count[hit], low[to], h[to])], names=["low", "h", "links", "low2", "h2"])

    return work


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """key, n_links (other rows linked directly), component_id (smallest key reachable, itself included), kept, one row per row.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, and vectors of different lengths do not link.  Equal vectors
    link.  Rows with a null key are linked and counted too; their component has the smallest key of the others, or null, and they are not kept
    unless their component is null.  Repeated rows count as separate vectors.  An empty table gives an empty result; other columns are ignored.
    """
    rows = cut(usable(vectors, key, vector).withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.reverse("v"))))
    classes = cut(rows.groupBy("h", "g", "dim").agg(F.first("v").alias("v"), F.coalesce(F.min("key"), F.lit(_NO_ID)).cast("long").alias("low"),
                                                    F.count(F.lit(1)).alias("n")))
    axes = principal_axes(classes)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) * (1 + 1e-6) + 1e-6
    placed = cut(_placed(classes.select("h", "g", "low", "n", "dim", "v"), axes, width, GRID_DIMS))
    tiles = cut(_tile_pairs(placed, tile))
    parts = tiles.groupBy("dim", "x", "y").agg((F.max("part") + 1).alias("parts"))
    dealt = (placed.join(parts, ["dim", "x", "y"]).withColumn("part", F.pmod(F.col("g"), F.col("parts")).cast("int"))
             .join(tiles, ["dim", "x", "y", "part"]).select("dim", *PAIR, "side", "v", "low", "h", "n"))
    met = dealt.repartition("dim", *PAIR).sortWithinPartitions("dim", *PAIR, "side")
    found = cut(by_groups(met, 7, "low long, h long, links long, low2 long, h2 long", _tile_work(axes, threshold)))
    links = found.groupBy("low", "h").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.struct("low", "h").alias("a"), F.struct(F.col("low2").alias("low"), F.col("h2").alias("h")).alias("b")))
    named = joined.select(F.col("node.low").alias("low"), F.col("node.h").alias("h"), F.col("component.low").alias("first"))
    known = (classes.select("h", "g", "dim", "low", "n").join(links, ["low", "h"], "left").join(named, ["low", "h"], "left")
             .select("h", "g", "dim", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.nullif(F.coalesce("first", "low"), F.lit(_NO_ID)).alias("component")))
    good = rows.join(known, ["h", "g", "dim"]).select(F.col("key").alias(key), "n_links", F.col("component").alias("component_id"))
    bad = usable(vectors, key, vector, False).select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").cast("long").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
