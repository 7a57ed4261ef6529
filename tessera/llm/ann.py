"""Approximate nearest neighbours by multiprobe p-stable hashing with exact reranking.

Each of ``TABLES`` tables projects a vector on ``HASHES`` Gaussian directions and cuts every projection into slots of one width; the slots name
the vector's bucket.  A query looks into its own bucket and into perturbed ones, in the order of their estimated success: a neighbour at
distance r lies in a slot with the probability that a normal law of deviation r around the query's projection gives that slot, and a
bucket has the product over its slots.  Buckets are visited until their probabilities add up to ``SUCCESS``.  Candidates of all tables are merged and
ranked by the exact distance on the given vectors.

The slot width and r are fitted on a bounded sample; all vectors are indexed.  A crowded bucket is dealt into parts of bounded size that are searched
apart and merged, so none is capped.  Of equal vectors only the k + 1 smallest keys can be among the k nearest of any query; the others are
left out before the index is built.  A query that found fewer than k candidates is compared with every vector.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.vectors import matrix, usable
from tessera.session import cut

TABLES, HASHES = 4, 6
SUCCESS = 0.5
#: Width of a slot in units of the neighbour distance r.
SLOT = 1.5
PART = 1024
#: The bounded sample of the fit, and the share of its queries whose neighbours lie within r.
FIT_ROWS, FIT_QUERIES, REACH = 4096, 128, 0.75
SEED = 20240607


class Index:
    """Directions, slot width and neighbour distance for vectors of one length."""

    def __init__(self, dim: int, radius: float, tables: int = TABLES, hashes: int = HASHES, slot: float = SLOT, success: float = SUCCESS):
        rng = np.random.default_rng(SEED + dim)
        self.tables, self.hashes, self.success = tables, hashes, success
        self.radius = radius
        self.width = slot * radius
        self.lines = rng.standard_normal((dim, tables * hashes))
        self.shift = rng.random(tables * hashes) * self.width

    def scaled(self, v: np.ndarray) -> np.ndarray:
        """Projections in slot widths: the floor is the slot."""
        return ((v @ self.lines + self.shift) / self.width).reshape(len(v), self.tables, self.hashes)

    def slots(self, v: np.ndarray) -> np.ndarray:
        return np.floor(self.scaled(v)).clip(-(1 << 30), 1 << 30).astype(np.int64)

    def probes(self, v: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(table, slots) of the buckets that one query visits, best first within each table."""
        where = self.scaled(v[None])[0]
        for t in range(self.tables):
            options = []
            for x in where[t]:
                x = min(max(x, -(1 << 30)), 1 << 30)
                base, sigma = math.floor(x), self.radius / self.width
                reach = 1 + math.ceil(3 * sigma)
                slot = sorted(((_between(s - x, s + 1 - x, sigma), s) for s in range(base - reach, base + reach + 1)), key=lambda o: (-o[0], o[1]))
                options.append([(-math.log(max(p, 1e-300)), p, s) for p, s in slot if p > 1e-6])
            total, seen = 0.0, {(0,) * self.hashes}
            heap = [(sum(o[0][0] for o in options), (0,) * self.hashes)]
            while heap and total < self.success:
                cost, at = heapq.heappop(heap)
                total += math.exp(-cost)
                yield t, [o[i][2] for o, i in zip(options, at)]
                for k in range(self.hashes):
                    if at[k] + 1 < len(options[k]) and (to := at[:k] + (at[k] + 1,) + at[k + 1:]) not in seen:
                        seen.add(to)
                        heapq.heappush(heap, (cost + options[k][to[k]][0] - options[k][at[k]][0], to))


def _between(a: float, b: float, sigma: float) -> float:
    return 0.5 * (math.erf(b / sigma / math.sqrt(2)) - math.erf(a / sigma / math.sqrt(2)))


def fit(rows: DataFrame, k: int, **options) -> dict[int, Index]:
    """dim -> index: r is the distance within which most rows have ``k`` neighbours, estimated from a bounded sample of at most ``FIT_ROWS`` rows.

    Rows of the sample have the smallest hashes of their keys; a vector length without two different rows there gets its own sample.
    """
    out = {}
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(16).collect()}
    for d, n in sizes.items():
        some = rows.filter(F.col("dim") == d).orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS).select("v").collect()
        v = np.array([r["v"] for r in some])
        v = v / max(np.abs(v).max(), 1e-300) if np.abs(v).max() > 1e100 else v
        q = v[:FIT_QUERIES]
        far = np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (v * v).sum(1) - 2 * q @ v.T))
        # of n rows k lie within r: so do k * sample / n of the sample, at least one, and the row itself
        place = min(len(v) - 1, max(1, round(k * len(v) / n)))
        each = np.partition(far, place, axis=1)[:, place]
        out[d] = Index(d, max(float(np.quantile(each, REACH)), 1e-9), **options)
    return out


def _hash(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """A bucket's number; buckets that share one only offer each other's vectors as more candidates."""
    h = table.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for c in range(slots.shape[1]):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + slots[:, c].astype(np.int64).view(np.uint64) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _buckets(rows: DataFrame, index: dict[int, Index]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at in _by_dim(batch, index):
                ix, part = index[d], batch.take(pa.array(at))
                s = ix.slots(matrix(part.column("v"), d))
                for t in range(ix.tables):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_hash(np.full(len(s), t), s[:, t]))], names=[*part.schema.names, "bucket"])

    return rows.select("key", "v", "dim").mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, v array<double>, dim int, bucket long")


def _visits(queries: DataFrame, index: dict[int, Index]) -> DataFrame:
    """key, dim, bucket: the buckets that each query visits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at in _by_dim(batch, index):
                part = batch.take(pa.array(at))
                for i, v in enumerate(matrix(part.column("v"), d)):
                    found = list(index[d].probes(v))
                    h = _hash(np.array([t for t, _ in found]), np.array([s for _, s in found]))
                    key = part.column("key").slice(i, 1).take(pa.array(np.zeros(len(h), np.int64)))
                    yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(h), d, np.int32)), pa.array(h)], names=["key", "dim", "bucket"])

    return queries.select("key", "v", "dim").mapInArrow(run, f"key {queries.schema['key'].dataType.simpleString()}, dim int, bucket long").distinct()


def _by_dim(batch: pa.RecordBatch, index: dict[int, Index]) -> Iterator[tuple[int, np.ndarray]]:
    dim = batch.column("dim").to_numpy()
    for d in np.unique(dim):
        if d in index:
            yield int(d), np.flatnonzero(dim == d)


def _search(met: DataFrame, k: int, part: int = PART) -> DataFrame:
    """Groups (dim, bucket, part) of vectors (side 0) followed by queries (side 1) -> the k nearest of each query in the group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, vs = None, [], []
        base = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            turn = np.zeros(batch.num_rows, bool)
            for c in cols:
                turn[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(turn).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cuts, cuts[1:]):
                now, side, d = tuple(int(c[a]) for c in cols[:3]), cols[3][a], int(cols[0][a])
                if now != group:
                    group, ids, vs, base = now, [], [], None
                keys, v = batch.column("key").slice(a, b - a).to_numpy(zero_copy_only=False), matrix(batch.column("v").slice(a, b - a), d)
                if side == 0:
                    ids.append(keys)
                    vs.append(v)
                elif ids:
                    if base is None:
                        base = np.concatenate(ids), np.concatenate(vs)
                    yield from _nearest(keys, v, *base, k)

    return met.select("dim", "bucket", "part", "side", "key", "v").mapInArrow(run, "query_id long, vec_id long, score double")


def _nearest(qk: np.ndarray, q: np.ndarray, ck: np.ndarray, c: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(q), 256):
        x = q[at:at + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            rough = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T
            edge = np.partition(rough, min(k, len(c) - 1), axis=1)[:, min(k, len(c) - 1)] if len(c) > k + 1 else np.full(len(x), np.inf)
            slack = 1e-9 * ((x * x).sum(1) + (c * c).sum(1).max())
            i, j = np.nonzero(~(rough > (edge + slack)[:, None]))
        far = np.sqrt(((x[i] - c[j]) ** 2).sum(axis=1))
        big = ~np.isfinite(far)
        if big.any():  # squares beyond the range of doubles
            d = x[i[big]] - c[j[big]]
            m = np.abs(d).max(axis=1)
            far[big] = m * np.sqrt(((d / m[:, None]) ** 2).sum(axis=1))
        own = qk[at + i] != ck[j]
        i, j, far = i[own], j[own], far[own]
        order = np.lexsort((ck[j], far, i))
        i, j, far = i[order], j[order], far[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < k
        yield pa.RecordBatch.from_arrays([pa.array(qk[at + i[top]]), pa.array(ck[j[top]]), pa.array(far[top])], names=["query_id", "vec_id", "score"])


def _meet(vectors: DataFrame, visits: DataFrame, queries: DataFrame, part: int, k: int) -> DataFrame:
    """vectors (key, v, dim, bucket) and visits (key, dim, bucket): search every visited bucket, crowded ones in parts."""
    sizes = cut(vectors.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")))
    placed = (vectors.join(sizes, ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
              .select("dim", "bucket", "part", F.lit(0).alias("side"), "key", "v"))
    asked = (visits.join(sizes, ["dim", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .join(queries.select("key", "v"), "key").select("dim", "bucket", "part", F.lit(1).alias("side"), "key", "v"))
    met = placed.unionByName(asked).repartition("dim", "bucket", "part").sortWithinPartitions("dim", "bucket", "part", "side")
    return _search(met, k, part)


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100, part: int = PART, **options) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each row whose key is divisible by ``every``, nearest first, ties to the smaller key.

    The score is the Euclidean distance of the given vectors.  Vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do
    rows with a null key; vectors of different lengths are no candidates of each other.  Rows that share a key are one vector, the
    least of them.  With fewer than k other vectors of its length a query gets them all; an empty table gives an empty result.  Other columns are ignored.
    """
    rows = cut(usable(vectors, key, vector).filter("key IS NOT NULL").groupBy(F.col("key").cast("long").alias("key"))
               .agg(F.min(F.struct("v", "dim")).alias("x")).select("key", "x.v", "x.dim"))
    few = Window.partitionBy("h").orderBy("key")
    needed = cut(rows.withColumn("h", F.struct(F.xxhash64("v"), F.xxhash64(F.reverse("v")))).withColumn("r", F.row_number().over(few))
                 .filter(F.col("r") <= k + 1).select("key", "v", "dim"))
    queries = cut(rows.filter(F.pmod("key", F.lit(every)) == 0))
    index = fit(needed, k, **options)
    found = _meet(_buckets(needed, index), _visits(queries, index), queries, part, k)
    first = cut(_best(found, k))
    sizes = needed.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    # queries that found too few see every vector of their length
    short = cut(queries.join(first.groupBy(F.col("query_id").alias("key")).agg(F.count(F.lit(1)).alias("got")), "key", "left")
                .join(sizes, "dim").filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("key", "v", "dim"))
    if not short.isEmpty():
        whole = _meet(needed.withColumn("bucket", F.lit(0).cast("long")), short.select("key", "dim", F.lit(0).cast("long").alias("bucket")), short, part, k)
        first = _best(first.select("query_id", "vec_id", "score").unionByName(whole), k)
    return first.select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
