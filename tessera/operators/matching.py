"""Nearest-neighbour matching of unit vectors between the sources of a set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.spread import top_n, unordered_block_pairs

MIN_SECOND_SQ = 1e-7
MANY, FEW = 4096, 0.1
#: Dot products that a task holds at a time (8 MB).
DOTS_AT_ONCE = 1_000_000
_HITS = "set_id bigint, a bigint, fa bigint, b bigint, fb bigint, dot double"


def full_search(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
    """Largest and second largest dot product of each query with the vectors, and their positions; equal ones by position.  A second that is missing is -inf."""
    dots, at = queries @ vectors.T, np.arange(len(queries))
    first = dots.argmax(axis=1)
    best = dots[at, first]
    if len(vectors) == 1:
        return best, np.full(len(at), -np.inf), first, first
    dots[at, first] = -np.inf
    second = dots.argmax(axis=1)
    return best, dots[at, second], first, second


class Cells:
    """Unit vectors dealt to the nearest of about 2 sqrt(n) pivots, each the one farthest from the pivots before it; a cell knows how far it reaches.

    ``two_nearest`` visits cells from near to far and leaves out those whose vectors, by the triangle inequality, lie farther than the
    second nearest vector known so far, so its result is that of a search of all vectors.  ``met`` of ``all`` dot products are worked out.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.met, self.all = vectors, 0, 0
        chosen, nearest, cell = [0], vectors @ vectors[0], np.zeros(len(vectors), dtype=np.int64)
        for k in range(1, int(np.ceil(2 * np.sqrt(len(vectors))))):
            chosen.append(int(nearest.argmin()))
            to = vectors @ vectors[chosen[-1]]
            cell[to > nearest] = k
            np.maximum(nearest, to, out=nearest)
        self.pivots = vectors[chosen]
        order = np.argsort(cell, kind="stable")
        starts = np.searchsorted(cell[order], np.arange(len(chosen) + 1))
        self.rows = [order[lo:hi] for lo, hi in zip(starts[:-1], starts[1:])]
        self.sizes = np.diff(starts)
        away = _chord(nearest)
        self.radius = np.array([away[r].max() if len(r) else -np.inf for r in self.rows])

    def share(self, queries: np.ndarray) -> float:
        """Share of the vectors that bounds leave over for these queries once their second nearest is known."""
        reach = _chord(full_search(queries, self.vectors)[1])
        open_cells = _chord(queries @ self.pivots.T) - self.radius <= reach[:, None]
        return float((open_cells @ self.sizes).mean()) / len(self.vectors)

    def two_nearest(self, queries: np.ndarray) -> tuple[np.ndarray, ...]:
        """The result of ``full_search``."""
        m = len(queries)
        best, runner = np.full(m, -np.inf), np.full(m, -np.inf)
        first, second = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        self.all += m * len(self.vectors)
        to_pivot = queries @ self.pivots.T
        bound = _chord(to_pivot) - self.radius[None, :]
        home = to_pivot.argmax(axis=1)
        order = np.argsort(home, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            least = bound[group].min(axis=0)
            for c in np.argsort(least, kind="stable"):
                # a little more than the rounding of a dot product
                reach = _chord(runner[group]) + 1e-6
                if least[c] > reach.max():
                    break
                near = group[bound[group, c] <= reach]
                rows = self.rows[c]
                if not len(near) or not len(rows):
                    continue
                dots = queries[near] @ self.vectors[rows].T
                self.met += dots.size
                at = np.arange(len(near))
                for _ in range(min(2, len(rows))):
                    col = dots.argmax(axis=1)
                    d, who = dots[at, col], rows[col]
                    dots[at, col] = -np.inf
                    lead = (d > best[near]) | ((d == best[near]) & (who < first[near]))
                    behind = ~lead & ((d > runner[near]) | ((d == runner[near]) & (who < second[near])))
                    to, by = near[lead], near[behind]
                    runner[to], second[to] = best[to], first[to]
                    best[to], first[to] = d[lead], who[lead]
                    runner[by], second[by] = d[behind], who[behind]
        return best, runner, first, second


def cells_worth_it(vectors: np.ndarray, queries: np.ndarray) -> Cells | None:
    """Cells of the vectors if there is enough to compare and some of the queries show that bounds leave over few of them.  Either way of search gives the same rows."""
    if len(vectors) < MANY or len(queries) < MANY:
        return None
    cells = Cells(vectors)
    return cells if cells.share(queries[::max(1, len(queries) // 64)]) < FEW else None


def _chord(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dot, 0))


def _block_matcher(ratio: float):
    """Top-2 partners of every row of one block in every later source of the other block."""

    def unpack(table: pa.Table) -> tuple[np.ndarray, ...]:
        source = table["source_id"].to_numpy()
        feature = table["feature_id"].to_numpy()
        order = np.lexsort((feature, source))
        flat = table["descriptor"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.astype(np.float64).reshape(len(source), -1)
        whole = table["_whole"].to_numpy(zero_copy_only=False)
        return source[order], feature[order], vectors[order], whole[order]

    def one_way(left, right, out):
        src_l, feat_l, vec_l, _ = left
        src_r, feat_r, vec_r, whole_r = right
        starts = np.unique(src_r, return_index=True)[1]
        for lo, hi in zip(starts, [*starts[1:], len(src_r)]):
            n_left = int(np.searchsorted(src_l, src_r[lo], side="left"))
            if not n_left:
                continue
            cells = cells_worth_it(vec_r[lo:hi], vec_l[:n_left])
            batch = 4096 if cells else max(1, DOTS_AT_ONCE // int(hi - lo))
            for top in range(0, n_left, batch):
                rows = slice(top, min(top + batch, n_left))
                best, runner, first, second = cells.two_nearest(vec_l[rows]) if cells else full_search(vec_l[rows], vec_r[lo:hi])
                keep = np.ones(len(best), dtype=bool)
                if whole_r[lo]:
                    d1, d2 = np.maximum(2 - 2 * best, 0), np.maximum(2 - 2 * runner, 0)
                    keep = np.isfinite(runner) & (d2 > MIN_SECOND_SQ) & (d1 < ratio * ratio * d2)
                for partner, dot in ((first, best), (second, runner)):
                    ok = keep & np.isfinite(dot)
                    out.append((src_l[rows][ok], feat_l[rows][ok],
                                np.full(int(ok.sum()), src_r[lo]), feat_r[lo:hi][partner[ok]], dot[ok]))

    def match(table: pa.Table) -> pa.Table:
        own = table["_group"].to_numpy()
        lo, hi = table["_lo"][0].as_py(), table["_hi"][0].as_py()
        left = unpack(table.filter(pa.array(own == lo)))
        out: list[tuple] = []
        if lo == hi:
            one_way(left, left, out)
        else:
            right = unpack(table.filter(pa.array(own == hi)))
            one_way(left, right, out)
            one_way(right, left, out)
        cols = [np.concatenate([o[i] for o in out]) if out else np.array([]) for i in range(5)]
        set_id = np.full(len(cols[0]), table["set_id"][0].as_py(), dtype=np.int64)
        ints = [pa.array(c.astype(np.int64)) for c in cols[:4]]
        return pa.table([pa.array(set_id), *ints, pa.array(cols[4].astype(np.float64))],
                        names=["set_id", "a", "fa", "b", "fb", "dot"])

    return match


def match_2nn(features: DataFrame, ratio: float = 0.8, chunk: int | None = None, block: int = 16384) -> DataFrame:
    """Ratio-tested best match of every feature in every later source of its set.

    ``features``: set_id, source_id, feature_id, descriptor (unit length).  Result: set_id, a, b,
    fa, fb, distance, with a < b.  A match needs a second-nearest vector in ``b`` that is not
    identical (d2^2 > 1e-7) and a nearest with d1 < ratio * d2.

    Sources are split into chunks (by default of ``block`` rows, so most stay whole) and chunks hashed into groups of about ``block``
    rows; every pair of groups is one bounded block.  In a block the vectors of a source lie in cells around pivots, and a cell farther
    away than the second nearest vector known so far is not compared.  Only the two best partners per (feature, other source) leave a
    block, and for sources that fit one chunk only those that already pass the ratio test.
    """
    chunk = chunk or block
    per_source = features.groupBy("set_id", "source_id").agg(F.count(F.lit(1)).alias("_n"))
    per_set = per_source.groupBy("set_id").agg(F.ceil(F.sum("_n") / block).cast("bigint").alias("_groups"))
    sized = (features.select("set_id", "source_id", "feature_id", "descriptor")
             .join(per_source, ["set_id", "source_id"])
             .join(per_set, "set_id"))
    chunks = F.ceil(F.col("_n") / chunk)
    placed = (sized
              .withColumn("_whole", F.col("_n") <= chunk)
              .withColumn("_chunk", F.pmod(F.xxhash64("feature_id"), chunks))
              .withColumn("_group", F.pmod(F.xxhash64("source_id", "_chunk"), F.col("_groups"))))
    blocks = unordered_block_pairs(placed.drop("_n", "_chunk"), "_group", F.col("_groups"))
    hits = blocks.groupBy("set_id", "_lo", "_hi").applyInArrow(_block_matcher(ratio), _HITS)
    best = Window.partitionBy("set_id", "a", "fa", "b").orderBy(F.desc("dot"), F.asc("fb"))
    ranked = (hits.withColumn("_rank", F.row_number().over(best)).filter("_rank <= 2")
              .withColumn("_runner", F.lead("dot").over(best)))
    d1 = F.greatest(2 - 2 * F.col("dot"), F.lit(0.0))
    d2 = F.greatest(2 - 2 * F.col("_runner"), F.lit(0.0))
    return (ranked.filter((F.col("_rank") == 1) & (d2 > MIN_SECOND_SQ) & (d1 < ratio * ratio * d2))
            .select("set_id", "a", "b", "fa", "fb", F.sqrt(d1).alias("distance")))


def match_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("set_id", "a", "b").agg(F.count(F.lit(1)).alias("n_matches"))


def match_points(matches: DataFrame, features: DataFrame) -> DataFrame:
    """Coordinates of both ends of every match: set_id, a, b, fa, fb, xa, ya, xb, yb."""
    left = features.select("set_id", F.col("source_id").alias("a"), F.col("feature_id").alias("fa"),
                           F.col("x").alias("xa"), F.col("y").alias("ya"))
    right = features.select("set_id", F.col("source_id").alias("b"), F.col("feature_id").alias("fb"),
                            F.col("x").alias("xb"), F.col("y").alias("yb"))
    return (matches.select("set_id", "a", "b", "fa", "fb")
            .join(left, ["set_id", "a", "fa"]).join(right, ["set_id", "b", "fb"])
            .select("set_id", "a", "b", "fa", "fb", "xa", "ya", "xb", "yb"))


def candidate_pairs(counts: DataFrame, m: int = 6, min_count: int = 4) -> DataFrame:
    """Pairs that either end lists among its ``m`` fullest neighbours.

    The ``min_count`` rule is applied after the cut to ``m``; ties go to the lower neighbour.
    """
    ends = [counts.select("set_id", F.col(s).alias("source_id"), F.col(o).alias("other"), "n_matches")
            for s, o in (("a", "b"), ("b", "a"))]
    listed = top_n(ends[0].unionByName(ends[1]), ["set_id", "source_id"],
                   [F.desc("n_matches"), F.asc("other")], m)
    return (listed.filter(F.col("n_matches") >= min_count)
            .select("set_id", F.least("source_id", "other").alias("a"),
                    F.greatest("source_id", "other").alias("b"), "n_matches")
            .distinct())


def feature_summary(features: DataFrame) -> DataFrame:
    return features.groupBy("set_id", "source_id").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.min("scale").alias("min_scale"), F.max("scale").alias("max_scale"))


def top_k_response(features: DataFrame, n: int | None) -> DataFrame:
    """Strongest ``n`` features of every source by absolute response; all of them for None."""
    if n is None:
        return features
    return top_n(features, ["set_id", "source_id"],
                 [F.abs(F.col("response")).desc(), F.asc("feature_id")], n, "_rank").drop("_rank")


def match_report(matches: DataFrame, pairs: DataFrame, inliers: DataFrame) -> DataFrame:
    """One row per putative match: its pair's verdict and whether the model explains it."""
    flagged = inliers.select("set_id", "a", "b", "fa", "fb").withColumn("_in", F.lit(True))
    verdicts = pairs.select("set_id", "a", "b", "n_matches", "n_inliers", "n_overlap", "threshold", "verified")
    return (matches.join(verdicts, ["set_id", "a", "b"], "left")
            .join(flagged, ["set_id", "a", "b", "fa", "fb"], "left")
            .withColumn("role", F.when(F.col("_in"), "inlier").otherwise("outlier"))
            .withColumn("verdict", F.when(F.col("verified"), "verified")
                        .when(F.col("verified").isNull(), "no model").otherwise("rejected"))
            .drop("_in", "verified"))
