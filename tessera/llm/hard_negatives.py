"""Hard negatives by inner product, found in cover trees over norm-augmented vectors.

A vector x becomes (x, sqrt(M^2 - |x|^2)) with M the largest norm of its block, and an anchor q becomes (q, 0): the farther apart the two are, the
smaller is their inner product.  So a node that covers its members with radius r around a centre c bounds all their products with q from
above and below, through d(q, c) - r and d(q, c) + r, and by <q, c> -+ |q| r.

Vectors are routed to the nearest of a few pivots - the top level of the tree, found greedily on a bounded sample, with radii taken over all
vectors - and the vectors of a pivot are dealt into blocks of bounded size, however many it has.  A block becomes one cover tree: the points that lie farther from a node's centre
than half its radius become centres of the next level, greedily, until a node is small or all its points are one.  Anchors visit the blocks of the
pivots that their bounds leave over.  In a block they go down level by level, skipping nodes outside all their windows and nodes of the wrong label,
and then take the leaves best bound first, verifying every member exactly, until no leaf left can reach what they have.

An anchor's positives are looked for around its own pivot first; the worst of them is the bound for all other pivots.  Then every positive opens a
window of scores for the negatives.

Vectors are taken as whole numbers floor(scale * x); products are exact.  Rows whose key, label or vector is null, or whose vector holds a
null or a number that is not finite, take no part.  Zero and empty vectors do.  Vectors of different length are not compared.  Every other row counts:
a repeated row takes as many places as it has copies, and an anchor row that is repeated is answered as often.  An anchor's positives are rows
of another key.  Ties go to the smaller key.  Scores beyond 64 bits count as the largest long once they leave their block, and
so do the windows that they open.
An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import matrix
from tessera.operators.spread import top_n
from tessera.session import cut, release

#: Components of the vectors of a block at most (2 MB), and so 4096 vectors of 64.
BLOCK_CELLS = 1 << 18
#: Anchors that meet a block at a time.
ANCHORS = 2048
#: Vectors that pivots are chosen from, pivots, and lengths of vectors that have any; others have one pivot, zero.
SAMPLE, PIVOTS, DIMS = 4096, 64, 4
LEAF = 16
#: Products of whole numbers are exact in doubles below this.
EXACT = float(1 << 53)
LONGEST = (1 << 63) - 1
BLOCK = ("dim", "pivot", "part")


def whole(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles where they hold it exactly with room to multiply, else Python's numbers."""
    with np.errstate(over="ignore"):
        w = np.floor(v * scale)
    if not w.size or np.abs(w).max() < 1 << 26:
        return w
    return np.array([[math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in row] for row in v.tolist()], dtype=object).reshape(v.shape)


def products(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows with one vector: doubles if safe, else Python's numbers."""
    if points.dtype != object and q.dtype != object and (not points.size or np.abs(points).max() * np.abs(q).max() * len(q) < EXACT):
        return points @ q
    big = [int(x) for x in q.tolist()]
    return np.array([sum(int(x) * y for x, y in zip(p, big)) for p in points.tolist()], dtype=object)


# --- the tree of a block ---------------------------------------------------------------------------

def cover_tree(points: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order, nodes): points in the order of the tree, and its nodes level by level with centre, start, end, radius, parent, leaf, label, level.

    A node's members are ``order[start:end]``; its label is theirs where they have one, and mixed tells where they do not.
    """
    n = len(points)
    order = np.zeros(n, np.int64)
    nodes: list[tuple] = []
    if points.dtype == object or (points.size and np.abs(points).max() ** 2 * points.shape[1] * 4 >= EXACT):
        return np.arange(n), _table([(0, 0, n, math.inf, -1, True, 0)], labels)
    norms = (points * points).sum(axis=1)
    lifted = np.column_stack([points, np.sqrt(norms.max(initial=0.0) - norms)])

    def far(of: int, members: np.ndarray) -> np.ndarray:
        gap = lifted[members] - lifted[of]
        return np.sqrt((gap * gap).sum(axis=1))

    level = [(0, np.arange(n), far(0, np.arange(n)), 0, -1)]
    depth = 0
    while level:
        below = []
        for centre, members, dist, start, parent in level:
            radius = float(dist.max(initial=0.0))
            at = len(nodes)
            small = len(members) <= leaf or radius == 0.0
            nodes.append((centre, start, start + len(members), radius, parent, small, depth))
            if small:
                order[start:start + len(members)] = members
                continue
            # the centre keeps what is near; what is left chooses further centres among itself
            near = dist <= radius / 2
            parts, rest = [(centre, members[near], dist[near])], members[~near]
            while len(rest):
                gap = far(rest[0], rest)
                near = gap <= radius / 2
                parts.append((rest[0], rest[near], gap[near]))
                rest = rest[~near]
            for c, m, d in parts:
                below.append((c, m, d, start, at))
                start += len(m)
        level, depth = below, depth + 1
    place = np.zeros(n, np.int64)
    place[order] = np.arange(n)
    return order, _table([(place[c], *rest) for c, *rest in nodes], labels[order])


def _table(nodes: list[tuple], labels: np.ndarray) -> dict[str, np.ndarray]:
    names = ("centre", "start", "end", "radius", "parent", "leaf", "level")
    t = {k: np.array(v) for k, v in zip(names, zip(*nodes))}
    first = labels[t["start"]] if len(labels) else np.zeros(len(nodes), np.int64)
    # a node has one label if no change of label falls within it
    turns = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])]) if len(labels) else np.zeros(1, np.int64)
    t["mixed"] = turns[np.maximum(t["end"] - 1, 0)] != turns[np.minimum(t["start"], len(turns) - 1)]
    t["label"] = first
    return t


def best_first(points: np.ndarray, ids: np.ndarray, labels: np.ndarray, nodes: dict[str, np.ndarray], q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray,
               windows: list[list[tuple[float, float]]], same: bool, most: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(anchor, window, [(score, id)]): the first ``most`` rows of each window of each anchor, with its label or with another.

    Windows are (lowest, highest) scores, both included; the smallest and the largest long stand for no bound.
    """
    windows = [[(-math.inf if a < -LONGEST else a, math.inf if b >= LONGEST else b) for a, b in some] for some in windows]
    wide = max(map(len, windows), default=0)
    low, high = np.full((len(q), wide), math.inf), np.full((len(q), wide), -math.inf)
    for i, some in enumerate(windows):
        for w, (a, b) in enumerate(some):
            low[i, w], high[i, w] = a, b
    leaves, upper = _leaves(points, nodes, q, q_labels, low, high, same)
    for i in range(len(q)):
        mine = leaves[i]
        todo = mine[np.argsort(-upper[i], kind="stable")]
        bound = np.sort(upper[i])[::-1]
        found: list[list[tuple[int, int]]] = [[] for _ in windows[i]]
        at, chunk = 0, 128
        while at < len(todo):
            need = min((max(a, held[-1][0]) if len(held) == most else a for (a, _), held in zip(windows[i], found)), default=math.inf)
            if bound[at] < need:
                break
            sizes = np.cumsum(nodes["end"][todo[at:]] - nodes["start"][todo[at:]])
            step = int(np.searchsorted(sizes, chunk)) + 1
            part, at, chunk = todo[at:at + step], at + step, chunk * 2
            members = np.concatenate([np.arange(a, b) for a, b in zip(nodes["start"][part].tolist(), nodes["end"][part].tolist())])
            members = members[(labels[members] == q_labels[i]) & (ids[members] != q_ids[i]) if same else labels[members] != q_labels[i]]
            score, of = products(points[members], q[i]), ids[members]
            for w, (a, b) in enumerate(windows[i]):
                fits = np.flatnonzero((score >= a) & (score <= b))
                if len(fits) > 4 * most and score.dtype != object:
                    # all that reach the k-th score stay, so ties are still decided by the key
                    fits = fits[score[fits] >= np.partition(score[fits], -most)[-most]]
                both = found[w] + [(int(s), int(k)) for s, k in zip(score[fits].tolist(), of[fits].tolist())]
                found[w] = sorted(both, key=lambda x: (-x[0], x[1]))[:most]
        for w, held in enumerate(found):
            if held:
                yield i, w, held


def _leaves(points, nodes, q, q_labels, low, high, same) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per anchor the leaves that windows and labels leave over, and what their members score at most; level by level."""
    m, count = len(q), len(nodes["level"])
    leaves: list[list[np.ndarray]] = [[] for _ in range(m)]
    upper: list[list[np.ndarray]] = [[] for _ in range(m)]
    if not math.isfinite(nodes["radius"][0]) or q.dtype == object or (q.size and np.abs(q).max() ** 2 * q.shape[1] * 4 >= EXACT):
        every = np.flatnonzero(nodes["leaf"])
        return [every] * m, [np.full(len(every), math.inf)] * m
    top = (points * points).sum(axis=1).max(initial=0.0)
    qq = (q * q).sum(axis=1)[:, None]
    norm = np.sqrt(qq)
    slack = 1e-6 * (qq + top) + 1e-6
    alive, before = np.ones((m, 1), bool), 0
    for depth in range(int(nodes["level"].max(initial=0)) + 1):
        at = np.flatnonzero(nodes["level"] == depth)
        keep = alive[:, nodes["parent"][at] - before] if depth else alive
        right = nodes["mixed"][at] | ((nodes["label"][at] == q_labels[:, None]) == same)
        keep = keep & right
        r = nodes["radius"][at]
        s = q @ points[nodes["centre"][at]].T
        d = np.sqrt(np.maximum(qq + top - 2 * s, 0.0))
        up = np.minimum((qq + top - np.maximum(d - r, 0.0) ** 2) / 2, s + norm * r) + slack
        down = np.maximum((qq + top - (d + r) ** 2) / 2, s - norm * r) - slack
        inside = np.zeros(keep.shape, bool)
        for w in range(low.shape[1]):
            inside |= (up >= low[:, w, None]) & (down <= high[:, w, None])
        keep &= inside
        end = nodes["leaf"][at]
        for i in range(m):
            hit = np.flatnonzero(keep[i] & end)
            leaves[i].append(at[hit])
            upper[i].append(up[i, hit])
        alive, before = keep, int(at[0]) if len(at) else count
    return [np.concatenate(x) for x in leaves], [np.concatenate(x) for x in upper]


# --- the index ---------------------------------------------------------------------------------------

def usable(vectors: DataFrame, key: str, vector: str, label: Column | str) -> DataFrame:
    """vec_id, label, v, dim of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), v.alias("v"), fine.alias("fine"))
    return rows.filter(F.col("fine") & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select("vec_id", "label", "v", F.size("v").alias("dim"))


def pivots(rows: DataFrame, scale: int) -> dict[int, np.ndarray]:
    """dim -> pivots: each time the vector of a bounded sample that lies farthest from all pivots so far."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dim", "v").collect()
    by: dict[int, list] = {}
    for r in some:
        by.setdefault(r["dim"], []).append(r["v"])
    out = {}
    for d, v in sorted(by.items(), key=lambda x: (-len(x[1]), x[0]))[:DIMS]:
        p = whole(np.array(v, float).reshape(len(v), d), scale)
        if p.dtype == object or not d:
            continue
        chosen, dist = [0], ((p - p[0]) ** 2).sum(axis=1)
        while len(chosen) < PIVOTS and dist.max() > 0:
            chosen.append(int(dist.argmax()))
            dist = np.minimum(dist, ((p - p[chosen[-1]]) ** 2).sum(axis=1))
        out[d] = p[chosen]
    return out


def _routed(rows: DataFrame, tops: dict[int, np.ndarray], scale: int) -> DataFrame:
    """Add the nearest pivot (0 where a length has none)."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            pivot = np.zeros(batch.num_rows, np.int32)
            for d in set(dim.tolist()) & set(tops):
                at = np.flatnonzero(dim == d)
                # any pivot is a right one for a vector, so huge numbers may be cut here
                v = np.clip(matrix(batch.column("v").take(pa.array(at)), d), -1e60, 1e60) * scale
                pivot[at] = ((tops[d] ** 2).sum(axis=1) - 2 * (v @ tops[d].T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot)], names=[*batch.schema.names, "pivot"])

    return rows.mapInArrow(route, f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, pivot int")


_TREE = "dim int, pivot int, part long, reach double, ids binary, labels binary, vectors binary, nodes binary"
_FIELDS = ("centre", "start", "end", "radius", "parent", "leaf", "level", "mixed", "label")


def _builder(tops: dict[int, np.ndarray], scale: int):
    def build(t: pa.Table) -> pa.Table:
        d = t["dim"][0].as_py()
        v = matrix(t["v"].combine_chunks(), d)
        w, ids, labels = whole(v, scale), t["vec_id"].to_numpy(), t["label"].to_numpy()
        order, nodes = cover_tree(w, labels)
        at = t["pivot"][0].as_py()
        # how far the vectors of this block reach from their pivot
        reach = float(np.sqrt(((w - tops[d][at]) ** 2).sum(axis=1).max())) if d in tops and w.dtype != object else math.inf
        packed = np.column_stack([nodes[f].astype(float) for f in _FIELDS])
        cells = [[d], [at], [t["part"][0].as_py()], [reach], [ids[order].astype(np.int64).tobytes()], [labels[order].astype(np.int64).tobytes()], [v[order].tobytes()], [packed.tobytes()]]
        names = [c.split()[0] for c in _TREE.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(cells, kinds)], names=names)

    return build


class Index:
    """Cover trees over all usable rows, one a block; written tables."""

    def __init__(self, rows: DataFrame, scale: int = 256, block_cells: int = BLOCK_CELLS) -> None:
        self.scale = scale
        self.tops = pivots(rows, scale)
        routed = cut(_routed(rows, self.tops, scale).withColumn("_salt", F.monotonically_increasing_id()))
        per = F.greatest(F.lit(1), F.floor(F.lit(block_cells) / F.greatest(F.col("dim"), F.lit(1))))
        self.parts = cut(routed.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("_n")).select("dim", "pivot", F.ceil(F.col("_n") / per).cast("bigint").alias("parts")))
        dealt = routed.join(self.parts, ["dim", "pivot"]).withColumn("part", F.pmod("_salt", "parts")).drop("_salt", "parts")
        self.trees = cut(dealt.groupBy(*BLOCK).applyInArrow(_builder(self.tops, scale), _TREE))
        release(routed)
        reach: dict[int, dict[int, float]] = {}
        for r in self.trees.filter(F.col("dim").isin([*self.tops, -1])).groupBy("dim", "pivot").agg(F.max("reach").alias("reach")).collect():
            reach.setdefault(r["dim"], {})[r["pivot"]] = r["reach"]
        self.reach = reach

    def visits(self, anchors: DataFrame, where: str) -> DataFrame:
        """Anchors (with windows ``lows``, ``highs``) once for each block that can hold rows in their windows; of ``where`` pivots: own, others or all."""
        tops, reach, scale = self.tops, self.reach, self.scale

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, to = [], []
                for i, (d, own, lows, highs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dim", "own", "lows", "highs")))):
                    if d not in tops:
                        some = [0] if where != "others" else []
                    elif where == "own":
                        some = [own]
                    else:
                        q = np.clip(matrix(batch.column("v").slice(i, 1), d), -1e60, 1e60)[0]
                        huge, q = np.abs(q).max() * scale >= 1 << 26, np.floor(q * scale)
                        s, r = tops[d] @ q, np.array([reach.get(d, {}).get(p, -math.inf) for p in range(len(tops[d]))])
                        room = math.sqrt(q @ q) * np.maximum(r, 0.0) * (1 + 1e-9) + 1e-6 * (1 + np.abs(s))
                        fits = np.zeros(len(s), bool)
                        for a, b in zip(lows, highs):
                            fits |= (s + room >= a) & (s - room <= b)
                        fits = (fits | ~np.isfinite(room) | huge) & (r > -math.inf)
                        if where == "others":
                            fits[own] = False
                        some = np.flatnonzero(fits).tolist()
                    rows += [i] * len(some)
                    to += some
                out = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(to, pa.int32())], names=[*out.schema.names, "pivot"])

        hits = anchors.mapInArrow(visit, f"{', '.join(f'{n} {t}' for n, t in anchors.dtypes)}, pivot int")
        return hits.join(self.parts, ["dim", "pivot"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")

    def search(self, anchors: DataFrame, groups: int, same: bool, most: int, where: str = "all") -> DataFrame:
        """aid, window, vec_id, score: the first ``most`` rows of each window in each block.

        ``anchors``: aid, vec_id, label, v, dim, own (pivot), lows, highs; at most ``groups`` groups of them meet a block, one after the other.
        """
        scale = self.scale
        kind = pa.schema([("aid", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

        def work(trees: pa.Table, met: pa.Table) -> pa.Table:
            out: list[list] = [[], [], [], []]
            if trees.num_rows and met.num_rows:
                d = trees["dim"][0].as_py()
                ids, labels = (np.frombuffer(trees[c][0].as_py(), np.int64) for c in ("ids", "labels"))
                points = whole(np.frombuffer(trees["vectors"][0].as_py()).reshape(len(ids), d), scale)
                packed = np.frombuffer(trees["nodes"][0].as_py()).reshape(-1, len(_FIELDS))
                nodes = {f: packed[:, k] if f == "radius" else packed[:, k].astype(bool if f in ("leaf", "mixed") else np.int64) for k, f in enumerate(_FIELDS)}
                for at in range(0, met.num_rows, 128):
                    part = met.slice(at, 128)
                    q = whole(matrix(part["v"].combine_chunks(), d), scale)
                    windows = [list(zip(a, b)) for a, b in zip(part["lows"].to_pylist(), part["highs"].to_pylist())]
                    aid = part["aid"].to_pylist()
                    for i, w, held in best_first(points, ids, labels, nodes, q, part["vec_id"].to_numpy(), part["label"].to_numpy(), windows, same, most):
                        for score, k in held:
                            for column, x in zip(out, (aid[i], w, k, max(-LONGEST, min(LONGEST, score)))):
                                column.append(x)
            return pa.table([pa.array(c, f.type) for c, f in zip(out, kind)], schema=kind)

        key = [*BLOCK, "group"]
        trees = self.trees.withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
        met = self.visits(anchors, where).withColumn("group", F.pmod(F.xxhash64("aid"), F.lit(groups)))
        return trees.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(work, "aid long, window int, vec_id long, score long")


def mine(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = 256, every: int = 100,
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose key is divisible by ``every``; their positives the first ``positives`` other rows of their label.  For each of
    these the first ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    rows = usable(vectors, key, vector, label)
    index = Index(rows, scale, block_cells)
    anchors = cut(_routed(rows.filter(F.col("vec_id") % every == 0), index.tops, scale).withColumnRenamed("pivot", "own").withColumn("aid", F.monotonically_increasing_id()))
    groups = max(1, -(-anchors.count() // ANCHORS))

    def window(a: Column, b: Column) -> list[Column]:
        return [F.array(a).alias("lows"), F.array(b).alias("highs")]

    order = [F.desc("score"), F.asc("vec_id")]
    least, most = F.lit(-LONGEST - 1), F.lit(LONGEST)
    near = cut(index.search(anchors.select("*", *window(least, most)), groups, True, positives, "own"))
    near = cut(top_n(near, ["aid"], order, positives))
    worst = near.groupBy("aid").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_s")).filter(F.col("_n") == positives)
    open_ = anchors.join(worst, "aid", "left").select(*anchors.columns, *window(F.coalesce("_s", least), most))
    far = index.search(open_, groups, True, positives, "others")
    best = cut(top_n(near.drop("rank").unionByName(far), ["aid"], order, positives, "_place").select("aid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # positives of one score share a window; bounds are whole numbers
    p, w = F.col("positive_score").cast("decimal(38,0)"), F.col("positive_score")
    bounds = best.select("aid", w, F.ceil(p * low / 100).cast("long").alias("a"), F.floor(p * high / 100).cast("long").alias("b")).distinct()
    listed = bounds.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("positive_score", "a", "b"))).alias("t"))
    asked = anchors.join(listed, "aid").select(*anchors.columns, F.col("t.a").alias("lows"), F.col("t.b").alias("highs"))
    found = index.search(asked, groups, False, negatives)
    first = top_n(found, ["aid", "window"], order, negatives)
    scores = listed.select("aid", F.posexplode("t.positive_score").alias("window", "positive_score"))
    return (best.join(scores, ["aid", "positive_score"]).join(first, ["aid", "window"]).join(anchors.select("aid", F.col("vec_id").alias("anchor_id")), "aid")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
