"""Connected components, groups and growth order of a pair graph."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.operators.spread import dense_index
from tessera.session import cut, release


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, and a fingerprint of their set taken while they were."""
    seen = Observation()
    told = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    out = cut(told)
    return out, (seen.get["n"], seen.get["h"])


def join_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest reachable node of each of ``n`` nodes under the links a - b, for a graph that fits a task."""
    low = np.arange(n)
    while len(a):
        la, lb = low[a], low[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(low, np.maximum(la, lb), np.minimum(la, lb))
        while ((jump := low[low]) != low).any():
            low = jump
    return low


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b",
                         max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node of its component.

    Alternates two star rewirings of the edge set until it stops changing.  Edges run from a larger node u to a smaller v.  The first hangs u
    onto the smallest neighbour of v; the second hangs all smaller neighbours of u onto the smallest of them.  Every step is a MIN per
    node, which combines before the shuffle, and a join back.  Minima are written before they are joined, so both sides of a
    join are dealt anew and Spark can split a node with very many edges.  The number of rounds grows with the logarithm of the longest
    path.  Result: node, component.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    e, seen = _written(e.filter("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).select("u", "v").distinct())
    for _ in range(max_rounds):
        low = cut(e.groupBy("u").agg(F.min("v").alias("m")))
        large = cut(e.join(low.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        floor = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(floor.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        last, (e, now) = e, _written(small)
        release(last, low, large, floor)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return (nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left")
            .select("node", F.coalesce("component", "node").alias("component")))


def set_components(pairs: DataFrame) -> DataFrame:
    """Components of source pairs within their sets: set_id, source_id, component."""
    keyed = pairs.select(F.struct("set_id", F.col("a").alias("source_id")).alias("a"),
                         F.struct("set_id", F.col("b").alias("source_id")).alias("b"))
    cc = connected_components(keyed)
    return cc.select(F.col("node.set_id").alias("set_id"), F.col("node.source_id").alias("source_id"),
                     F.col("component.source_id").alias("component"))


def add_pairs(components: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored components after further pairs: set_id, source_id, component, as ``set_components`` of all pairs has them.

    Each end of a pair stands for its stored component, or for itself if it is new, so only the labels that the pairs touch are contracted, and stored
    rows are renamed by one join.  A label is the smallest source of its component, hence so is the smallest label of those that meet.  Pairs
    may repeat stored ones or each other, and may join a source to itself.  Rows with a null key have no effect.  With no pairs the components stay as they are.
    """
    new = pairs.select("set_id", "a", "b").dropna()
    ends = new.select("set_id", F.col("a").alias("source_id")).union(new.select("set_id", "b")).distinct()
    known = components.select("set_id", "source_id", "component").dropna()
    touched = cut(ends.join(known, ["set_id", "source_id"], "left").withColumn("_new", F.col("component").isNull())
                  .withColumn("component", F.coalesce("component", "source_id")))
    links = new
    for end in ("a", "b"):
        label = touched.select("set_id", F.col("source_id").alias(end), F.col("component").alias(f"_{end}"))
        links = links.join(label, ["set_id", end])
    links = links.select("set_id", F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
    moved = cut(set_components(links).select("set_id", F.col("source_id").alias("component"), F.col("component").alias("_to")))
    rows = known.unionByName(touched.filter("_new").select(*known.columns))
    return (rows.join(moved.filter("component <> _to"), ["set_id", "component"], "left")
            .select("set_id", "source_id", F.coalesce("_to", "component").alias("component")))


def assemble_groups(pairs: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Groups of at least two connected sources, numbered from 1 by size, then by first member.

    Long form, one row per member: set_id, group_id, source_id, component, size, n_pairs.
    """
    cc = components if components is not None else set_components(pairs)
    sizes = cc.groupBy("set_id", "component").agg(F.count(F.lit(1)).alias("size"))
    edges = (pairs.join(cc, (pairs.set_id == cc.set_id) & (pairs.a == cc.source_id))
             .groupBy(cc.set_id, "component").agg(F.count(F.lit(1)).alias("n_pairs")))
    kept = sizes.filter("size >= 2").join(edges, ["set_id", "component"])
    numbered = dense_index(kept, ["set_id"], [F.desc("size"), F.asc("component")], "_pos")
    groups = numbered.withColumn("group_id", F.col("_pos") + 1).drop("_pos")
    return cc.join(groups, ["set_id", "component"]).select(
        "set_id", "group_id", "source_id", "component", "size", "n_pairs")


def unplaced(sources: DataFrame, groups: DataFrame) -> DataFrame:
    return sources.join(groups.select("set_id", "source_id"), ["set_id", "source_id"], "left_anti")


def choose_model(pano_groups: DataFrame, strip_groups: DataFrame, spread: DataFrame,
                 moved_m: float = 15.0) -> DataFrame:
    """Per set: 'strip' if its largest group is bigger, or on a tie if the positions moved."""
    best = [g.groupBy("set_id").agg(F.max("size").alias(n))
            for g, n in ((pano_groups, "pano_best"), (strip_groups, "strip_best"))]
    both = (best[0].join(best[1], "set_id", "full")
            .join(spread.select("set_id", "spread"), "set_id", "left"))
    pano = F.coalesce("pano_best", F.lit(0))
    strip = F.coalesce("strip_best", F.lit(0))
    moved = (strip == pano) & (F.coalesce("spread", F.lit(0.0)) >= moved_m)
    return both.select("set_id", pano.alias("pano_best"), strip.alias("strip_best"), "spread",
                       F.when((strip > pano) | moved, "strip").otherwise("panorama").alias("model"))


_ORDER = "set_id bigint, component bigint, source_id bigint, step bigint"


def strongest_forest(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs of the strongest spanning forest of each key's graph: keys, a, b, n_inliers; ties go to the lowest pair.

    Boruvka's rounds: every component takes the strongest pair that leaves it - a MIN per component, combined before the shuffle - the components so
    joined become one, and pairs within one go.  A round at least halves the components that still have pairs, and no task sees a whole graph.
    """
    live, taken = cut(edges.select(*keys, "a", "b", "n_inliers", F.col("a").alias("ca"), F.col("b").alias("cb"))), []
    while True:
        pair = F.struct((-F.col("n_inliers")).alias("n"), "a", "b", "ca", "cb").alias("e")
        best = live.select(*keys, F.explode(F.array("ca", "cb")).alias("c"), pair).groupBy(*keys, "c").agg(F.min("e").alias("e"))
        chosen = cut(best.select(*keys, "e.a", "e.b", (-F.col("e.n")).alias("n_inliers"), "e.ca", "e.cb").distinct())
        taken.append(chosen.select(*keys, "a", "b", "n_inliers"))
        if chosen.isEmpty():
            release(live)
            break
        met = chosen.select(F.struct(*keys, F.col("ca").alias("c")).alias("a"), F.struct(*keys, F.col("cb").alias("c")).alias("b"))
        label = cut(connected_components(met).select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.c").alias("c"), F.col("component.c").alias("to")))
        moved = live
        for end in ("ca", "cb"):
            moved = moved.join(label.withColumnRenamed("c", end), [*keys, end]).drop(end).withColumnRenamed("to", end)
        last, live = live, cut(moved.filter("ca <> cb").select(*live.columns))
        release(last, label)
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def _grow(t: pa.Table) -> pa.Table:
    """Order of growth along the strongest spanning tree of a group; pairs are known by their place in the order of strength."""
    a, b, n = (t[c].to_numpy() for c in ("a", "b", "n_inliers"))
    order = np.lexsort((b, a, -n))
    nodes, at = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    ends = np.concatenate([left, right])
    by_node = np.argsort(ends, kind="stable")
    start = np.searchsorted(ends[by_node], np.arange(len(nodes) + 1)).tolist()
    touching = (by_node % len(a)).tolist()
    seen = np.zeros(len(nodes), bool)
    placed, open_ = [], [0]
    # the strongest pair of all seeds the group, its lower source first
    for node in (int(left[0]), int(right[0])):
        seen[node] = True
        placed.append(node)
        open_ += touching[start[node]:start[node + 1]]
    heapq.heapify(open_)
    while open_:
        pair = heapq.heappop(open_)
        for node in (int(left[pair]), int(right[pair])):
            if not seen[node]:
                seen[node] = True
                placed.append(node)
                for other in touching[start[node]:start[node + 1]]:
                    heapq.heappush(open_, other)
    k = len(placed)
    return pa.table({"set_id": pa.repeat(t["set_id"][0], k), "component": pa.repeat(t["component"][0], k), "source_id": pa.array(nodes[placed]),
                     "step": pa.array(range(k), pa.int64())})


def placement_order(pairs: DataFrame, components: DataFrame | None = None, chunk: int = 200_000) -> DataFrame:
    """Order in which the sources of a group are placed.

    The pair with most inliers seeds its group (lower source first); then always the unplaced
    source with most inliers to any placed one (ties: lowest pair).

    Growth only ever uses pairs of the strongest spanning tree.  So a group of more than ``chunk`` pairs is first thinned to its tree (``strongest_forest``), and
    the task that orders a group takes one pair a source at most.
    """
    key = ["set_id", "component"]
    cc = components if components is not None else set_components(pairs)
    edges = cut(pairs.join(cc.withColumnRenamed("source_id", "a"), ["set_id", "a"])
                .select(*key, "a", "b", F.col("n_inliers").cast("bigint").alias("n_inliers")))
    large = cut(edges.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk).select(*key))
    if not large.isEmpty():
        trees = strongest_forest(edges.join(large, key, "left_semi"), key)
        edges = edges.join(large, key, "left_anti").unionByName(trees)
    return edges.groupBy(*key).applyInArrow(_grow, _ORDER)


def recognize_report(groups: DataFrame, pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """Report rows: one per group, member, verified pair and unmatched source.

    set_id, group_id, kind, a, b, n, text.  Members stay rows, so a group of any size fits.
    """
    names = sources.select("set_id", "source_id", "name")
    heads = (groups.select("set_id", "group_id", "size", "n_pairs").distinct()
             .select("set_id", "group_id", F.lit("group").alias("kind"),
                     F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"),
                     F.col("size").alias("n"),
                     F.format_string("group %d: %d sources, %d pairs", "group_id", "size", "n_pairs")
                     .alias("text")))
    members = (groups.join(names, ["set_id", "source_id"])
               .select("set_id", "group_id", F.lit("member").alias("kind"), F.col("source_id").alias("a"),
                       F.lit(None).cast("bigint").alias("b"), F.lit(1).cast("bigint").alias("n"),
                       F.col("name").alias("text")))
    na = names.select("set_id", F.col("source_id").alias("a"), F.col("name").alias("_na"))
    nb = names.select("set_id", F.col("source_id").alias("b"), F.col("name").alias("_nb"))
    links = (pairs.select("set_id", "a", "b", "n_inliers").join(na, ["set_id", "a"]).join(nb, ["set_id", "b"])
             .join(groups.select("set_id", F.col("source_id").alias("a"), "group_id"), ["set_id", "a"])
             .select("set_id", "group_id", F.lit("pair").alias("kind"), "a", "b",
                     F.col("n_inliers").alias("n"),
                     F.format_string("%s <-> %s: %d inliers", "_na", "_nb", "n_inliers").alias("text")))
    alone = (unplaced(names, groups)
             .select("set_id", F.lit(None).cast("bigint").alias("group_id"), F.lit("unmatched").alias("kind"),
                     F.col("source_id").alias("a"), F.lit(None).cast("bigint").alias("b"),
                     F.lit(0).cast("bigint").alias("n"), F.col("name").alias("text")))
    return heads.unionByName(members).unionByName(links).unionByName(alone)
