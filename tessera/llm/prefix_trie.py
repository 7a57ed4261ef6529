"""The trie of conversation prefixes, summed up by the Euler-tour technique.

A node is a distinct sequence of first turns; its members are the conversations that begin with it.  Turns are hashed together with their
depth, so the running sum of those hashes (120 bits, summed as decimals) names a prefix, and a parent's name is the node's less its last turn.

Subtrees are summed without walking the trie.  Every node becomes two arcs, one that enters it and one that leaves it; each arc knows the next
one of the tour: a node's first child, its next sibling, or its parent's exit.  The tour is list-ranked distributedly: chains of arcs within
blocks of nodes are contracted in tasks, then rounds of coin flips splice out a quarter of what is left until a bounded rest is ranked in one
task, and the spliced arcs get their ranks in reverse order.  With arcs at their positions, running sums over the tour are taken block by
block, and what a subtree holds is the difference between its exit and its entry.

Rows with a null conversation key belong to no conversation and are left out.  Turns come in order of their number, null first; equal
numbers by role, then text.  Null roles and texts are empty.  Repeated rows are turns of their own.  A table without conversations has no nodes, not even
the root.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.spread import dense_index
from tessera.session import cut, release

#: Nodes whose arcs one task contracts at a time.
BLOCK = 16_384
#: So many arcs are ranked in one task at most (2 MB).
REST = 65_536
#: Ids that one task joins to a text before it is digested.
IDS = 65_536
#: A third of the names of a prefix: 60 bits of a digest.
NAME = "decimal(38,0)"


def ordered_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, at (from 0), n, role, text: every turn at its place; a conversation is never sorted in one task."""
    known = turns.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("conv_id"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.asc_nulls_first("_turn"), F.asc("role"), F.asc("text"), F.monotonically_increasing_id()]
    return dense_index(known, ["conv_id"], order, "at", "n").select("conv_id", "at", "n", "role", "text")


def share_heads(ordered: DataFrame, century: int = 100, most: int = 6) -> DataFrame:
    """Conversations rebuilt so that prefixes are shared: conv_id, depth (from 1), role, text, and a row of depth 0 with the rebuilt length for each.

    Conversation c begins with the first h turns of conversation c - c % century (all if fewer, none if absent), then come its own behind its first h;
    h = crc32(c) % most.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    each = ordered.filter("at = 0").select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % century).alias("lead"))
    leads = each.filter("conv_id = lead").select("lead", F.col("n").alias("n_lead"))
    each = cut(each.join(leads, "lead", "left").withColumn("taken", F.least("h", F.coalesce("n_lead", F.lit(0).cast("bigint")))))
    first = (ordered.filter((F.col("conv_id") % century == 0) & (F.col("at") < most)).select(F.col("conv_id").alias("lead"), "at", "role", "text")
             .join(each.filter("taken > 0").select("lead", "conv_id", "taken"), "lead").filter("at < taken")
             .select("conv_id", (F.col("at") + 1).alias("depth"), "role", "text"))
    own = (ordered.join(each.select("conv_id", "h", "taken"), "conv_id").filter("at >= h")
           .select("conv_id", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), "role", "text"))
    whole = each.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit("").alias("role"), F.lit("").alias("text"),
                        (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).cast("bigint").alias("length"))
    return first.unionByName(own).withColumn("length", F.lit(None).cast("bigint")).unionByName(whole)


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Replace ``values`` by their sums over all rows of the same key up to this one; a key is spread over ranges, never summed in one task."""
    ranged = cut(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = ranged.groupBy(*keys, "_range").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(*keys, "_range", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    local = ranged.withColumns({v: F.sum(v).over(within) for v in values})
    return local.join(shift, [*keys, "_range"]).select(*[(F.col(c) + F.col(f"_{c}")).cast(NAME).alias(c) if c in values else F.col(c) for c in df.columns])


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, p0, p1 (the name of the prefix), q0, q1 (that of its parent), chars (code points of its last text), last (it is the whole conversation)."""
    hashed = F.md5(F.concat_ws("\x00", F.col("depth").cast("string"), F.length("role").cast("string"), "role", "text").cast("binary"))

    def part(k: int) -> Column:
        digits = F.conv(F.substring(hashed, 1 + 15 * k, 15), 16, 10).cast(NAME)
        return F.when(F.col("depth") == 0, F.lit(0).cast(NAME)).otherwise(digits)

    light = rebuilt.select("conv_id", "depth", part(0).alias("p0"), part(1).alias("p1"), F.length("text").cast("bigint").alias("chars"), "length")
    own = light.withColumns({"g0": F.col("p0"), "g1": F.col("p1")})
    summed = running_sums(own, ["conv_id"], ["depth"], ["p0", "p1"])
    lengths = summed.filter("depth = 0").select("conv_id", F.col("length").alias("_length"))
    return summed.join(lengths, "conv_id").select("conv_id", "depth", "p0", "p1", (F.col("p0") - F.col("g0")).cast(NAME).alias("q0"), (F.col("p1") - F.col("g1")).cast(NAME).alias("q1"),
                                                  "chars", (F.col("depth") == F.col("_length")).alias("last"))


def _digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: the digest of the ids that end at a node, in order.

    Ids are joined to texts range by range; only those texts pass, in order and one at a time, through the task that digests a node.
    """
    ranged = cut(ends.repartitionByRange("node", "conv_id").withColumn("_range", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("_range", "node").orderBy("conv_id"))
    texts = (ranged.withColumn("_chunk", F.floor((place - 1) / IDS)).groupBy("node", "_range", "_chunk")
             .agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, told = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for k, ids in zip(batch.column("node").to_pylist(), batch.column("ids")):
                if k == node:
                    told.update(b",")
                else:
                    if told is not None:
                        done.append((node, told.hexdigest()))
                    node, told = k, hashlib.sha256()
                told.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], names=["node", "ends_sha256"])
        if told is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([told.hexdigest()])], names=["node", "ends_sha256"])

    return (texts.repartition("node").sortWithinPartitions("node", "_range", "_chunk").select("node", "ids")
            .mapInArrow(digest, "node long, ends_sha256 string"))


def tour(nodes: DataFrame) -> DataFrame:
    """id, next, of the arcs of a forest's Euler tours: node * 2 enters a node, node * 2 + 1 leaves it; the last arc of a tour has no next.

    ``nodes``: node, parent (null: a root), rank (its place among its siblings, from 0), n_siblings, leaf.
    """
    enter, leave = F.col("node") * 2, F.col("node") * 2 + 1
    first = nodes.filter("parent IS NOT NULL AND rank = 0").select((F.col("parent") * 2).alias("id"), enter.alias("next"))
    alone = nodes.filter("leaf").select(enter.alias("id"), leave.alias("next"))
    last = nodes.filter("parent IS NULL OR rank = n_siblings - 1").select(leave.alias("id"), (F.col("parent") * 2 + 1).alias("next"))
    below = nodes.filter("parent IS NOT NULL AND rank > 0").select("parent", (F.col("rank") - 1).alias("rank"), enter.alias("next"))
    along = nodes.join(below, ["parent", "rank"]).select(leave.alias("id"), "next")
    return first.unionByName(alone).unionByName(last).unionByName(along)


def _chains(t: pa.Table) -> pa.Table:
    """Contract the chains of arcs that stay within one block: every chain leaves its first arc, the others are spliced out."""
    ids, after = t["id"].to_numpy(), t["next"].to_numpy(zero_copy_only=False)
    order = np.argsort(ids)
    ids, after = ids[order], np.where(np.isnan(after.astype(float)), -1, after)[order].astype(np.int64)
    n = len(ids)
    at = np.searchsorted(ids, after).clip(max=n - 1)
    inside = ids[at] == after
    has_before = np.zeros(n, bool)
    has_before[at[inside]] = True
    # doubling: how far each arc reaches, until it stands on the last arc of its chain
    to, w = np.where(inside, at, np.arange(n)), inside.astype(np.int64)
    while (to[to] != to).any():
        w, to = w + w[to], to[to]
    out = after[to]
    return pa.table({"id": ids, "next": pa.array(out, mask=out < 0), "w": w + 1, "spliced": has_before})


def list_rank(arcs: DataFrame, block: int = BLOCK, rest: int = REST) -> DataFrame:
    """id, left: how many arcs of its list each arc has from itself to the end, of lists given as id, next (null: the end).

    Ids of neighbouring arcs should lie close together; that saves rounds but changes no result.
    """
    state = cut(arcs.groupBy(F.floor(F.col("id") / (2 * block)).alias("_block"))
                .applyInArrow(_chains, "id long, next long, w long, spliced boolean"))
    spliced = [state.filter("spliced")]
    left, turn, held = state.filter("NOT spliced").select("id", "next", "w"), 0, [state]

    def heads(arc: str | Column) -> Column:
        return F.pmod(F.xxhash64(arc, F.lit(turn)), F.lit(2)) == 1

    while left.count() > rest:
        # an arc goes if it shows heads and the one before it tails; that one takes over where it leads
        told = (left.filter(F.col("next").isNotNull() & ~heads("id") & heads("next"))
                .select(F.col("next").alias("id"), F.col("id").alias("by"), F.col("w").alias("by_w")))
        met = (left.select("id", "next", "w", F.lit(None).cast("bigint").alias("by"), F.lit(None).cast("bigint").alias("by_w"), F.lit(True).alias("own"))
               .unionByName(told.select("id", F.lit(None).cast("bigint").alias("next"), F.lit(None).cast("bigint").alias("w"), "by", "by_w", F.lit(False).alias("own")))
               .groupBy("id").agg(F.max("next").alias("next"), F.max("w").alias("w"), F.max("by").alias("by"), F.max("by_w").alias("by_w")))
        # one written table holds both: what was spliced out, and what stays
        gone = F.col("by").isNotNull()
        tells = F.col("next").isNotNull() & ~heads("id") & heads("next")
        done = cut(met.filter(gone | ~tells).select("id", "next", "w", "by", "by_w"))
        held.append(done)
        spliced.append(done.filter(gone).select("id", "next", "w"))
        left = done.select(F.coalesce("by", "id").alias("id"), "next", (F.col("w") + F.coalesce("by_w", F.lit(0).cast("bigint"))).alias("w"))
        turn += 1

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        ids = t["id"].to_numpy()
        order = np.argsort(ids)
        ids, w = ids[order], t["w"].to_numpy()[order]
        after = t["next"].fill_null(-1).to_numpy()[order]
        n = len(ids)
        # one place more stands for the end
        to = np.append(np.where(after < 0, n, np.searchsorted(ids, after)), n)
        w = np.append(w, 0)
        while (to != n).any():
            w, to = w + w[to], to[to]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(w[:n])], names=["id", "left"])

    ranks = cut(left.coalesce(1).mapInArrow(walk, "id long, left long"))
    for part in reversed(spliced):
        behind = ranks.select(F.col("id").alias("next"), F.col("left").alias("_left"))
        found = part.join(behind, "next", "left").select("id", (F.col("w") + F.coalesce("_left", F.lit(0).cast("bigint"))).alias("left"))
        ranks = cut(ranks.unionByName(found))
    release(*held)
    return ranks


def subtree_sums(nodes: DataFrame, values: list[str], block: int = BLOCK, rest: int = REST) -> DataFrame:
    """node, <values>: sums over each node's subtree, itself included.  ``nodes``: node, parent, rank, n_siblings, leaf, <values>; one tree."""
    ranks = list_rank(tour(nodes), block, rest)
    # the last arc of the tour has the fewest left, so sums run from the end: an entry less its exit
    arcs = (ranks.withColumns({"node": F.floor(F.col("id") / 2), "enters": F.col("id") % 2 == 0})
            .join(nodes.select("node", *values), "node")
            .select("node", "enters", F.col("left").alias("pos"), *[F.when(F.col("enters"), F.col(v)).otherwise(0).cast("bigint").alias(v) for v in values]))
    arcs = cut(arcs.withColumn("_block", F.floor(F.col("pos") / (2 * block))))
    within = Window.partitionBy("_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = arcs.groupBy("_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_block", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    at = arcs.withColumns({v: F.sum(v).over(within) for v in values}).join(shift, "_block")
    sign = F.when(F.col("enters"), 1).otherwise(-1)
    return at.groupBy("node").agg(*[F.sum(sign * (F.col(v) + F.col(f"_{v}"))).cast("bigint").alias(v) for v in values])


def trie(rebuilt: DataFrame, block: int = BLOCK, rest: int = REST) -> DataFrame:
    """The nodes of the trie of conversations given as rows of ``share_heads``.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens (summed
    over the subtree, (n_convs - 1) x code points of the last text), ends_sha256 (of the ids that end here, in order, comma-joined).
    """
    rows = cut(prefixes(rebuilt))
    name = ["depth", "p0", "p1"]
    found = rows.groupBy(*name).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("q0").alias("q0"), F.first("q1").alias("q1"),
                                    F.first("chars").alias("chars"))
    # numbered along the smallest members, so that most arcs lead to a near number; members of one depth have no node in common
    nodes = cut(dense_index(found, [], ["conv_id", "depth"], "node"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p0").alias("q0"), F.col("p1").alias("q1"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = cut(nodes.join(above, ["depth", "q0", "q1"], "left").select("node", "conv_id", "depth", "n_convs", "chars", "parent", "parent_conv_id"))
    below = linked.filter("parent IS NOT NULL")
    ranked = dense_index(below.select("node", "parent", "conv_id"), ["parent"], ["conv_id"], "rank", "n_siblings").select("node", "rank", "n_siblings")
    children = below.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    full = cut(linked.join(ranked, "node", "left").join(children, "node", "left")
               .withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("bigint")), "saved": (F.col("n_convs") - 1) * F.col("chars")})
               .withColumn("leaf", F.col("n_children") == 0).withColumn("one", F.col("leaf").cast("bigint")))
    sums = subtree_sums(full.select("node", "parent", "rank", "n_siblings", "leaf", F.col("one").alias("n_leaves"), F.col("saved").alias("saved_tokens")),
                        ["n_leaves", "saved_tokens"], block, rest)
    # where a prefix ends is known by its name; the names of ends are joined once
    ends = rows.filter("last").select("conv_id", *name).join(nodes.select("node", *name), name).select("node", "conv_id")
    return (full.join(sums, "node").join(_digests(ends), "node", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))


def conversation_trie(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **options) -> DataFrame:
    """The trie of all conversations of a table, rebuilt by ``share_heads``."""
    ordered = cut(ordered_turns(turns, key, turn, role, text))
    return trie(share_heads(ordered), **options)
