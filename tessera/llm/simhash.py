"""Near-duplicate texts by SimHash fingerprints joined through a Gray-ordered hierarchical index.

A fingerprint has 64 bits; two fingerprints link when at most ``max_bits`` (3) differ.  Of four 16-bit blocks, two linked
fingerprints share at least one, so every fingerprint goes to four cells (block mask, block value) and every link is found in a cell.
A cell that holds more than ``CELL`` fingerprints is refined: the bits that are still free are cut into four blocks again, one of which a linked
pair must share.  After ``DEPTH`` rounds 44 bits are fixed, so no cell can hold more than 2**20 different fingerprints.

Inside a cell the fingerprints are sorted by Gray rank.  Runs of neighbours become leaves, runs of leaves become upper nodes; each node
keeps the bits that all its members share and that its parent does not already hold.  A query walks down with the differences
counted so far and leaves a whole group as soon as they exceed ``max_bits``.  Groups already known to be connected to the query
are left as well, so a dense ball of near copies costs no square of its size, and a cell returns a spanning forest instead of pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows
from tessera.operators.graph import connected_components
from tessera.session import cut

SEED = 42
CELL = 4096
DEPTH = 4
LEAF, FAN = 16, 8
_NO_ID = (1 << 63) - 1
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE = (np.arange(8) * 256).astype(np.int64)


def _words(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in blocks of about ``size`` bytes, so that a huge text is never held as a list."""
    at = 0
    while at < len(text):
        stop = _BREAK.search(text, at + size)
        end = stop.start() if stop else len(text)
        if words := text[at:end].split():
            yield words
        at = end


def shingle_digests(text: str | None, width: int) -> Iterator[bytes]:
    """The 8-byte digests of the lower-cased word ``width``-shingles, block by block; a text of fewer words is one shingle."""
    some, rest = False, []
    digest = xxhash.xxh64_digest
    for block in _words((text or "").encode("utf-8", "surrogatepass").lower()):
        words = rest + block
        if len(words) >= width:
            joined = b" ".join(words)
            ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
            starts = [0] + [e + 1 for e in ends[:len(words) - width]]
            yield b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1:])])
            some = True
        rest = words[max(0, len(words) - width + 1):]
    if rest and not some:
        yield digest(b" ".join(rest), SEED)


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the lower-cased word ``width``-shingles; 0 for a text without words."""
    counts, n = np.zeros((8, 256), np.int64), 0
    for raw in shingle_digests(text, width):
        data = np.frombuffer(raw, np.uint8).reshape(-1, 8)
        counts += np.bincount((data + _BYTE).ravel(), minlength=2048).reshape(8, 256)
        n += len(data)
    return int.from_bytes(np.packbits((counts @ _BITS).ravel() * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per document: key, fp (the 64 bits as a signed long).  Null and empty texts get 0."""
    def work(rows):
        for k, t in rows:
            fp = fingerprint(t, width)
            yield k, fp - (1 << 64) if fp >> 63 else fp

    return map_rows(docs.select(F.col(key), F.col(text)), f"key {docs.schema[key].dataType.simpleString()}, fp long", work)


def _child_masks(mask: int, parts: int) -> list[int]:
    """``mask`` with each of the four blocks of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    size = -(-len(free) // parts)
    return [mask | sum(1 << b for b in free[i:i + size]) for i in range(0, len(free), size)]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _cells(fps: DataFrame, max_bits: int, cell: int, depth: int) -> DataFrame:
    """fp, node -> mask, cell, fp, node: every pair within ``max_bits`` meets in a cell, and crowded cells are refined."""
    parts = max_bits + 1
    masks = _child_masks(0, parts)
    here = fps.withColumn("mask", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])))
    done = None
    for level in range(1, depth + 1):
        here = here.withColumn("cell", F.col("fp").bitwiseAND(F.col("mask")))
        if level == depth:
            break
        crowded = cut(here.groupBy("mask", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell).select("mask", "cell"))
        if crowded.isEmpty():
            break
        calm = here.join(crowded, ["mask", "cell"], "left_anti")
        done = calm if done is None else done.unionByName(calm)
        finer = {m: _child_masks(m, parts) for m in masks}
        masks = sorted({c for cs in finer.values() for c in cs})
        pick = F.create_map(*[x for m, cs in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in cs]))])
        here = here.join(crowded, ["mask", "cell"], "left_semi").withColumn("mask", F.explode(pick[F.col("mask")])).drop("cell")
    return here if done is None else done.unionByName(here)


def gray_forest(codes: np.ndarray, first: np.ndarray, max_bits: int) -> np.ndarray:
    """Labels of rows sorted by (cell, Gray rank): the lowest row that a chain of links inside the cell reaches.

    ``first`` marks the first row of each cell.
    """
    n = len(codes)
    cell = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, n))
    place = np.arange(n) - begin[cell]
    # levels from the leaves up: the rows at which nodes begin, shared bits, their pattern
    starts, span = [], LEAF
    while True:
        starts.append(np.flatnonzero(place % span == 0))
        if span >= size.max():
            break
        span *= FAN
    nodes = []
    for s in starts:
        ones = np.bitwise_and.reduceat(codes, s)
        nodes.append((s, ones | ~np.bitwise_or.reduceat(codes, s), ones))
    label = np.arange(n)
    cost = np.cumsum(size[cell])
    chunk = cost // (1 << 21)
    for at in np.unique(chunk):
        q = np.flatnonzero(chunk == at)
        q = q[size[cell[q]] > 1]
        if not len(q):
            continue
        node, seen, upper = cell[q], np.zeros(len(q), np.int64), np.zeros(len(q), np.uint64)
        for level in range(len(nodes) - 1, -1, -1):
            s, mask, ones = nodes[level]
            if level < len(nodes) - 1:
                above = nodes[level + 1][0]
                low = np.searchsorted(s, above)
                many = np.diff(np.append(low, len(s)))
                upper = nodes[level + 1][1][node]
                q, node, seen, upper = _spread(many[node], low[node], q, seen, upper)
            seen = seen + np.bitwise_count((codes[q] ^ ones[node]) & mask[node] & ~upper)
            ends = np.append(s[1:], n)
            lab_low, lab_high = np.minimum.reduceat(label, s), np.maximum.reduceat(label, s)
            keep = (seen <= max_bits) & (ends[node] > q + 1) & ~((lab_low[node] == label[q]) & (lab_high[node] == label[q]))
            q, node, seen = q[keep], node[keep], seen[keep]
        s, mask, _ = nodes[0]
        ends = np.append(s[1:], n)
        q, row, seen, held = _spread((ends - s)[node], s[node], q, seen, mask[node])
        seen = seen + np.bitwise_count((codes[q] ^ codes[row]) & ~held)
        keep = (seen <= max_bits) & (row > q)
        label = _settle(label, q[keep], row[keep])
    return label


def _spread(many: np.ndarray, low: np.ndarray, *rest: np.ndarray) -> tuple:
    """Repeat each entry for its children, which are numbered from ``low``."""
    total = int(many.sum())
    shift = np.repeat(np.cumsum(many) - many, many)
    child = np.repeat(low, many) + np.arange(total) - shift
    q, *others = rest
    return np.repeat(q, many), child, *(np.repeat(x, many) for x in others)


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
    return label


def _forest_batches(max_bits: int):
    def solve(mask, cell, fp, node) -> pa.RecordBatch:
        first = np.ones(len(fp), bool)
        first[1:] = (mask[1:] != mask[:-1]) | (cell[1:] != cell[:-1])
        label = gray_forest(fp.view(np.uint64), first, max_bits)
        tied = np.flatnonzero(label != np.arange(len(label)))
        out = [fp[tied], node[tied], fp[label[tied]], node[label[tied]]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["fa", "na", "fb", "nb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n < 1 << 18:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            turn = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            if len(turn):  # the last cell may go on in the next batch
                end = turn[-1] + 1
                yield solve(*(x[:end] for x in cols))
                cols = [x[end:] for x in cols]
            held, n = [cols], len(cols[0])
        if n:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    return run


def link_forest(fps: DataFrame, max_bits: int = 3, cell: int = CELL, depth: int = DEPTH) -> DataFrame:
    """Distinct fp (long), node (long) -> fa, na, fb, nb: edges that connect exactly what links connect."""
    gray = F.col("fp")
    for step in (1, 2, 4, 8, 16, 32):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, step))
    rows = (_cells(fps, max_bits, cell, depth).withColumn("gray", gray)
            .repartition("mask", "cell").sortWithinPartitions("mask", "cell", "gray").select("mask", "cell", "fp", "node"))
    return rows.mapInArrow(_forest_batches(max_bits), "fa long, na long, fb long, nb long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 3,
                    cell: int = CELL) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (smallest key reachable by links, itself included), one row per input row.

    Null or empty text: fingerprint zero, linked like any other.  Equal texts share a fingerprint and so a component.  Rows with a null key
    are fingerprinted and linked too; a component of such rows alone has a null id.  Repeated rows are returned as often as they
    come.  An empty table gives an empty result.  Other columns of ``docs`` are ignored, whatever their names.
    """
    light = cut(fingerprints(docs, key, text, width))
    classes = cut(light.groupBy("fp").agg(F.coalesce(F.min("key"), F.lit(_NO_ID)).cast("long").alias("node")))
    edges = link_forest(classes, max_bits, cell)
    found = connected_components(edges.select(F.struct(F.col("na").alias("node"), F.col("fa").alias("fp")).alias("a"),
                                              F.struct(F.col("nb").alias("node"), F.col("fb").alias("fp")).alias("b")))
    linked = found.select(F.col("node.fp").alias("fp"), F.col("component.node").alias("low"))
    # written, so that both sides of the last join are dealt anew and Spark can split a fingerprint that very many documents share
    named = cut(classes.join(linked, "fp", "left")
                .select("fp", F.nullif(F.coalesce("low", "node"), F.lit(_NO_ID)).alias("component_id")))
    return light.join(named, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One document of each group stays, that with the smallest key; all columns are kept as they are.

    Rows with a null key stay where their group has no key at all.  Of repeated rows one stays.
    """
    width = options.get("width", 3)
    return keep_lowest(docs, near_duplicates(docs, key, **options), lambda t: f"{fingerprint(t, width):016x}", key, options.get("text", "text"))


def keep_lowest(docs: DataFrame, found: DataFrame, mark: Callable[[str | None], str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest key of each group in ``found`` (key, fingerprint, component_id); ``mark`` gives a text's fingerprint."""
    stay = (found.filter(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_stay_key"), F.col("fingerprint").alias("_stay_fp"))
            .distinct())
    # a fingerprint tells apart texts that share a key
    again = cut(found.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).select(F.col(key).alias("_again")))
    unique = stay.select("_stay_key").distinct()
    plain = docs.join(again, docs[key].eqNullSafe(F.col("_again")), "left_anti").join(unique, F.col(key) == F.col("_stay_key"), "left_semi")
    if again.isEmpty():
        return plain
    repeated = docs.join(again, docs[key].eqNullSafe(F.col("_again")), "left_semi")
    names = repeated.columns
    packed = repeated.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.struct("*").alias("_row"))

    def work(rows):
        for k, t, row in rows:
            yield k, mark(t), row

    hashed = map_rows(packed, f"_key {docs.schema[key].dataType.simpleString()}, _fp string, _row {repeated.schema.simpleString()}", work)
    one = (hashed.join(stay, F.col("_key").eqNullSafe(F.col("_stay_key")) & (F.col("_fp") == F.col("_stay_fp")), "left_semi")
           .groupBy("_key", "_fp").agg(F.first("_row").alias("_row")))
    return plain.unionByName(one.select(*[F.col("_row")[c].alias(c) for c in names]))
