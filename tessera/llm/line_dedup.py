"""Repeated lines removed across documents with levelled sorted runs of line hashes.

Documents come in batches.  A batch's lines make one entry per line hash, with the number of documents that hold it and the largest of their
keys.  The batch is merge-anti-joined with the runs that exist: hashes without a partner become a new run, sorted by hash; hashes
with a partner only add to the tally of known hashes.  Every ``FAN`` runs of a level are compacted into one run of the next level, so a hash
is rewritten once per level and stands in exactly one run.  At the end runs and tally give the hashes to drop, which are joined back to
the documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import SPACES
from tessera.session import checkpoint_dir, cut, release, track

FAN = 2
BATCHES = 4
MIN_CHARS = 20
MIN_DOCS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _LOWER)


def line_hashes(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, hash (128 bits) of every line key long enough to count, once for each document that holds it."""
    lines = docs.select(F.col(key).alias("doc"), F.explode(F.split(F.col(text), "\n", -1)).alias("line")).select("doc", line_key(F.col("line")).alias("line"))
    return lines.filter(F.length("line") >= min_chars).select("doc", F.unhex(F.md5("line")).alias("hash")).distinct()


def _union(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


class Runs:
    """Levels of sorted runs, at most ``fan`` - 1 a level between batches, and the tally of hashes that came again."""

    def __init__(self, fan: int = FAN):
        self.fan, self.levels, self.tally, self.held = fan, [], [], []

    def add(self, lines: DataFrame) -> None:
        """Take in a batch's lines (doc, hash), once for each document; no document of it has come before."""
        batch = self._kept(lines.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("top")).sortWithinPartitions("hash"))
        known = [r for level in self.levels for r in level]
        if known:
            seen = _union(known).select("hash")
            self.tally.append(batch.join(seen, "hash", "left_semi"))
            batch = self._kept(batch.join(seen, "hash", "left_anti").sortWithinPartitions("hash"))
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(batch)
            if len(self.levels[level]) < self.fan:
                return
            # runs of a level share no hash: compaction only merges them in order
            batch = self._kept(_union(self.levels[level]).repartition("hash").sortWithinPartitions("hash"))
            self.levels[level] = []
            level += 1

    def _kept(self, run: DataFrame) -> DataFrame:
        self.held.append(cut(run))
        return self.held[-1]

    def release(self) -> None:
        """Delete all runs, once the entries are stored elsewhere."""
        release(*self.held)

    def entries(self) -> DataFrame:
        """hash, n, top over everything taken in."""
        runs = [r for level in self.levels for r in level]
        return _union(runs + self.tally).groupBy("hash").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                   batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """doc, hash: the lines to drop, that is those held by at least ``min_docs`` documents, but in the document with the largest key."""
    spark = docs.sparkSession
    path = track(f"{checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}")
    (line_hashes(docs, key, text, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))
     .write.partitionBy("batch").parquet(path))
    kind = docs.schema[key].dataType.simpleString()
    lines = spark.read.schema(f"doc {kind}, hash binary, batch int").parquet(path)
    runs = Runs(fan)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b).select("doc", "hash"))
    drop = cut(runs.entries().filter(F.col("n") >= min_docs).select("hash", "top"))
    runs.release()
    return lines.join(drop, "hash").filter(F.col("doc") != F.col("top")).select("doc", "hash")


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All columns of ``docs``, the text without its repeated lines, and n_lines (before), n_dropped (long; a clashing column is replaced).

    A null or empty text is one empty line and stays as it is.  A text that loses all its lines becomes empty.  Rows with a null
    key count together as one document and lose nothing.  Rows that share a key count as one document and are treated alike, each with
    its own text.  An empty table gives an empty result.
    """
    gone = repeated_lines(docs, key, text, **options).groupBy("doc").agg(F.collect_set("hash").alias("hashes"))
    docs = docs.drop(*[c for c in ("n_lines", "n_dropped") if c != key and c != text])
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    k, t = (f"c{names.index(x)}" for x in (key, text))
    joined = rows.join(gone, rows[k] == gone["doc"], "left").drop("doc")
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("n_lines long, n_dropped long").fields])
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lost = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            n_lines = [1 if x is None else x.count("\n") + 1 for x in texts]
            n_lost = [0] * len(texts)
            for i, hashes in enumerate(lost):
                if hashes:
                    gone = set(hashes)
                    kept = [x for x in texts[i].split("\n") if _hash(x) not in gone]
                    n_lost[i] = n_lines[i] - len(kept)
                    texts[i] = "\n".join(kept)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_lost, pa.int64())], names=schema.names)

    out = joined.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_lines", "n_dropped")


def _hash(line: str) -> bytes:
    return hashlib.md5(line.encode("utf-8").strip(SPACES.encode()).lower()).digest()
