"""What the two operators on vectors share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def usable(vectors: DataFrame, key: str, vector: str, fit: bool = True) -> DataFrame:
    """key, v (array<double>), dim: vectors that are not null, not zero and hold only finite numbers, or else all others."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0.0)
    rows = vectors.select(F.col(key).alias("key"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    return rows.filter("fine" if fit else "NOT fine").select("key", "v", F.size("v").alias("dim"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def by_groups(df: DataFrame, keys: int, schema: StructType | str, work: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Hand runs of equal leading ``keys`` columns (sorted within partitions) to ``work`` as one table each; runs must be of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            turn = np.zeros(batch.num_rows, bool)
            for c in range(keys):
                x = batch.column(c).to_numpy(zero_copy_only=False)
                turn[1:] |= x[1:] != x[:-1]
            cuts = [0, *np.flatnonzero(turn).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(batch.column(c)[a].as_py() for c in range(keys))
                if held and key != last:
                    yield from work(last, pa.Table.from_batches(held).combine_chunks())
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(last, pa.Table.from_batches(held).combine_chunks())

    return df.mapInArrow(run, schema)
