"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Characters that part words and pad lines.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def give_back() -> None:
    """Return memory that a finished task has freed to the system: Python workers live on, and would keep it beside the next task's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _weight(value) -> int:
    """About the bytes that a value takes until it leaves."""
    if isinstance(value, (str, bytes)):
        return len(value)
    if isinstance(value, np.ndarray):
        return value.nbytes
    return 40 * len(value) if isinstance(value, (list, tuple)) else 0


def map_rows(df: DataFrame, schema: str | StructType, work: Callable[..., Iterator[tuple]], *, block: int = 4096) -> DataFrame:
    """Feed each partition's rows, as tuples of Python values, to ``work``; its tuples become ``schema``.

    ``work`` gets one iterator for the whole partition.  Lists may be numpy arrays.  Output leaves in blocks of at most ``block`` rows or
    about 16 MB, so memory stays bounded however long the partition is.
    """
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            # slices keep the number of live Python objects small whatever the batch holds
            for at in range(0, batch.num_rows, 256):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, held, weight = to_arrow_schema(kind), [], 0
        for row in work(rows(batches)):
            held.append(row)
            weight += sum(map(_weight, row))
            if len(held) >= block or weight >= 1 << 24:
                yield _pack(held, arrow)
                held, weight = [], 0
        if held:
            yield _pack(held, arrow)
        held = None
        give_back()

    return df.mapInArrow(run, kind)


def _pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
