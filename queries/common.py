"""Table loading and rounding that both engines do bit for bit alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rd(value: Column | str, digits: int = 6) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    k = float(10 ** digits)
    return F.floor(c * k + 0.5) / k


def sq(expr: str, digits: int = 6) -> str:
    k = f"{float(10 ** digits):.1f}::DOUBLE"
    return f"floor(({expr}) * {k} + 0.5::DOUBLE) / {k}"


class Registry:
    """Collects queries of one module under their names, with optional SQL twins."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = sql
            return fn
        return wrap
