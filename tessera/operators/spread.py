"""Helpers that keep any one key from landing whole in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import cut


def dense_index(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "idx",
                count_name: str | None = None) -> DataFrame:
    """0-based position of every row within its key, without sorting a whole key in one task.

    Rows are range-partitioned by (keys, order), numbered inside each range, and shifted by the
    summed sizes of the earlier ranges of the same key.  A key holding a third of the rows is
    simply spread over a third of the ranges.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    by_key = [F.col(k) for k in keys]
    ranged = cut(df.repartitionByRange(*by_key, *cols).withColumn("_range", F.spark_partition_id()))
    local = ranged.withColumn(
        "_in_range", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*cols)).cast("bigint") - 1)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_in_this"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_in_this").over(earlier), F.lit(0)))
    if count_name:
        shift = shift.withColumn(count_name, F.sum("_in_this").over(Window.partitionBy(*keys)))
    out = local.join(shift.drop("_in_this"), [*keys, "_range"])
    return out.withColumn(name, F.col("_in_range") + F.col("_shift")).drop("_range", "_in_range", "_shift")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark prunes to n rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def unordered_block_pairs(df: DataFrame, group: str, n_groups: Column) -> DataFrame:
    """Copy every row to each unordered pair of row groups it takes part in (``_lo`` <= ``_hi``).

    All pairs of rows then meet in exactly one (_lo, _hi) block of bounded size.
    """
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), n_groups - 1))
    return (df.withColumn("_other", other)
            .withColumn("_lo", F.least(group, "_other"))
            .withColumn("_hi", F.greatest(group, "_other"))
            .drop("_other"))
