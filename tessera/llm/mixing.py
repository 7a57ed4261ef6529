"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of the token budget by its weight, at most ``max_epochs`` times its own size; what is over is shared out again among
the rest.  A source takes complete epochs of all its documents first.  What is left of its target is drawn without replacement:
document i gets the key -ln(u) / w of its quality weight w, documents are sorted by key within the source, and their sizes are summed up to the
budget.  The document that the budget falls into is taken in part.

No source is sorted in one task.  Keys fall into ranges by the share of the exponential law below them.  Sums per source and range are
aggregated first and summed up along a source; documents are then sorted inside their own range and shifted by the sum of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.spread import dense_index
from tessera.session import cut

SHARE = 1.5
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 2
#: Expected documents of one key range, and the most ranges: more documents make the ranges longer, not the sums.
RANGE, MOST_RANGES = 512, 1 << 16


def word_count(text: Column) -> Column:
    """Number of words parted by ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number between 0 and 1 that depends on the key alone, the same in any SQL engine."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source (group, source, source_size) -> group, source_size, target.

    Weights are dealt to the sources by code point, null last.  Targets share ``share`` of all sizes by weight; none
    exceeds ``max_epochs`` times its size, and what is cut off is shared out again.  Only sums reach the driver, once per round.
    """
    ranked = dense_index(sizes, [], [F.col("source").asc_nulls_last()], "_at")
    pick = F.array(*[F.lit(float(w)) for w in weights])
    s = cut(ranked.withColumn("weight", pick[F.pmod(F.col("_at"), F.lit(len(weights))).cast("int")])
            .select("group", "source_size", "weight", (F.col("source_size") * F.lit(max_epochs)).alias("most")))
    budget = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # words per unit of weight; grows as full sources drop out
    while True:
        full = F.col("most") < F.col("weight") * F.lit(level)
        row = s.agg(F.sum(F.when(full, F.col("most"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        now = (budget - float(row["held"] or 0)) / row["open"] if row["open"] else level
        if now <= level:
            break
        level = now
    return s.select("group", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", quality: DataFrame | None = None,
        share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """key, source, size, source_size, target, taken: how many words of each document the mix takes, repeats counted.

    ``quality`` (key, weight) scales the chance of a document to come early in the fractional epoch; documents without a row weigh 1,
    and weights are at least 1e-6.  A null text has no words.  Null is a source of its own, the last.  Null keys are drawn alike.  Ties of
    the drawn number go to the smaller key, then the smaller size.  Repeated rows are separate documents.  A source without words has the target
    0.  An empty table gives an empty result.  Reruns agree: the draw depends on the key alone.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    if quality is not None:
        known = quality.groupBy(F.col(key).alias("_of")).agg(F.max("weight").alias("weight"))
        rows = rows.join(known, F.col("key") == F.col("_of"), "left").drop("_of")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    rows = rows.withColumn("group", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source"))))
    drawn = -F.log(uniform(F.col("key"))) / F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1e-6))
    light = cut(rows.select("key", "source", "group", "size", drawn.alias("drawn")))
    sizes = cut(light.groupBy("group", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    goal = targets(sizes.select("group", "source", "source_size"), share, weights, max_epochs)
    n = sizes.agg(F.sum("n")).first()[0] or 0
    ranges = min(max(1, -(-n // RANGE)), MOST_RANGES)
    light = light.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("drawn"))) * ranges), F.lit(ranges - 1)).cast("int"))
    before = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = light.groupBy("group", "range").agg(F.sum("size").alias("held"))
    shift = sums.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held").join(goal, "group")
    own = Window.partitionBy("group", "range").orderBy("drawn", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = (light.join(shift, ["group", "range"])
              .withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(own), F.lit(0)))
              .withColumn("epochs", epochs))
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at")))
    return placed.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target",
                         (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def draw(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as it was taken, all columns as they are.

    Documents stay whole: one that the budget cuts is taken if at least half of it fits.  Rows that share key, source and size
    each get the rounded mean of their numbers.  A document without words (null or empty text) is never taken.  Null keys and null sources are drawn like any
    other.  An empty table gives an empty result.
    """
    mixed = mix(docs, key, text, source, **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    plan = (mixed.groupBy(F.col(key).alias("_k"), F.col(source).alias("_s"), F.col("size").alias("_n"))
            .agg(F.round(F.sum(times) / F.count(F.lit(1))).cast("int").alias("_times")).filter(F.col("_times") > 0))
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    k, t, s = (F.col(f"c{names.index(x)}") for x in (key, text, source))
    met = rows.join(plan, k.eqNullSafe(F.col("_k")) & s.eqNullSafe(F.col("_s")) & (word_count(t) == F.col("_n")))
    return met.withColumn("_times", F.explode(F.sequence(F.lit(1), "_times"))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
