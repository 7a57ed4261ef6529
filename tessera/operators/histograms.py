"""Circular and soft histograms per entity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.plane import let, vec_unit_clip

SMOOTHING = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)


def _ring(values: Column, i: Column, shift: int, bins: int) -> Column:
    return F.element_at(values, ((i + (bins + shift)) % bins + 1).cast("int"))


def _smooth_ring(values: Column, bins: int) -> Column:
    def one(i):
        outer = _ring(values, i, -2, bins) + _ring(values, i, 2, bins)
        inner = _ring(values, i, -1, bins) + _ring(values, i, 1, bins)
        return outer * SMOOTHING[0] + inner * SMOOTHING[1] + _ring(values, i, 0, bins) * SMOOTHING[2]
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), one)


def ring_histogram(samples: DataFrame, keys: list[str], angle: Column, weight: Column, bins: int) -> DataFrame:
    """Weight per circular bin as one array of ``bins`` numbers per entity."""
    turn = angle - F.floor(angle / (2 * math.pi)) * (2 * math.pi)
    slot = F.floor(turn / (2 * math.pi) * bins).cast("int") % bins
    sums = (samples.select(*keys, slot.alias("_bin"), weight.alias("_w"))
            .groupBy(*keys, "_bin").agg(F.sum("_w").alias("_w")))
    filled = [F.coalesce(F.sum(F.when(F.col("_bin") == k, F.col("_w"))), F.lit(0.0)) for k in range(bins)]
    return sums.groupBy(*keys).agg(F.array(*filled).alias("hist"))


def circular_peaks(samples: DataFrame, keys: list[str], angle: Column, weight: Column, bins: int = 36,
                   ratio: float = 0.8) -> DataFrame:
    """Dominant directions: keys, bin, peak (radians in [0, 2 pi)), height.

    The histogram is smoothed twice around the ring; a bin counts when it beats both neighbours and
    reaches ``ratio`` of the highest, and a parabola through the three gives its position.
    """
    hist = ring_histogram(samples, keys, angle, weight, bins)
    smooth = hist.withColumn("s", let(let(F.col("hist"), lambda h: _smooth_ring(h, bins)), lambda s: _smooth_ring(s, bins)))
    top = F.array_max("s")
    rows = smooth.filter(top > 0).select(*keys, F.col("s"), top.alias("_top"), F.posexplode("s").alias("bin", "height"))
    left, right = _ring(F.col("s"), F.col("bin"), -1, bins), _ring(F.col("s"), F.col("bin"), 1, bins)
    rows = rows.withColumn("_l", left).withColumn("_r", right).filter(
        (F.col("height") > F.col("_l")) & (F.col("height") > F.col("_r"))
        & (F.col("height") >= ratio * F.col("_top")))
    pos = F.col("bin") + 0.5 * (F.col("_l") - F.col("_r")) / (F.col("_l") - 2 * F.col("height") + F.col("_r"))
    pos = F.when(pos < 0, pos + bins).when(pos >= bins, pos - bins).otherwise(pos)
    return rows.select(*keys, "bin", (pos / bins * (2 * math.pi)).alias("peak"), "height")


def soft_histogram(samples: DataFrame, keys: list[str], r: Column, c: Column, theta: Column, weight: Column,
                   d: int = 4, n: int = 8, cap: float | None = 0.2) -> DataFrame:
    """Trilinear d x d x n histogram per entity, flattened row by row: keys, vec.

    ``r`` and ``c`` are in cells with centres on 0..d-1; ``theta`` is in circular bins.  Shares that fall
    on the margin ring are dropped.  With ``cap`` the vector is normalised and clipped.
    """
    base = samples.select(*keys, r.alias("_r"), c.alias("_c"), theta.alias("_t"), weight.alias("_w")).filter(
        (F.col("_r") > -1) & (F.col("_r") < d) & (F.col("_c") > -1) & (F.col("_c") < d))
    r0, c0, o0 = F.floor("_r"), F.floor("_c"), F.floor("_t")
    fr, fc, fo = F.col("_r") - r0, F.col("_c") - c0, F.col("_t") - o0
    corners = []
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                share = ((fr if i else 1 - fr) * (fc if j else 1 - fc) * (fo if k else 1 - fo))
                corners.append(F.struct((r0 + i).alias("r"), (c0 + j).alias("c"),
                                        F.pmod(o0 + k, F.lit(n)).alias("o"), (F.col("_w") * share).alias("v")))
    spread = base.select(*keys, F.explode(F.array(*corners)).alias("_k")).select(*keys, "_k.*").filter(
        (F.col("r") >= 0) & (F.col("r") < d) & (F.col("c") >= 0) & (F.col("c") < d))
    slot = ((F.col("r") * d + F.col("c")) * n + F.col("o")).cast("int")
    sums = spread.groupBy(*keys, slot.alias("_slot")).agg(F.sum("v").alias("v"))
    # at most d * d * n entries per entity
    packed = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_slot", "v"))).alias("_m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(d * d * n - 1)),
                      lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)))
    flat = packed.select(*keys, vec.alias("vec"))
    return flat if cap is None else flat.withColumn("vec", vec_unit_clip(F.col("vec"), cap))
