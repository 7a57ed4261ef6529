"""Four-parameter transforms as STRUCT<a,b,tx,ty>: x' = a x - b y + tx, y' = b x + a y + ty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROTATION_DEG = 20.0
MIN_SCALE, MAX_SCALE = 0.5, 2.0


def sim(a, b, tx, ty) -> Column:
    return F.struct(
        F.lit(a).cast("double").alias("a") if not isinstance(a, Column) else a.alias("a"),
        F.lit(b).cast("double").alias("b") if not isinstance(b, Column) else b.alias("b"),
        F.lit(tx).cast("double").alias("tx") if not isinstance(tx, Column) else tx.alias("tx"),
        F.lit(ty).cast("double").alias("ty") if not isinstance(ty, Column) else ty.alias("ty"),
    )


def sim_apply(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return t["a"] * x - t["b"] * y + t["tx"], t["b"] * x + t["a"] * y + t["ty"]


def sim_inverse(t: Column) -> Column:
    d = t["a"] * t["a"] + t["b"] * t["b"]
    a, b = t["a"] / d, -t["b"] / d
    return sim(a, b, -(a * t["tx"] - b * t["ty"]), -(b * t["tx"] + a * t["ty"]))


def sim_compose(outer: Column, inner: Column) -> Column:
    """The transform that applies ``inner`` first and ``outer`` second."""
    tx, ty = sim_apply(outer, inner["tx"], inner["ty"])
    return sim(
        outer["a"] * inner["a"] - outer["b"] * inner["b"],
        outer["a"] * inner["b"] + outer["b"] * inner["a"],
        tx,
        ty,
    )


def sim_from_polar(scale: Column, rotation: Column, tx: Column, ty: Column) -> Column:
    return sim(scale * F.cos(rotation), scale * F.sin(rotation), tx, ty)


def sim_scale(t: Column) -> Column:
    return F.sqrt(t["a"] * t["a"] + t["b"] * t["b"])


def sim_rotation(t: Column) -> Column:
    return F.atan2(t["b"], t["a"])


def sim_to_h(t: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(t["a"], -t["b"], t["tx"], t["b"], t["a"], t["ty"], zero, zero, one)


def h_to_sim(h: Column) -> Column:
    """Back from a row-major 3x3; NULL when the matrix has a perspective part."""
    affine = (F.abs(h[6]) < 1e-9) & (F.abs(h[7]) < 1e-9) & (F.abs(h[8]) > 1e-12)
    s = F.lit(1.0) / F.when(affine, h[8])
    return F.when(affine, sim(h[0] * s, h[3] * s, h[2] * s, h[5] * s))


def sim_plausible(t: Column) -> Column:
    """Scale and tilt limits of sources taken square to a common plane."""
    s = sim_scale(t)
    tilt = F.abs(sim_rotation(t))
    return (s >= MIN_SCALE) & (s <= MAX_SCALE) & (tilt < F.radians(F.lit(MAX_ROTATION_DEG)))
