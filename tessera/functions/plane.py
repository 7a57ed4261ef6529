"""Flat-frame mapping, locality weights, ground distance and vector clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def frame_point(origin_x, origin_y, scale, px: Column, py: Column) -> tuple[Column, Column]:
    """Frame coordinates of an output pixel centre."""
    return origin_x + (px + 0.5) / scale, origin_y + (py + 0.5) / scale


def output_point(origin_x, origin_y, scale, x: Column, y: Column) -> tuple[Column, Column]:
    return (x - origin_x) * scale - 0.5, (y - origin_y) * scale - 0.5


def tent_weight(x: Column, y: Column, width: Column, height: Column, floor: float = 0.0) -> Column:
    """1 at the centre of a source, falling linearly to 0 at its edges."""
    w = (1 - F.abs(2 * x / width - 1)) * (1 - F.abs(2 * y / height - 1))
    return F.greatest(w, F.lit(floor)) if floor > 0 else w


def intensity(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / 3


def ground_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance in metres."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.sqrt(x * x + y * y) * EARTH_RADIUS_M


def source_dimension_frame(width, height, frame_scale, focal) -> Column:
    """Long side to load a source at, for an angular frame of ``frame_scale`` px per radian."""
    return F.ceil(F.greatest(width, height) * frame_scale / focal * 1.2)


def source_dimension_flat(width, height, frame_scale, sim_scale) -> Column:
    return F.ceil(F.greatest(width, height) * frame_scale * sim_scale * 1.2)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it inside ``body`` (higher-order bodies re-evaluate columns per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e * e))
    return let(norm, lambda n: F.when(n > 1e-12, F.transform(v, lambda e: e / n)).otherwise(v))


def vec_unit_clip(v: Column, cap: float = 0.2) -> Column:
    """L2-normalise, clip entries at ``cap``, renormalise only if something was clipped."""
    def clip(unit: Column) -> Column:
        clipped = let(F.transform(unit, lambda e: F.least(e, F.lit(cap))), _unit)
        return F.when(F.array_max(unit) > cap, clipped).otherwise(unit)

    return let(let(F.transform(v, lambda e: e.cast("double")), _unit), clip)


def hash_int(*parts) -> Column:
    """First eight hex digits of md5('k1-k2-...') as BIGINT; the same in any SQL engine."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("-", *cols)), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    return hash_int(*parts) / 4294967296.0
