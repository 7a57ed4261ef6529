"""Homographies and pinhole cameras as row-major ARRAY<DOUBLE>(9) arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec3 = tuple[Column, Column, Column]


def _mul(m: Column, v: Vec3) -> Vec3:
    return tuple(m[3 * r] * v[0] + m[3 * r + 1] * v[1] + m[3 * r + 2] * v[2] for r in range(3))


def _mul_t(m: Column, v: Vec3) -> Vec3:
    return tuple(m[c] * v[0] + m[3 + c] * v[1] + m[6 + c] * v[2] for c in range(3))


def h_apply(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Projective transform of a point; NULL where the point maps to infinity."""
    u, v, w = _mul(h, (x, y, F.lit(1.0)))
    w = F.nullif(w, F.lit(0.0))
    return u / w, v / w


def cam_centered(width: Column, height: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return x - width / 2, y - height / 2


def cam_project(rot: Column, focal: Column, d: Vec3) -> tuple[Column, Column]:
    """Centred image position of a world direction; NULL behind the camera."""
    x, y, z = _mul(rot, d)
    z = F.when(z > 1e-9, z)
    return focal * x / z, focal * y / z


def cam_ray(rot: Column, focal: Column, cx: Column, cy: Column) -> Vec3:
    """Unit world direction through a centred image position."""
    d = _mul_t(rot, (cx / focal, cy / focal, F.lit(1.0)))
    norm = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return d[0] / norm, d[1] / norm, d[2] / norm


def cam_homography(rot_i: Column, focal_i: Column, rot_j: Column, focal_j: Column) -> Column:
    """K_i R_i R_j^T K_j^-1: centred positions of camera j into those of camera i."""
    entries: list[Column] = []
    row_scale: Sequence[Column] = (focal_i, focal_i, F.lit(1.0))
    col_scale: Sequence[Column] = (F.lit(1.0) / focal_j, F.lit(1.0) / focal_j, F.lit(1.0))
    for r in range(3):
        for c in range(3):
            dot = sum((rot_i[3 * r + k] * rot_j[3 * c + k] for k in range(1, 3)),
                      rot_i[3 * r] * rot_j[3 * c])
            entries.append(row_scale[r] * dot * col_scale[c])
    return F.array(*entries)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def ray_angles(d: Vec3) -> tuple[Column, Column]:
    """Azimuth and elevation of a unit direction; the vertical axis points down."""
    return F.atan2(d[0], d[2]), F.asin(clamp(-d[1], -1.0, 1.0))


def angles_ray(theta: Column, phi: Column) -> Vec3:
    return F.sin(theta) * F.cos(phi), -F.sin(phi), F.cos(theta) * F.cos(phi)


PHI_LIMIT = 1.4
PANNINI_FLOOR = 0.2


def proj_forward(kind: Column, theta: Column, phi: Column) -> tuple[Column, Column]:
    """Angles to plane coordinates for 'spherical', 'cylindrical' and 'pannini' (d = 1)."""
    tan_phi = F.tan(clamp(phi, -PHI_LIMIT, PHI_LIMIT))
    den = F.greatest(F.lit(1.0) + F.cos(theta), F.lit(PANNINI_FLOOR))
    u = F.when(kind == "pannini", F.lit(2.0) * F.sin(theta) / den).otherwise(theta)
    v = (F.when(kind == "spherical", phi)
         .when(kind == "cylindrical", tan_phi)
         .otherwise(F.lit(2.0) * tan_phi / den))
    return u, v


def proj_inverse(kind: Column, u: Column, v: Column) -> tuple[Column, Column]:
    wide = F.asin(clamp(u / F.sqrt(F.lit(4.0) + u * u), -1.0, 1.0)) - F.atan2(-u, F.lit(2.0))
    theta = F.when(kind == "pannini", wide).otherwise(u)
    phi = (F.when(kind == "spherical", v)
           .when(kind == "cylindrical", F.atan(v))
           .otherwise(F.atan(v * (F.lit(1.0) + F.cos(wide)) / 2)))
    return theta, phi


def pixel_to_ray(kind: Column, u_min: Column, v_max: Column, scale: Column,
                 px: Column, py: Column) -> Vec3:
    """World direction of an output pixel centre; row 0 is the top of the frame."""
    theta, phi = proj_inverse(kind, u_min + (px + 0.5) / scale, v_max - (py + 0.5) / scale)
    return angles_ray(theta, phi)


def ray_to_pixel(kind: Column, u_min: Column, v_max: Column, scale: Column,
                 d: Vec3) -> tuple[Column, Column]:
    u, v = proj_forward(kind, *ray_angles(d))
    return (u - u_min) * scale - 0.5, (v_max - v) * scale - 0.5
