import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import h
from tessera.functions import plane, projective, similarity as S


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_similarity_round_trips(spark):
    t = S.sim_from_polar(F.lit(1.3), F.lit(0.4), F.lit(5.0), F.lit(-7.0))
    back = S.sim_compose(S.sim_inverse(t), t)
    x, y = S.sim_apply(t, F.lit(3.0), F.lit(4.0))
    hx, hy = projective.h_apply(S.sim_to_h(t), F.lit(3.0), F.lit(4.0))
    again = S.h_to_sim(S.sim_to_h(t))
    r = one(spark, a=back["a"], b=back["b"], tx=back["tx"], ty=back["ty"], dx=x - hx, dy=y - hy,
            s=S.sim_scale(t), rot=S.sim_rotation(t), ra=again["a"] - t["a"],
            bad=S.h_to_sim(F.array(*[F.lit(v) for v in (1., 0., 0., 0., 1., 0., .1, 0., 1.)])))
    assert (r.a, r.b, r.tx, r.ty) == pytest.approx((1, 0, 0, 0), abs=1e-12)
    assert (r.dx, r.dy, r.ra) == pytest.approx((0, 0, 0), abs=1e-12)
    assert (r.s, r.rot) == pytest.approx((1.3, 0.4))
    assert r.bad is None


def test_homography_at_infinity_is_null(spark):
    m = F.array(*[F.lit(v) for v in (1., 0., 0., 0., 1., 0., 1., 0., 0.)])
    x, _ = projective.h_apply(m, F.lit(0.0), F.lit(1.0))
    assert one(spark, x=x).x is None


@pytest.mark.parametrize("kind", ["spherical", "cylindrical", "pannini"])
def test_projection_round_trip(spark, kind):
    grid = spark.range(15).select((F.col("id") / 10 - 0.7).alias("t"), (F.col("id") % 5 / 5 - 0.4).alias("p"))
    u, v = projective.proj_forward(F.lit(kind), F.col("t"), F.col("p"))
    t, p = projective.proj_inverse(F.lit(kind), F.col("u"), F.col("v"))
    err = grid.withColumns({"u": u, "v": v}).select(F.max(F.abs(t - F.col("t")) + F.abs(p - F.col("p")))).first()[0]
    assert err < 1e-9


def test_camera_projects_its_own_rays(spark):
    c, s = math.cos(0.5), math.sin(0.5)
    rot = F.array(*[F.lit(v) for v in (c, 0., -s, 0., 1., 0., s, 0., c)])
    d = projective.cam_ray(rot, F.lit(800.0), F.lit(120.0), F.lit(-45.0))
    x, y = projective.cam_project(rot, F.lit(800.0), d)
    behind, _ = projective.cam_project(rot, F.lit(800.0), tuple(-k for k in d))
    r = one(spark, x=x, y=y, n=d[0] * d[0] + d[1] * d[1] + d[2] * d[2], behind=behind)
    assert (r.x, r.y, r.n) == pytest.approx((120, -45, 1))
    assert r.behind is None


def test_unit_clip_tent_distance_hash(spark):
    vec = F.array(*[F.lit(float(v)) for v in (10, 1, 1, 1)])
    r = one(spark, v=plane.vec_unit_clip(vec), zero=plane.vec_unit_clip(F.array(F.lit(0.0), F.lit(0.0))),
            tent=plane.tent_weight(F.lit(50.0), F.lit(25.0), F.lit(100), F.lit(50)),
            edge=plane.tent_weight(F.lit(0.0), F.lit(25.0), F.lit(100), F.lit(50), 1e-5),
            d=plane.ground_distance(F.lit(32.115), F.lit(-80.80300), F.lit(32.115), F.lit(-80.80400)),
            hh=plane.hash_int(1, 2, 3))
    raw = np.array([10, 1, 1, 1.0])
    unit = np.minimum(raw / np.linalg.norm(raw), 0.2)
    assert r.v == pytest.approx(list(unit / np.linalg.norm(unit)))
    assert r.zero == [0, 0]
    assert (r.tent, r.edge) == (1.0, 1e-5)
    assert r.d == pytest.approx(94.3, abs=0.2)
    assert r.hh == h(1, 2, 3) == 1161707629
