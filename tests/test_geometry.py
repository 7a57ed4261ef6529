import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import u
from tessera.functions.similarity import sim
from tessera.operators import placement, positions, solve, surface
from tessera.operators.solve import conjugate_gradient, eliminate, solve_spd, solve_status

POS = "set_id long, source_id long, lat double, lon double"
LONS = [-80.80300, -80.80327, -80.80354, -80.80381, -80.80462]


def walk(spark):
    return spark.createDataFrame([(1, k, 32.1150, lon) for k, lon in enumerate(LONS)]
                                 + [(2, 0, 32.1150, -80.80300), (2, 1, 32.11503, -80.80302), (3, 0, 1.0, 1.0)], POS)


def brute(points):
    def dist(p, q):
        x = math.radians(q[1] - p[1]) * math.cos(math.radians((p[0] + q[0]) / 2))
        return math.hypot(x, math.radians(q[0] - p[0])) * 6_371_000
    near, far = {}, 0.0
    for i, p in points.items():
        ds = [dist(p, q) for j, q in points.items() if j != i]
        if ds:
            near[i] = min(ds)
            far = max(far, max(ds))
    return near, far


def test_walk_distances_step_notes_summary(spark):
    pos = walk(spark)
    near = positions.nearest_neighbor(pos)
    got = {(r.set_id, r.source_id): r.nearest for r in near.collect()}
    assert [got[1, k] for k in range(5)] == pytest.approx([25.4287] * 4 + [76.2860], abs=1e-3)
    assert (3, 0) not in got
    spread = positions.gps_spread(pos)
    s = {r.set_id: r.spread for r in spread.collect()}
    assert s[1] == pytest.approx(152.572, abs=1e-2) and set(s) == {1, 2}
    step = positions.typical_step(near)
    assert {r.set_id: r.step for r in step.collect()}[1] == pytest.approx(25.4287, abs=1e-3)
    lost = spark.createDataFrame([(1, 1, "IMG_1"), (1, 4, "IMG_4"), (2, 0, "x")], "set_id long, source_id long, name string")
    notes = positions.gap_notes(lost, near, step).collect()
    assert [(r.set_id, r.source_id) for r in notes] == [(1, 4)]
    assert (notes[0].name, notes[0].status, round(notes[0].nearest), round(notes[0].ratio, 1)) == ("IMG_4", "apart", 76, 3.0)
    totals = spark.createDataFrame([(1, 7), (2, 2)], "set_id long, total long")
    told = {r.set_id: (r.status, r.placed, r.total, r.missing) for r in positions.gps_summary(pos, totals, spread, step).collect()}
    assert told[1] == ("moving", 5, 7, 2) and told[2] == ("standing", 2, 2, 0)


def test_upper_median(spark):
    near = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate((4, 2, 1, 3))], "set_id long, source_id long, nearest double")
    assert positions.typical_step(near).first().step == 3.0


@pytest.mark.parametrize("buckets, leaf", [(4, 3), (1024, 4096)])
def test_upper_median_by_counting(spark, buckets, leaf):
    rng = np.random.default_rng(8)
    sets = {1: rng.exponential(size=301) ** 8, 2: np.r_[np.full(50, 2.5), 1.0, 9.0], 3: np.full(40, 7.0), 4: np.array([5.0]),
            5: np.r_[np.zeros(9), 1e-300, 1e300, 1e299]}
    rows = [(k, i, float(v)) for k, vs in sets.items() for i, v in enumerate(vs)] + [(6, 0, None), (4, 1, None)]
    got = positions.typical_step(spark.createDataFrame(rows, "set_id long, source_id long, nearest double"), buckets, leaf).collect()
    assert {r.set_id: r.step for r in got} == {k: float(np.sort(v)[len(v) // 2]) for k, v in sets.items()} and len(got) == 5


def test_start_levels_are_the_coarsest_roomy_cells(spark):
    rng = np.random.default_rng(5)
    spots = [(1, *p) for p in rng.uniform((-90, -180), (90, 180), size=(150, 2))] + [(1, *p) for p in rng.normal((10, 20), 1e-6, size=(150, 2))]
    spots += [(2, *p) for p in rng.uniform(-1, 1, size=(5, 2))] + [(3, 50 + k * 1e-13, 7.0) for k in range(40)]
    spots = list({(int(s), float(a), float(b)) for s, a, b in spots})

    def cell(s, a, b, level):
        size = 4.0 ** level * positions.FINEST_DEG
        return (s, math.floor(a / size), math.floor(b / size)) if level < positions.LEVELS - 1 else s

    counts = [Counter(cell(*p, level) for p in spots) for level in range(positions.LEVELS)]
    want = {p: max([lv for lv in range(positions.LEVELS) if counts[lv][cell(*p, lv)] <= 8], default=0) for p in spots}
    df = spark.createDataFrame(spots, "set_id long, lat double, lon double").repartition(5)
    for run in (16, 4096):
        got = {(r.set_id, r.lat, r.lon): r.start for r in positions.start_levels(df, 8, run).collect()}
        assert got == want


def test_positions_match_brute_force_with_clusters_and_twins(spark):
    rng = np.random.default_rng(2)
    pts = [(float(a), float(b)) for a, b in rng.uniform(-60, 60, size=(60, 2))]
    pts += [(10 + float(a), 20 + float(b)) for a, b in rng.normal(scale=1e-5, size=(200, 2))]
    pts += [pts[0], pts[70], (80.0, 170.0)]
    points = dict(enumerate(pts))
    pos = spark.createDataFrame([(1, k, *p) for k, p in points.items()], POS)
    near, far = brute(points)
    got = {r.source_id: r.nearest for r in positions.nearest_neighbor(pos).collect()}
    assert got.keys() == near.keys()
    assert max(abs(got[k] - near[k]) for k in near) < 1e-6
    assert positions.gps_spread(pos, block=40).first().spread == pytest.approx(far, abs=1e-6)


TRUTH = [(1, .010, 0, 0), (1.02, -.020, 700, 10), (.98, .015, 1380, -6), (1, -.005, 2100, 4)]


def chain(spark):
    rows = []
    for i, j in ((0, 1), (1, 2), (2, 3), (0, 2)):
        for k in range(15):
            lo, hi = 700 * max(i, j) + 50, 700 * min(i, j) + 1950
            x = lo + (hi - lo) * u("f2", i, j, k, "x")
            y = 100 + 800 * u("f2", i, j, k, "y")
            ends = []
            for s, ex, ey in ((i, "px", "py"), (j, "qx", "qy")):
                sc, rot, tx, ty = TRUTH[s]
                z = complex(x - tx, y - ty) / (sc * complex(math.cos(rot), math.sin(rot)))
                ends += [z.real - .3 + .6 * u("f2", i, j, k, ex), z.imag - .3 + .6 * u("f2", i, j, k, ey)]
            rows.append((1, 0, i, j, *ends))
    return spark.createDataFrame(rows, "set_id long, component long, i long, j long, px double, py double, qx double, qy double")


def test_chain_placement(spark):
    placed, quality = placement.place_similarity(chain(spark))
    q = quality.first()
    assert q.rms == pytest.approx(0.299468, abs=1e-5)
    t = {r.source_id: complex(r.t.a, r.t.b) for r in placed.collect()}
    assert sum(math.atan2(z.imag, z.real) for z in t.values()) == pytest.approx(0, abs=1e-6)
    assert sum(math.log(abs(z)) for z in t.values()) == pytest.approx(0, abs=1e-6)
    assert [abs(t[k]) for k in range(4)] == pytest.approx([.999946, 1.020071, .980232, 1.000147], abs=2e-6)
    res = placement.placement_residuals(chain(spark), placed)
    m = placement.residual_metrics(res, ["set_id"], 3.0).first()
    assert m.n == 60 and m.rms < 1 and m.mean_weight == 1.0


def test_large_systems_agree_with_dense(spark):
    rng = np.random.default_rng(4)
    rows, right, want = [], [], {}
    for g in (1, 2):
        a = rng.normal(size=(30, 30))
        a = a @ a.T + np.eye(30)
        b = rng.normal(size=30)
        want[g] = np.linalg.solve(a, b)
        rows += [(g, i, j, float(a[i, j])) for i in range(30) for j in range(30)]
        right += [(g, i, float(b[i])) for i in range(30)]
    e = spark.createDataFrame(rows, "g long, i long, j long, val double")
    r = spark.createDataFrame(right, "g long, i long, b double")
    for limit in (100, 0):
        if limit == 0:
            e2, r2 = e.filter("g = 1 and i < 6 and j < 6"), r.filter("g = 1 and i < 6")
            m = np.array([[x.val for x in sorted(e2.filter(f"i={i}").collect(), key=lambda x: x.j)] for i in range(6)])
            ref = np.linalg.solve(m, [x.b for x in sorted(r2.collect(), key=lambda x: x.i)])
            got = {x.i: x.b for x in solve_spd(e2, r2, ["g"], ["b"], task_entries=0).collect()}
            assert [got[i] for i in range(6)] == pytest.approx(list(ref), rel=1e-6)
        else:
            got = {(x.g, x.i): x.b for x in solve_spd(e, r, ["g"], ["b"]).collect()}
            assert all(got[g, i] == pytest.approx(want[g][i], rel=1e-8) for g in want for i in range(30))


def spd(spark, blocks: dict, right: dict):
    """Systems given as {key: matrix} and {key: right-hand sides} as tables."""
    cells = [(g, int(i), int(j), float(m[i, j])) for g, m in blocks.items() for i, j in zip(*np.nonzero(m))]
    sides = [(g, i, *map(float, row)) for g, r in right.items() for i, row in enumerate(r)]
    return spark.createDataFrame(cells, "g long, i long, j long, val double"), spark.createDataFrame(sides, "g long, i long, b double, c double")


@pytest.mark.parametrize("block, limit", [(1, 300), (4, 0)])
def test_systems_cut_down_by_blocks(spark, block, limit):
    """A mesh, a star, loose parts and a ragged last block, all far beyond what a task takes, beside a singular system."""
    rng = np.random.default_rng(block)
    n = 61
    mesh, star, loose = np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, n))
    for m, pairs in ((mesh, [(i, i + 1) for i in range(n - 1) if i % 8 != 7] + [(i, i + 8) for i in range(n - 8)]), (star, [(0, i) for i in range(1, n)]), (loose, [(i, i + 1) for i in range(0, n - 1, 5)])):
        for i, j in pairs:
            m[[i, j], [j, i]] = rng.normal()
        m += np.diag(np.abs(m).sum(axis=1) + 0.1)
    flat = mesh - np.diag(mesh.diagonal())
    flat = np.diag(np.abs(flat).sum(axis=1)) - np.abs(flat)  # a Laplacian
    systems = {1: mesh, 2: star, 3: loose, 4: flat}
    right = {g: rng.normal(size=(n, 2)) for g in systems}
    e, r = spd(spark, systems, right)
    out = solve_spd(e, r, ["g"], ["b", "c"], task_entries=limit, block=block)
    got = {(x.g, x.i): (x.b, x.c) for x in out.collect()}
    assert len(got) == 3 * n
    for g in (1, 2, 3):
        want = np.linalg.solve(systems[g], right[g])
        assert np.allclose([got[g, i] for i in range(n)], want, rtol=1e-7, atol=1e-9)
    status = {x.g: (x.n_unknowns, x.state) for x in solve_status(r, out, ["g"]).collect()}
    assert status == {1: (n, "solved"), 2: (n, "solved"), 3: (n, "solved"), 4: (n, "unsolved")}


def test_chain_of_100000_is_solved(spark):
    from pyspark.sql import functions as F

    n = 100_000
    at = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") * 7919 % n).alias("i"))
    steps = at.select("g", "i", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d")).select(
        "g", "i", (F.col("i") + F.col("d")).alias("j"), F.when(F.col("d") == 0, 2.0001).otherwise(-1.0).alias("val")).filter(f"j >= 0 AND j < {n}")
    want = F.sin(F.col("i") / 997.0)
    sides = steps.select("g", "i", (F.col("val") * F.sin(F.col("j") / 997.0)).alias("b"))
    out = solve_spd(steps, sides, ["g"], ["b"], task_entries=120_000)
    told = out.agg(F.count("*").alias("n"), F.max(F.abs(F.col("b") - want)).alias("off")).first()
    assert told.n == n and told.off < 1e-6


def test_conjugate_gradients_stop_only_when_stuck(spark):
    n = 40
    m = np.diag(np.full(n, 2.0)) - np.diag(np.ones(n - 1), 1) - np.diag(np.ones(n - 1), -1)
    e, r = spd(spark, {1: m}, {1: np.ones((n, 2))})
    got = {x.i: x.x for x in conjugate_gradient(e, r.select("g", "i", "b"), ["g"], tol=1e-9).collect()}
    assert np.allclose([got[i] for i in range(n)], np.linalg.solve(m, np.ones(n)), rtol=1e-6)


def test_placement_is_the_same_however_small_a_task(spark):
    rows = []
    for i in range(60):
        for j in (i + 1, i + 2):
            if j < 60:
                for k in range(5):
                    x, y = 37.0 * k + 11 * i % 50, 91.0 * (k % 3)
                    rows.append((1, 1, i, j, x + 100 * (j - i), y, x + 0.01 * ((i * 7 + k) % 5), y + 0.01 * ((j * 3 + k) % 7)))
    obs = spark.createDataFrame(rows, "set_id long, component long, i long, j long, px double, py double, qx double, qy double")
    whole, cut_down = ({r.source_id: tuple(r.t) for r in placement.place_similarity(obs, passes=1, task_entries=limit)[0].collect()} for limit in (1_500_000, 600))
    assert len(whole) == 60 and all(cut_down[k] == pytest.approx(v, abs=1e-6) for k, v in whole.items())


def test_groups_that_fit_a_task_are_placed_there_with_the_same_result(spark):
    from tessera.session import written

    obs = chain(spark).unionByName(chain(spark).selectExpr("2 as set_id", "component", "i + 7 as i", "j + 7 as j", "px", "py", "qx + (i + j) % 2 * 9 as qx", "qy"))
    obs = obs.unionByName(obs.filter("set_id = 1").selectExpr("3 as set_id", "component", "i", "j", "5D as px", "5D as py", "5D as qx", "5D as qy"))  # singular
    before = len(written())
    placed, quality = placement.place_similarity(obs)
    assert len(written()) - before == 2  # not some for each pass
    slow, told = placement.place_similarity(obs, group_rows=0)
    some, few = placement.place_similarity(obs.filter("set_id = 1").unionByName(obs.filter("set_id = 2")).unionByName(obs.filter("set_id = 2").withColumn("set_id", F.lit(4))
                                           .unionByName(obs.filter("set_id = 2").withColumn("set_id", F.lit(4)))), group_rows=100)
    want = {(r.set_id, r.source_id): tuple(r.t) for r in slow.collect()}
    assert {k for k, _ in want} == {1, 2}
    got = {(r.set_id, r.source_id): tuple(r.t) for r in placed.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    both = {(r.set_id, r.source_id): tuple(r.t) for r in some.collect()}
    assert {k for k, _ in both} == {1, 2, 4} and all(both[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    assert all(both[4, s] == pytest.approx(v, abs=1e-6) for (k, s), v in want.items() if k == 2)
    rms = {r.set_id: (r.n, r.rms) for r in told.collect()}
    assert {r.set_id: (r.n, pytest.approx(r.rms, abs=1e-9)) for r in quality.collect()} == rms and {r.set_id for r in few.collect()} == {1, 2, 4}


def test_elimination_takes_long_chains_and_tells_singular_ones():
    rng = np.random.default_rng(3)
    cells: dict = {}
    for k in range(1999):  # a chain of 2000 sources with four unknowns each
        part = rng.normal(size=(6, 8))
        part = part.T @ part
        for a in range(8):
            for b in range(8):
                at = 4 * k + a, 4 * k + b
                cells[at] = cells.get(at, 0.0) + part[a, b]
    i, j = (np.array([c[x] for c in cells]) for x in (0, 1))
    v, right = np.array(list(cells.values())), rng.normal(size=(8000, 1))
    x = eliminate(i, j, v, right)
    left = np.bincount(i, v * x[j, 0], 8000)
    assert np.abs(left - right[:, 0]).max() < 1e-6
    flat = np.ones((2, 2))
    assert eliminate(*np.nonzero(flat), flat.ravel(), np.ones((2, 1))) is None
    wide = rng.normal(size=(90, 90))
    wide = wide @ wide.T + np.eye(90)  # more coupled than the sparse part takes
    r, c = np.nonzero(wide)
    assert np.allclose(wide @ eliminate(r, c, wide[r, c], np.ones((90, 2))), 1.0)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_singular_system_does_not_touch_others(spark, limit):
    e = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 1.0), (1, 1, 0, 1.0), (1, 1, 1, 1.0), (2, 0, 0, 2.0), (2, 1, 1, 4.0)], "g long, i long, j long, val double")
    r = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 2.0), (2, 1, 2.0)], "g long, i long, b double")
    got = {(x.g, x.i): x.b for x in solve_spd(e, r, ["g"], ["b"], task_entries=limit).collect()}
    assert got == {(2, 0): 1.0, (2, 1): 0.5}


def test_placement_with_very_large_ids(spark):
    base = 1 << 62
    rows = [(1, 1, base + i, base + i + 1, 100.0 + 10 * k, 5.0 * k, 10.0 * k, 5.0 * k) for i in range(5) for k in range(6)]
    obs = spark.createDataFrame(rows, "set_id long, component long, i long, j long, px double, py double, qx double, qy double")
    placed, quality = placement.place_similarity(obs)
    got = {r.source_id: r.t for r in placed.collect()}
    assert sorted(got) == [base + i for i in range(6)] and quality.first().rms < 1e-6
    assert [got[base + i + 1].tx - got[base + i].tx for i in range(5)] == pytest.approx([100.0] * 5)


def rig(spark, pans=(-0.5, 0.0, 0.5), focal=800.0, w=1200, h=900):
    rows = []
    for k, p in enumerate(pans):
        c, s = math.cos(p), math.sin(p)
        rows.append((1, k, [c, 0.0, -s, 0.0, 1.0, 0.0, s, 0.0, c], focal, w, h))
    return spark.createDataFrame(rows, "set_id long, source_id long, rot array<double>, focal double, width int, height int")


def test_true_cameras_have_no_residual(spark):
    from tessera.functions.projective import cam_project
    cams = rig(spark)
    world = spark.range(100).select(((F.col("id") % 10) / 5 - 0.9).alias("t"), (F.floor(F.col("id") / 10) / 11 - 0.45).alias("p"))
    d = (F.sin("t") * F.cos("p"), -F.sin("p"), F.cos("t") * F.cos("p"))
    seen = cams.join(world).select("*", *[c.alias(n) for c, n in zip(cam_project(F.col("rot"), F.col("focal"), d), ("x", "y"))])
    seen = seen.filter("abs(x) < 600 and abs(y) < 450").select("set_id", "source_id", "t", "p", "x", "y")
    a = seen.select("set_id", F.col("source_id").alias("a"), "t", "p", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = seen.select("set_id", F.col("source_id").alias("b"), "t", "p", F.col("x").alias("bx"), F.col("y").alias("by"))
    obs = a.join(b, ["set_id", "t", "p"]).filter("a <> b").select("set_id", "a", "b", "ax", "ay", "bx", "by")
    m = placement.residual_metrics(placement.camera_residuals(obs, cams), ["set_id"], 2.0, "usable").first()
    assert m.n > 50 and m.rms < 1e-9
    none = placement.residual_metrics(obs.limit(1).selectExpr("set_id", "ax rx", "ay ry", "false ok"), ["set_id"], 2.0, "ok").first()
    assert none.rms == float("inf") and none.loss == 1e6


def test_frames_and_projection_choice(spark):
    for pans, focal, kind in (((-.4, .4), 700.0, "pannini"), ((-1.5, 0.0, 1.5), 700.0, "spherical")):
        f = placement.angular_frame(rig(spark, pans, focal, 800, 600), F.lit("spherical"), 1000, ["set_id"])
        r = f.select("*", placement.auto_projection(F.col("theta_max") - F.col("theta_min")).alias("kind")).first()
        assert r.kind == kind and r.out_width == 1000
    flat = spark.createDataFrame([(1, 0, 0.0, 0.0, 200, 100), (1, 1, 150.0, 20.0, 200, 100)],
                                 "set_id long, source_id long, tx double, ty double, width int, height int")
    flat = flat.withColumn("t", sim(F.lit(1.0), F.lit(0.0), F.col("tx"), F.col("ty")))
    f = placement.frame_extent(flat, 350, ["set_id"])
    r = f.first()
    assert (r.extent_x, r.extent_y, r.scale, r.out_width, r.out_height) == (350, 120, 1.0, 350, 120)
    half = placement.rescale_frame(f, 175).first()
    assert (half.out_width, half.out_height) == (175, 60)
    w = spark.range(1).select(placement.natural_width(F.lit(1.2), F.lit(3000.0), 12000).alias("a"),
                              placement.natural_width(F.lit(None).cast("double"), F.lit(1.0), 12000).alias("b"),
                              placement.natural_width(F.lit(10.0), F.lit(3000.0), 12000).alias("c"),
                              placement.working_width(F.lit(10.0)).alias("d"), placement.working_width(F.lit(1.0)).alias("e")).first()
    assert (w.a, w.b, w.c, w.d, w.e) == (3600, 4000, 12000, 1660, 700)


def test_mesh_interpolation(spark):
    mesh = spark.createDataFrame([(1, 0, r, c, 8.0 if (r, c) == (1, 1) else 0.0, -4.0 if (r, c) == (1, 1) else 0.0)
                                  for r in range(3) for c in range(3)],
                                 "set_id long, source_id long, vr int, vc int, dx double, dy double")
    pts = spark.createDataFrame([(1, 0, 0, 50.0, 100.0, 200, 200), (1, 0, 1, 100.0, 100.0, 200, 200)],
                                "set_id long, source_id long, pid long, x double, y double, width int, height int")
    got = {r.pid: (r.ox, r.oy) for r in surface.mesh_offset(pts, mesh, ["pid"], 100).collect()}
    assert got == {0: (4.0, -2.0), 1: (8.0, -4.0)}
    assert surface.mesh_max_offset(mesh).first().max_offset == pytest.approx(math.hypot(8, 4))


def test_offset_surface_absorbs_a_local_bump(spark):
    rows = []
    for x in range(40, 800, 40):
        for y in range(40, 600, 40):
            d = math.hypot(x - 250, y - 300)
            bump = 6 * max(0.0, 1 - d / 140)
            rows.append((1, 0, 1, float(x), float(y), x + bump, y + 0.4 * bump))
    obs = spark.createDataFrame(rows, "set_id long, i long, j long, px double, py double, qx double, qy double")
    src = spark.createDataFrame([(1, 0, 800, 600), (1, 1, 800, 600)], "set_id long, source_id long, width int, height int")
    src = src.withColumn("t", sim(1.0, 0.0, 0.0, 0.0))
    mesh, metrics = surface.fit_offset_surface(obs, src, spacing=80)
    m = {r.stage: r.rms for r in metrics.collect()}
    assert m["after"] < m["before"] / 3
    assert m["before"] == pytest.approx(1.00172, abs=0.05) and m["after"] == pytest.approx(0.26618, abs=0.02)
    far = spark.createDataFrame([(1, 0, 0, 700.0, 100.0, 800, 600)],
                                "set_id long, source_id long, pid long, x double, y double, width int, height int")
    off = surface.mesh_offset(far, mesh, ["pid"], 80).first()
    assert math.hypot(off.ox, off.oy) < 0.75


def test_banded_factors_agree_with_dense():
    rng = np.random.default_rng(8)
    n, w = 37, 6
    systems, right = [], rng.normal(size=(3, n, 2))
    for _ in range(3):
        m = np.triu(np.tril(rng.normal(size=(n, n)), w), -w)
        m = m @ m.T
        m = np.triu(np.tril(m, w), -w) + 40 * np.eye(n)
        systems.append(m)
    factors = np.stack([surface.band_factor(*np.nonzero(m), m[np.nonzero(m)], n, w) for m in systems])
    assert np.allclose(surface.band_solve(factors, right), [np.linalg.solve(m, r) for m, r in zip(systems, right)])
    flat = np.ones((3, 3))
    assert surface.band_factor(*np.nonzero(flat), flat.ravel(), 3, 2) is None


def test_wide_meshes_take_the_general_solver(spark):
    rows = [(1, 0, 1, float(x), float(y), x + 3.0 * (x < 300), y - 1.0) for x in range(40, 800, 80) for y in range(40, 600, 80)]
    obs = spark.createDataFrame(rows, "set_id long, i long, j long, px double, py double, qx double, qy double")
    src = spark.createDataFrame([(1, 0, 800, 600), (1, 1, 800, 600), (1, 2, 800, 600)], "set_id long, source_id long, width int, height int").withColumn("t", sim(1.0, 0.0, 0.0, 0.0))
    banded, general = (sorted(map(tuple, surface.fit_offset_surface(obs, src, spacing=200, sweeps=2, band_cells=c)[0].collect())) for c in (4_000_000, 1))
    assert len(banded) == 3 * 20 and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(banded, general))
    assert all(r[4] == r[5] == 0.0 for r in banded if r[1] == 2) and any(abs(r[4]) > 0.1 for r in banded)


def test_small_sets_run_their_sweeps_in_one_task(spark, monkeypatch):
    # sets of several shapes, one whose matrix is singular without rigidity, a source that nothing touches, a partner without placement
    rows = []
    for s in range(6):
        for x in range(40, 800, 80):
            for y in range(40, 600, 80):
                rows.append((s, 0, 1, float(x), float(y), x + 2.0 * (x < 300 + 20 * s), y - 1.0 - 0.1 * s))
                rows.append((s, 1, 2, float(x), float(y), x + 0.02 * y, y + 0.5))
        rows.append((s, 0, 9, 1.0, 1.0, 1.0, 1.0))
    obs = spark.createDataFrame(rows, "set_id long, i long, j long, px double, py double, qx double, qy double")
    flat = spark.createDataFrame([(s, k, 800 + 30 * s * k, 600) for s in range(7) for k in range(4)], "set_id long, source_id long, width int, height int")
    rot = [F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    for placed in (flat.withColumn("t", sim(1.001, 0.002, 0.3, 0.0)), flat.withColumn("rot", F.array(*rot)).withColumn("focal", F.col("source_id") * 2 + 700.0)):
        for rigid in (0.02, 0.0):
            met = [surface.fit_offset_surface(obs, placed, spacing=200, sweeps=3, rigidity=rigid, smoothness=rigid * 50, set_rows=rows) for rows in (1, 100_000)]
            swept, once = (sorted(map(tuple, m.collect())) for m, _ in met)
            assert len(once) == len(swept) and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(once, swept))
            swept, once = ({(r.set_id, r.stage): r.rms for r in m.collect()} for _, m in met)
            assert once == pytest.approx(swept, abs=1e-9) and len(once) >= 8
    monkeypatch.setattr(surface, "_by_sweeps", None)
    assert surface.fit_offset_surface(obs, flat.withColumn("t", sim(1.0, 0.0, 0.0, 0.0)), spacing=200, sweeps=1)[0].count() > 0


def test_offset_surface_of_cameras(spark):
    cams = rig(spark, (-0.1, 0.1), 800.0, 800, 600)
    rows = []
    turn = [np.array(r.rot).reshape(3, 3) for r in sorted(cams.collect(), key=lambda r: r.source_id)]
    for x in range(330, 800, 30):
        for y in range(30, 600, 30):
            d = turn[0].T @ np.array([(x - 400) / 800, (y - 300) / 800, 1.0])
            v = turn[1] @ d
            qx, qy = 800 * v[0] / v[2] + 400, 800 * v[1] / v[2] + 300
            bump = 6 * max(0.0, 1 - math.hypot(x - 550, y - 300) / 140)
            if 0 <= qx < 800 and 0 <= qy < 600:
                rows.append((1, 0, 1, float(x), float(y), float(qx + bump), float(qy + 0.4 * bump)))
    obs = spark.createDataFrame(rows, "set_id long, i long, j long, px double, py double, qx double, qy double")
    _, metrics = surface.fit_offset_surface(obs, cams, spacing=80)
    m = {r.stage: r.rms for r in metrics.collect()}
    assert len(rows) > 100 and 0.5 < m["before"] and m["after"] < m["before"] / 3


def test_a_large_system_of_unconnected_parts_is_solved_part_by_part(spark):
    # three chains of 40 unknowns with interleaved numbers, and a second system with one singular part
    rows, rhs = [], []
    for k in (1, 2):
        for p in range(3):
            ids = [p + 3 * n for n in range(40)]
            for n, i in enumerate(ids):
                rows.append((k, i, i, 1.0 if (k, p) == (2, 1) and n in (0, 39) else 2.0 if (k, p) == (2, 1) else 3.0))
                rhs.append((k, i, float(i + k)))
                if n:
                    rows += [(k, i, ids[n - 1], -1.0), (k, ids[n - 1], i, -1.0)]
    a = spark.createDataFrame(rows, "set_id long, i long, j long, val double")
    b = spark.createDataFrame(rhs, "set_id long, i long, b double")
    got = {(r["set_id"], r["i"]): r["b"] for r in solve._solve_parts(a, b, ["set_id"], ["b"], 150, 1e-11, 1).collect()}
    m, y = np.zeros((120, 120)), np.zeros(120)
    for k, i, j, v in rows:
        if k == 1:
            m[i, j] += v
    for k, i, v in rhs:
        if k == 1:
            y[i] = v
    want = np.linalg.solve(m, y)
    assert got.keys() == {(1, i) for i in range(120)}
    assert [got[1, i] for i in range(120)] == pytest.approx(want.tolist())


def test_mesh_offset_meets_a_point_with_its_mesh_once(spark):
    # source 1 lacks a vertex, source 2 has one in two rows that add up, source 3 has none; key 0 is in two sources
    mesh = [(1, 1, r, c, float(10 * r + c), float(r - c)) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    mesh += [(1, 2, r, c, 1.0, 2.0) for r in range(3) for c in range(3)] + [(1, 2, 2, 2, 5.0, 0.0)]
    points = [(1, 1, 0, 30.0, 60.0), (1, 2, 0, 150.0, 150.0), (1, 1, 1, 100.0, 100.0), (1, 1, 2, 250.0, -5.0), (1, 3, 3, 10.0, 10.0), (1, 2, 4, 199.0, 180.0)]
    p = spark.createDataFrame([(*r, 200, 200) for r in points], "set_id long, source_id long, id long, x double, y double, width int, height int")
    m = spark.createDataFrame(mesh, "set_id long, source_id long, vr int, vc int, dx double, dy double")
    out = surface.mesh_offset(p, m, ["set_id", "id"], 100)
    got = {r["id"]: (r["ox"], r["oy"]) for r in out.collect()}
    want = {}
    for _, s, k, x, y in points:
        gx, gy = min(max(x, 0), 200) / 100, min(max(y, 0), 200) / 100
        c0, r0 = min(int(gx), 1), min(int(gy), 1)
        for r, c in ((r0, c0), (r0, c0 + 1), (r0 + 1, c0), (r0 + 1, c0 + 1)):
            w = (1 - abs(gx - c)) * (1 - abs(gy - r))
            for _, ms, mr, mc, dx, dy in mesh:
                if (ms, mr, mc) == (s, r, c):
                    a, b = want.get(k, (0.0, 0.0))
                    want[k] = (a + w * dx, b + w * dy)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    # points are not multiplied: every row that is joined is one of the points
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(array(named_struct" not in plan and "Generate explode(array(struct" not in plan
