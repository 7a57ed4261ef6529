import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.similarity import sim
from tessera.operators import (blending, coverage, extrema, grids, histograms, overlap, ownership, placement, regrid)
from tessera.plans.composite import composite
from tessera.session import cut, written


def table(spark, a, gid=1):
    h, w = a.shape
    rows = [(gid, y, x, float(a[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "grid_id long, y int, x int, v double")


def array(df, h, w, value="v"):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[value]
    return out


def blur(a, sigma):
    taps = grids.gaussian_taps(sigma)
    r = len(taps) // 2
    for axis in (1, 0):
        pad = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(2)], mode="edge")
        a = sum(t * np.take(pad, range(k, k + a.shape[axis]), axis=axis) for k, t in enumerate(taps))
    return a


def test_smoothing_is_the_same_for_any_tiling(spark):
    a = np.random.default_rng(0).uniform(size=(37, 29))
    df = table(spark, a)
    want = blur(a, 1.6)
    assert np.allclose(array(grids.gaussian_smooth(df, ["grid_id"], 29, 37, 1.6), 37, 29), want)
    taps = grids.gaussian_taps(1.6)
    small = grids.tile_stencil(df, ["grid_id"], 29, 37, 7, ["v"], lambda d: {"v": grids._separable(d["v"], taps)}, ["v"], tile=8)
    assert np.allclose(array(small, 37, 29), want)
    flat = grids.gaussian_smooth(df.withColumn("v", F.lit(0.5)), ["grid_id"], 29, 37, 2.0)
    assert flat.agg(F.max(F.abs(F.col("v") - 0.5))).first()[0] < 1e-12


def test_resampling(spark):
    a = np.random.default_rng(1).uniform(size=(6, 9))
    df = table(spark, a)
    up = array(grids.upsample2(df, ["grid_id"], 9, 6), 12, 18)
    assert up[0, 0] == pytest.approx(a[0, 0]) and up[2, 3] == pytest.approx((a[1, 1] + a[1, 2]) / 2)
    assert up[11, 17] == pytest.approx(a[5, 8])
    half = array(grids.resize(table(spark, a[:, :8]), ["grid_id"], 8, 6, 4, 3), 3, 4)
    assert half[1, 2] == pytest.approx(a[2:4, 4:6].mean())

    def at(y, x):
        y, x = min(max(y, 0), 5), min(max(x, 0), 8)
        y0, x0 = int(y), int(x)
        y1, x1 = min(y0 + 1, 5), min(x0 + 1, 8)
        fy, fx = y - y0, x - x0
        return ((a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy)

    odd = array(grids.resize(df, ["grid_id"], 9, 6, 13, 5), 5, 13)
    want = [[at((y + .5) * 6 / 5 - .5, (x + .5) * 9 / 13 - .5) for x in range(13)] for y in range(5)]
    assert np.allclose(odd, want)
    even = array(grids.decimate2(df, 9, 6), 3, 4)
    assert np.allclose(even, a[::2, :8:2])
    pts = spark.createDataFrame([(1, 0, 2.25, 3.5), (1, 1, -4.0, 99.0)], "grid_id long, pid long, px double, py double")
    got = {r.pid: r.v for r in grids.bilinear_sample(pts, df, ["grid_id"], ["pid"], 9, 6).collect()}
    assert got[0] == pytest.approx(at(3.5, 2.25)) and got[1] == pytest.approx(a[5, 0])
    crop = array(grids.crop_cells(df, 2, 1, 3, 2), 2, 3)
    assert np.allclose(crop, a[1:3, 2:5])


def test_samples_next_to_a_hole_have_no_value(spark):
    df = spark.createDataFrame([(1, y, x, 1.0) for y in range(4) for x in range(4) if (y, x) != (1, 1)], "grid_id long, y int, x int, v double")
    pts = spark.createDataFrame([(1, 0, 0.5, 0.5), (1, 1, 2.5, 2.5), (1, 2, 2.0, 1.0), (1, 3, 3.0, 3.0), (1, 4, 1.5, 1.0)], "grid_id long, pid long, px double, py double")
    got = {r.pid: r.v for r in grids.bilinear_sample(pts, df, ["grid_id"], ["pid"], 4, 4).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.0}


def test_blob_is_found_where_it_is(spark):
    yy, xx = np.mgrid[0:160, 0:160]
    a = 0.1 + 0.8 * np.exp(-((xx - 80) ** 2 + (yy - 72) ** 2) / (2 * 6.0 ** 2))
    found = []
    for offset in (0.0, 0.2):
        space = grids.scale_space(table(spark, a + offset), ["grid_id"], 160, 160)
        ext = extrema.local_extrema(space, ["grid_id"])
        kept = extrema.contrast_edge_filter(extrema.refine_extrema(ext, space, ["grid_id"]))
        found.append(sorted((round(r.px, 4), round(r.py, 4), r.scale) for r in kept.collect()))
    assert any(abs(x - 80) < 2 and abs(y - 72) < 2 and 3 <= s <= 12 for x, y, s in found[0])
    assert [f[:2] for f in found[0]] == [f[:2] for f in found[1]]


def refined_alone(d, level, y, x, steps, border):
    """One extremum, move by move, through a linear solver."""
    h, w = d.shape[1:]
    for _ in range(extrema.MAX_MOVES + 1):
        c = d[level - 1:level + 2, y - 1:y + 2, x - 1:x + 2]
        g = np.array([c[1, 1, 2] - c[1, 1, 0], c[1, 2, 1] - c[1, 0, 1], c[2, 1, 1] - c[0, 1, 1]]) / 2
        m = np.diag([c[1, 1, 2] + c[1, 1, 0], c[1, 2, 1] + c[1, 0, 1], c[2, 1, 1] + c[0, 1, 1]] - 2 * c[1, 1, 1])
        m[0, 1] = m[1, 0] = (c[1, 2, 2] - c[1, 2, 0] - c[1, 0, 2] + c[1, 0, 0]) / 4
        m[0, 2] = m[2, 0] = (c[2, 1, 2] - c[2, 1, 0] - c[0, 1, 2] + c[0, 1, 0]) / 4
        m[1, 2] = m[2, 1] = (c[2, 2, 1] - c[2, 0, 1] - c[0, 2, 1] + c[0, 0, 1]) / 4
        if np.isnan(m).any() or abs(np.linalg.det(m)) <= 1e-12:
            return None
        o = np.linalg.solve(m, -g)
        if (np.abs(o) < .5).all():
            return (level, y, x, *np.round(o, 6))
        x, y, level = (int(p + np.sign(q) * np.floor(abs(q) + .5)) for p, q in zip((x, y, level), o))
        if not (1 <= level <= steps and border <= x < w - border and border <= y < h - border):
            return None
    return None


@pytest.mark.parametrize("tile", [16, 256])
def test_extrema_move_within_tiles_and_beyond(spark, tile):
    rng = np.random.default_rng(3)
    d = rng.normal(size=(5, 60, 70)) + np.linspace(0, 6, 70)
    d[:, 33, 41] = np.nan
    spots = [(int(lv), int(y), int(x)) for lv, y, x in zip(rng.integers(1, 4, 400), rng.integers(5, 55, 400), rng.integers(5, 65, 400))]
    spots = sorted(set(spots))
    want = {p: r for p in spots if (r := refined_alone(d, *p, 3, 5)) is not None}
    assert any(abs(r[2] - p[2]) > 8 or abs(r[1] - p[1]) > 8 for p, r in want.items())
    cells = [(1, 0, 70, 60, y, x, *(float(v) for v in d[:, y, x])) for y in range(60) for x in range(70) if (y, x) != (33, 41)]
    space = spark.createDataFrame(cells, "k long, octave int, width int, height int, y int, x int, d0 double, d1 double, d2 double, d3 double, d4 double")
    ext = spark.createDataFrame([(1, 0, 70, 60, *p, 0.0) for p in spots], "k long, octave int, width int, height int, level int, y int, x int, v double")
    got = extrema.refine_extrema(ext, space, ["k"], tile=tile).collect()
    assert len(got) == len(want)
    for r in got:
        level, y, x, *o = want[r.level0, r.y0, r.x0]
        assert (r.level, r.y, r.x) == (level, y, x) and np.allclose([r.ox, r.oy, r.os], o, atol=1e-5)
    assert extrema.refine_extrema(ext.limit(0), space, ["k"]).count() == 0


def layers(spark, specs):
    """specs: source, x0, w, h, fn(x, y) -> value; tent centred on the layer."""
    rows = []
    for s, x0, w, h, fn in specs:
        for y in range(h):
            for x in range(w):
                tent = (1 - abs(2 * (x + .5) / w - 1)) * (1 - abs(2 * (y + .5) / h - 1))
                rows.append((1, s, x0 + x, y, float(fn(x0 + x, y)), max(tent, 1e-5)))
    return spark.createDataFrame(rows, "set_id long, source_id long, x int, y int, v double, tent double")


def test_calibration_single_and_blocks(spark):
    flat = layers(spark, [(0, 0, 100, 60, lambda x, y: .4), (1, 50, 100, 60, lambda x, y: .5)])
    lone = layers(spark, [(2, 500, 10, 5, lambda x, y: .3)])
    g = {r.source_id: r.gain for r in overlap.calibrate_sources(
        flat.union(lone), ["x", "y"], tile=overlap.spatial_tiles()).collect()}
    assert (g[0], g[1], g[2]) == pytest.approx((1.070949, 0.911314, 1.0), abs=1e-6)
    b = overlap.calibrate_blocks(flat, blocks_across=5, min_block=10)
    m = {r.source_id: r for r in b.groupBy("source_id").agg(F.avg("gain").alias("m"), F.count("*").alias("n"),
                                                           (F.max("gain") - F.min("gain")).alias("d")).collect()}
    assert (m[0].n, m[0].m, m[1].m) == (15, pytest.approx(1.070945, abs=1e-5), pytest.approx(0.911319, abs=1e-5))
    assert m[0].d < 1e-5
    top = layers(spark, [(0, 0, 100, 60, lambda x, y: .4), (1, 50, 100, 60, lambda x, y: .5 if y < 30 else .4)])
    rows = overlap.calibrate_blocks(top, blocks_across=5, min_block=10).groupBy("source_id", "br").agg(F.avg("gain").alias("m"))
    got = {(r.source_id, r.br): r.m for r in rows.collect()}
    assert [got[1, k] for k in range(3)] == pytest.approx([.93335, .95440, .97462], abs=1e-4)
    assert [got[0, k] for k in range(3)] == pytest.approx([1.05317, 1.03649, 1.01878], abs=1e-4)
    names = spark.createDataFrame([(1, 0, "a.jpg"), (1, 1, "b.jpeg")], "set_id long, source_id long, name string")
    texts = {r.source_id: r.text for r in overlap.calibration_summary(overlap.calibrate_sources(flat, ["x", "y"]), names).collect()}
    assert texts == {0: "a 1.07", 1: "b 0.91"}
    even = overlap.apply_gain(flat, overlap.calibrate_sources(flat, ["x", "y"]), ["v"])
    v = {r.source_id: r.v for r in even.groupBy("source_id").agg(F.max("v").alias("v")).collect()}
    assert abs(v[0] - v[1]) < 0.033
    wide = overlap.apply_gain(top, overlap.calibrate_blocks(top, blocks_across=5, min_block=10), ["v"], overlap.layer_boxes(top))
    assert wide.count() == top.count()


def test_overlap_statistics_with_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_ENTITIES", 10)
    rng = np.random.default_rng(6)
    rows = {(s, int(c)): float(rng.uniform()) for s in range(40) for c in rng.choice(60, size=35, replace=False)}
    rows.update({(s, 999): 0.5 for s in range(40)})
    df = spark.createDataFrame([(1, s, c, v) for (s, c), v in rows.items()], "set_id long, source_id long, cell long, v double")
    got = {(r.a, r.b): (r.n, r.mean_a, r.mean_b) for r in overlap.overlap_stats(df, ["cell"], min_overlap=20).collect()}
    want = {}
    for a in range(40):
        for b in range(a + 1, 40):
            cells = [c for (s, c) in rows if s == a and (b, c) in rows]
            if len(cells) > 20:
                want[a, b] = (len(cells), np.mean([rows[a, c] for c in cells]), np.mean([rows[b, c] for c in cells]))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_gain_map_interpolates_and_holds_edges(spark):
    arr = F.array(*[F.lit(v) for v in (1.0, 2.0, 3.0, 4.0)])
    r = spark.range(1).select(*[overlap.gain_at(arr, F.lit(2), F.lit(2), F.lit(u), F.lit(v)).alias(n)
                                for n, u, v in (("a", 0.0, 0.0), ("b", 0.5, 0.5), ("c", 1.0, 0.25))]).first()
    assert (r.a, r.b, r.c) == pytest.approx((1, 2.5, 2))


def test_ownership(spark):
    two = layers(spark, [(0, 0, 100, 20, lambda x, y: .5), (1, 60, 100, 20, lambda x, y: .5)])
    own = {(r.x, r.y): r.source_id for r in ownership.own_by_locality(two).collect()}
    assert own[70, 10] == 0 and own[90, 10] == 1 and len(own) == 160 * 20
    def texture(x, y):
        return .5 + ((x + y) % 7) * .01
    square = layers(spark, [(0, 0, 120, 80, texture),
                            (1, 60, 120, 80, lambda x, y: 1.0 if 80 <= x <= 95 and 30 <= y <= 45 else texture(x, y))])
    got = {(r.x, r.y): r.source_id for r in ownership.own_consistent(square, 0.05).collect()}
    assert len(got) == 180 * 80
    assert len({got[x, y] for x in range(80, 96) for y in range(30, 46)}) == 1
    mask = ownership.owner_mask(two, ownership.own_by_locality(two)).groupBy("x", "y").agg(F.sum("mask").alias("m"))
    assert mask.filter("m <> 1").count() == 0
    low = spark.createDataFrame([(1, x, y, x) for x in range(4) for y in range(2)], "set_id long, x int, y int, source_id long")
    full = spark.createDataFrame([(1, x, y) for x in range(8) for y in range(4)], "set_id long, x int, y int")
    up = {(r.x, r.y): r.owner for r in ownership.upsample_owner(low, full, (F.lit(4), F.lit(2)), F.lit(0.5)).collect()}
    assert all(up[x, y] == x // 2 for x in range(8) for y in range(4))


def test_multiband_blend_of_two_colours(spark):
    rows = [(1, s, x0 + x, y, *c) for s, x0, c in ((0, 0, (.9, .1, .1)), (1, 80, (.1, .1, .9))) for y in range(64) for x in range(120)]
    df = spark.createDataFrame(rows, "set_id long, source_id long, x int, y int, r double, g double, b double")
    owner = df.select("set_id", "x", "y").distinct().withColumn("source_id", F.when(F.col("x") < 100, 0).otherwise(1).cast("long"))
    out = blending.multiband_blend(df, owner, 200, 64, 4)
    got = {(r.x, r.y): r for r in out.collect()}
    assert len(got) == 200 * 64
    assert not any(math.isnan(r.r) for r in got.values())
    assert got[10, 32].r == pytest.approx(.9, abs=.05) and got[190, 32].b == pytest.approx(.9, abs=.05)
    assert got[100, 32].r == pytest.approx(0.48493, abs=2e-3)


def test_largest_rectangle(spark):
    cells = [(1, y, x) for y in range(60) for x in range(100) if not (x < 30 and y < 20)]
    df = spark.createDataFrame(cells, "set_id long, y int, x int")
    r = coverage.largest_full_rect(df, 100, 60).first()
    assert (r.area, r.x, r.y, r.w, r.h) == (4200, 30, 0, 70, 60)
    vals = df.withColumn("v", F.lit(1.0))
    assert coverage.auto_crop(vals, df, 100, 60).agg(F.count("*"), F.max("x"), F.max("y")).first()[0:3] == (4200, 69, 59)


def test_largest_rectangle_random(spark, monkeypatch):
    monkeypatch.setattr(coverage, "SPAN", 4)
    rng = np.random.default_rng(8)
    masks = []
    for g in range(24):
        mask = rng.uniform(size=(14, 11)) < (0.75 if g % 3 else 0.93)
        mask[:, rng.integers(0, 11)] &= g % 4 > 0
        masks.append(mask)
    cells = [(g, y, x) for g, mask in enumerate(masks) for y in range(14) for x in range(11) if mask[y, x]]
    df = spark.createDataFrame(cells, "set_id long, y int, x int")
    got = {columns: {r.set_id: (r.x, r.y, r.w, r.h) for r in coverage.largest_full_rect(df, 11, 14, columns=columns).collect()} for columns in (1, 2, 3, 4, 8192)}
    for g, mask in enumerate(masks):
        best = None
        for by in range(14):
            for right in range(1, 12):
                for left in range(right):
                    tall = 0
                    while tall <= by and mask[by - tall, left:right].all():
                        tall += 1
                    key = (tall * (right - left), -by, -right, tall)
                    if tall and (best is None or key > best[0]):
                        best = (key, left, by - tall + 1, right - left, tall)
        for columns, found in got.items():
            assert found[g] == best[1:], (g, columns)


def test_circular_peaks_and_soft_histogram(spark):
    rows = [(1, a % (2 * math.pi), 1.0 + math.cos(a - 2.0) ** 3) for a in np.linspace(0, 2 * math.pi, 721)[:-1].tolist()]
    df = spark.createDataFrame(rows, "k long, a double, w double")
    p = histograms.circular_peaks(df, ["k"], F.col("a"), F.col("w")).collect()
    assert len(p) == 1 and p[0].peak == pytest.approx(2.0 - math.pi / 36, abs=0.1)
    s = spark.createDataFrame([(1, 1.25, 2.0, 7.5, 2.0)], "k long, r double, c double, t double, w double")
    v = histograms.soft_histogram(s, ["k"], F.col("r"), F.col("c"), F.col("t"), F.col("w"), cap=None).first().vec
    want = np.zeros((4, 4, 8))
    for r, wr in ((1, .75), (2, .25)):
        for t in (7, 0):
            want[r, 2, t] += 2 * wr * .5
    assert v == pytest.approx(want.ravel().tolist())


def flat_pair(spark):
    cells = spark.createDataFrame([(1, s, y, x, .5) for s in (0, 1) for y in range(100) for x in range(200)],
                                  "set_id long, source_id long, y int, x int, v double")
    src = spark.createDataFrame([(1, 0, 0.0, 0.0, 200, 100), (1, 1, 150.0, 20.0, 200, 100)],
                                "set_id long, source_id long, tx double, ty double, width int, height int")
    return cells, src.withColumn("t", sim(F.lit(1.0), F.lit(0.0), F.col("tx"), F.col("ty")))


def test_regrid_places_sources(spark):
    cells, src = flat_pair(spark)
    frame = placement.frame_extent(src, 350, ["set_id"])
    got = {(r.source_id, r.x, r.y): r for r in regrid.regrid(cells, src, frame).collect()}
    assert got[1, 160, 60].v == pytest.approx(0.5) and (1, 140, 60) not in got
    assert got[0, 100, 50].tent > got[0, 2, 50].tent


def test_composite(spark):
    cells, src = flat_pair(spark)
    cells = cells.withColumn("v", F.when(F.col("source_id") == 0, 0.4).otherwise(0.5))
    frame = placement.frame_extent(src, 350, ["set_id"])
    for args in ({"blend": "mean"}, {"levels": 3, "low_width": 175, "gain": "block"}):
        out, gains = composite(cells, src, frame, **args)
        r = out.agg(F.count("*").alias("n"), F.percentile_approx("v", 0.05).alias("lo"), F.max("v").alias("hi")).first()
        # the largest full block keeps at least the rows both 199 x 99 sources share
        assert r.n >= 75 * 340 and 0.42 < r.lo <= r.hi < 0.46


def test_composite_of_sets_with_their_own_sizes(spark):
    cells, src = flat_pair(spark)
    cells = cells.filter("x < 80 and y < 60").withColumn("v", 0.3 + 0.1 * F.col("source_id") + F.col("x") * 0.001)
    src = src.withColumns({"width": F.lit(80), "height": F.lit(60), "t": sim(F.lit(1.0), F.lit(0.0), 0.3 * F.col("tx"), 0.3 * F.col("ty"))})
    small = placement.frame_extent(src, 90, ["set_id"])
    large = placement.frame_extent(src.withColumn("set_id", F.lit(2).cast("bigint")), 125, ["set_id"])
    two_cells = cells.unionByName(cells.withColumn("set_id", F.lit(2).cast("bigint")))
    two_src = src.unionByName(src.withColumn("set_id", F.lit(2).cast("bigint")))
    both, _ = composite(two_cells, two_src, small.unionByName(large), levels=3)
    got = {(r.set_id, r.x, r.y): r.v for r in both.collect()}
    for one in (small, large):
        alone, _ = composite(two_cells, two_src, one, levels=3)
        want = {(r.set_id, r.x, r.y): r.v for r in alone.collect()}
        assert want and {k: v for k, v in got.items() if k[0] == next(iter(want))[0]} == pytest.approx(want)


def test_composite_of_cameras(spark):
    pan = [(1, s, [float(np.cos(p)), 0.0, float(-np.sin(p)), 0.0, 1.0, 0.0, float(np.sin(p)), 0.0, float(np.cos(p))], 60.0, 80, 60) for s, p in ((0, -0.3), (1, 0.3))]
    cams = spark.createDataFrame(pan, "set_id long, source_id long, rot array<double>, focal double, width int, height int")
    cells = spark.createDataFrame([(1, s, y, x, 0.4) for s in (0, 1) for y in range(60) for x in range(80)], "set_id long, source_id long, y int, x int, v double")
    kind = F.lit("spherical")
    frame = placement.angular_frame(cams, kind, 96, ["set_id"])
    layer = lambda f: regrid.regrid_cameras(cells, cams, f, kind)
    whole, gains = composite(None, None, frame, layers=layer, levels=3, crop=False)
    covered = {(r.x, r.y) for r in layer(frame).collect()}
    got = {(r.x, r.y): r.v for r in whole.collect()}
    assert set(got) == covered and all(v == pytest.approx(0.4, abs=1e-6) for v in got.values())
    assert {r.source_id for r in gains.collect()} == {0, 1}


def test_dense_grids_reach_as_far_as_their_cells(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 9000, 30, 2.0), ("b", 3, 1, 3.0)], "k string, y int, x int, v double")
    full = grids.dense_grid(df, ["k"])
    assert full.count() == 2 * 9001 * 31 and full.agg(F.sum("v")).first()[0] == 6.0
    assert grids.dense_grid(df, ["k"], 4, 5).count() == 2 * 4 * 5
    assert grids.dense_grid(df.limit(0), ["k"]).count() == 0


def test_days_are_counted_from_the_first_date(spark, tmp_path):
    from queries.grid import day_hours

    rows = [("a", "2024-01-31 05:00:00", 2.0), ("a", "2024-01-01 05:00:00", 4.0), ("a", "2024-02-01 05:00:00", 6.0)]
    spark.createDataFrame(rows, "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    grid, days = day_hours(spark, str(tmp_path))
    cells = grid.collect()
    assert days == 32 and len(cells) == 32 * 24
    assert {(r.y, r.x): r.v for r in cells if r.v} == {(0, 5): 1.0, (30, 5): 0.5, (31, 5): 1.5}


def test_overlap_of_many_sources_that_share_few_cells_is_not_copied(spark, monkeypatch):
    # 3000 sources in one tile, 300 cells of 20 sources each: few pairs, so the tile is not split and goes cell by cell
    rng = np.random.default_rng(5)
    seen = []
    for c in range(300):
        seen += [(1, int(s), c, float(s % 7) + c * 0.01) for s in rng.choice(3000 if c % 2 else 40, 20, replace=False)]
    cells = spark.createDataFrame(seen, "set_id long, source_id long, cell long, v double")
    blocks = []
    whole = overlap._gram

    def kept(cell):
        run = whole(cell)
        return lambda pdf: run(pdf).assign(n=lambda d: d.n + 1000 * int(pdf._lo.iloc[0] != pdf._hi.iloc[0]))

    monkeypatch.setattr(overlap, "_gram", kept)
    got = {(r["a"], r["b"]): (r["n"], r["mean_a"], r["mean_b"]) for r in overlap.overlap_stats(cells, ["cell"], min_overlap=2).collect()}
    by = {}
    for _, s, c, v in seen:
        by.setdefault(s, {})[c] = v
    by = {s: d for s, d in by.items() if len(d) > 2}
    want = {}
    for a in by:
        for b in by:
            both = by[a].keys() & by[b].keys() if a < b else ()
            if len(both) > 2:
                want[a, b] = (len(both), np.mean([by[a][c] for c in both]), np.mean([by[b][c] for c in both]))
    assert got.keys() == want.keys()
    for k, (n, x, y) in want.items():
        assert got[k][0] == n and got[k][1:] == pytest.approx((x, y))


def test_sparse_and_dense_sums_of_a_tile_agree():
    rng = np.random.default_rng(6)
    place = rng.choice(500 * 200, 6000, replace=False)
    who, at, v = place // 200, np.unique(place % 200, return_inverse=True)[1], rng.random(6000)
    i, j, n, sa, sb = overlap._dense(who, at, v, 500)
    want = {(a, b): x for a, b, *x in zip(i.tolist(), j.tolist(), n, sa, sb)}
    for most, few in ((overlap.PAIRS_AT_ONCE, 1024), (overlap.PAIRS_AT_ONCE, 10), (5000, 10)):
        old = overlap.PAIRS_AT_ONCE, overlap.HOT_ENTITIES
        overlap.PAIRS_AT_ONCE, overlap.HOT_ENTITIES = most, few
        try:
            got = {}
            for a, b, *x in zip(*overlap._sparse(who, at, v, 500)):
                got[a, b] = np.add(got.get((a, b), 0.0), x)
        finally:
            overlap.PAIRS_AT_ONCE, overlap.HOT_ENTITIES = old
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_blur_of_a_source_that_covers_little_of_its_box_keeps_no_empty_cells(spark):
    # two corners of a box of 400 x 400: whole tiles come back from the stencil, but only cells that something reaches go on
    seen = [(1, 1, y, x, 0.5, 1.0, 1.0) for k in (0, 390) for y in range(k, k + 4) for x in range(k, k + 4)]
    cells = spark.createDataFrame(seen, "set_id long, source_id long, y int, x int, v double, _v double, _m double")
    got = blending._halve(cells, ["set_id", "source_id"], F.lit(400), F.lit(400), ["v", "_v", "_m"])
    assert 0 < got.count() < 400 and got.filter("_v <= 0").count() == 0
    assert got.agg(F.sum("_v")).first()[0] > 0


def test_tiles_are_dealt_by_their_rows_whatever_the_shuffle_partitions(spark, monkeypatch):
    cells = spark.range(4000).selectExpr("1L as set_id", "id % 4 as source_id", "cast(id div 4 % 100 as int) as x", "cast(id div 400 as int) as y", "id % 7 / 7D as v")
    whole = {tuple(r) for r in overlap.overlap_stats(cells, ["x", "y"], tile=[F.col("x")]).collect()}
    monkeypatch.setattr(overlap, "PART_ROWS", 500)
    dealt = overlap.overlap_stats(cells, ["x", "y"], tile=[F.col("x")])
    assert "), 8" in dealt._jdf.queryExecution().analyzed().toString() or ", 8\n" in dealt._jdf.queryExecution().analyzed().toString()
    got = {(r.a, r.b): r for r in dealt.collect()}
    assert len(got) == 6 and all(got[a, b].n == n == 1000 and got[a, b].mean_a == pytest.approx(ma) and got[a, b].mean_b == pytest.approx(mb) for _, a, b, n, ma, mb in whole)


def test_a_written_table_leaves_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = manager.getAllFiles()
        names = (found.apply(i).getName() for i in range(found.size()))
        return {n for n in names if n.startswith("shuffle_")}

    before = shuffled()
    rows = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and rows.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_bands_are_found_and_joined_tile_by_tile(spark, monkeypatch):
    rng = np.random.default_rng(5)
    seen = [(1, s, x + x0, y, float(rng.random())) for s, x0 in ((0, 3), (1, 25)) for x in range(40) for y in range(30) if rng.random() < 0.7]
    cells = spark.createDataFrame(seen, "set_id long, source_id long, x int, y int, v double")
    owner = cells.groupBy("set_id", "x", "y").agg(F.max("source_id").alias("source_id"))
    whole = {(r.x, r.y): r.v for r in blending.multiband_blend(cells, owner, 70, 30, 4, ["v"]).collect()}
    monkeypatch.setattr(blending, "TILE", 16)
    monkeypatch.setattr(blending, "tiles_of", lambda c, size, halo, tile=16: grids.tiles_of(c, size, halo, tile))
    out = blending.multiband_blend(cells, owner, 70, 30, 4, ["v"])
    # no cell is copied to all cells that it reaches
    assert "explode(sequence(_yl" not in out._jdf.queryExecution().analyzed().toString()
    small = {(r.x, r.y): r.v for r in out.collect()}
    assert whole.keys() == small.keys() == {(x, y) for _, _, x, y, _ in seen if x < 70}
    assert all(small[k] == pytest.approx(whole[k], abs=1e-9) for k in whole)


def test_partial_sums_of_a_tile_come_once_a_pair(monkeypatch):
    # 3000 sources, found pair by pair in many parts
    monkeypatch.setattr(overlap, "PAIRS_AT_ONCE", 2000)
    rng = np.random.default_rng(9)
    at = np.repeat(np.arange(600), 12)
    who = np.concatenate([rng.choice(60, 12, replace=False) + 49 * 60 * (c % 2) for c in range(600)])
    i, j, n, _, _ = overlap._sparse(who, at, np.ones(len(at)), 3000)
    assert n.sum() == 600 * 66 and len(set(zip(i.tolist(), j.tolist()))) == len(i) < 600 * 66


def test_small_sources_are_joined_away_only_if_they_hold_many_rows(spark):
    def rows(few):
        seen = [(1, s, c, float(s + c)) for s in range(4) for c in range(100)] + [(1, 100 + s, c, 1.0) for s in range(few) for c in range(5)]
        return spark.createDataFrame([*seen, (1, None, 3, 1.0)], "set_id long, source_id long, cell long, v double")

    for few, joined in ((3, False), (40, True)):
        before = written()
        got = {(r.a, r.b): (r.n, r.mean_a, r.mean_b) for r in overlap.overlap_stats(rows(few), ["cell"]).collect()}
        assert got == {(a, b): (100, a + 49.5, b + 49.5) for a in range(4) for b in range(a + 1, 4)}
        held = [spark.read.parquet(p) for p in written() - before]
        # the written rows are those of the large sources only, or all; the table before them is gone
        assert [t.count() for t in held if "_tile" in t.columns and "entity" in t.columns] == [400 if joined else 400 + 5 * few]
        assert not any("entity" in t.columns and "_v" in t.columns and "_tile" not in t.columns for t in held)
