import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import u
from tessera.functions.similarity import sim_from_polar, sim_scale
from tessera.operators import fitting, graph, matching
from tessera.plans.merge import merge_strips
from tessera.plans.recognize import recognize
from tessera.session import cut

FEATURES = "set_id long, source_id long, feature_id long, x double, y double, descriptor array<float>"


def brute_2nn(rows, ratio):
    out = {}
    by = {}
    for s, k, f, *_, d in rows:
        by.setdefault((s, k), []).append((f, np.array(d, dtype=np.float32).astype(float)))
    for (s, a), fa in by.items():
        for (s2, b), fb in by.items():
            if s != s2 or a >= b or len(fb) < 2:
                continue
            fb = sorted(fb, key=lambda r: r[0])
            m = np.stack([d for _, d in fb])
            for f, d in fa:
                dist = np.maximum(2 - 2 * (m @ d), 0)
                order = np.argsort(dist, kind="stable")
                d1, d2 = dist[order[0]], dist[order[1]]
                if d2 > 1e-7 and d1 < ratio * ratio * d2:
                    out[(s, a, b, f, fb[order[0]][0])] = np.sqrt(d1)
    return out


@pytest.mark.parametrize("chunk,block", [(2048, 4096), (7, 16)])
def test_match_2nn_equals_brute_force(spark, chunk, block):
    rng = np.random.default_rng(3)
    rows = []
    for s in (1, 2):
        for k in range(4):
            for f in range(40 if k != 3 else 1):
                d = rng.normal(size=8)
                rows.append((s, k, f, 0.0, 0.0, (d / np.linalg.norm(d)).astype(np.float32).tolist()))
    got = matching.match_2nn(spark.createDataFrame(rows, FEATURES), 0.8, chunk, block).collect()
    want = brute_2nn(rows, 0.8)
    assert {(r.set_id, r.a, r.b, r.fa, r.fb) for r in got} == set(want)
    assert all(abs(r.distance - want[(r.set_id, r.a, r.b, r.fa, r.fb)]) < 1e-9 for r in got)
    assert len(want) > 20


@pytest.mark.parametrize("n, clusters", [(1, 1), (2, 1), (400, 8), (400, 400)])
def test_cells_find_what_a_full_search_finds(n, clusters):
    rng = np.random.default_rng(n + clusters)
    centres = rng.normal(size=(clusters, 16))

    def some(k):
        v = centres[rng.integers(0, clusters, k)] + rng.normal(scale=.05, size=(k, 16))
        return v / np.linalg.norm(v, axis=1)[:, None]

    vectors, queries = some(n), some(300)
    vectors[n // 2] = vectors[n // 3]
    queries[:20] = vectors[n // 3]
    cells = matching.Cells(vectors)
    got, want = cells.two_nearest(queries), matching.full_search(queries, vectors)
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])
    assert (got[2] == want[2]).all() and (n == 1 or (got[3] == want[3]).all())
    assert cells.all == 300 * n and (clusters != 8 or cells.met < .2 * cells.all)


def test_blocks_with_cells_give_the_same_rows(monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    rows = []
    for source, count in ((0, 300), (1, 250), (2, 1), (3, 200)):
        v = centres[rng.integers(0, 20, count)] + rng.normal(scale=.05, size=(count, 16))
        rows += [(1, source, f, d.tolist(), True, source % 2, 0, 1) for f, d in enumerate(v / np.linalg.norm(v, axis=1)[:, None])]
    names = ["set_id", "source_id", "feature_id", "descriptor", "_whole", "_group", "_lo", "_hi"]
    block = pa.table({c: [r[k] for r in rows] for k, c in enumerate(names)})
    full = matching._block_matcher(0.9)(block).to_pydict()
    monkeypatch.setattr(matching, "MANY", 100)
    used = []
    monkeypatch.setattr(matching, "cells_worth_it", lambda *a, f=matching.cells_worth_it: used.append(f(*a)) or used[-1])
    pruned = matching._block_matcher(0.9)(block).to_pydict()
    assert any(used) and full.pop("dot") == pytest.approx(pruned.pop("dot")) and full == pruned and len(full["a"]) > 0


def test_candidates_cut_before_the_minimum(spark):
    counts = spark.createDataFrame([(1, 0, j, 10 - j) for j in range(1, 9)], "set_id long, a long, b long, n_matches long")
    got = {(r.a, r.b) for r in matching.candidate_pairs(counts).collect()}
    # source 0 lists 1..6; 7 and 8 list 0 themselves but have fewer than 4 matches
    assert got == {(0, j) for j in range(1, 7)}


def f1_points(spark):
    rows = []
    c, s = float(1.02 * np.cos(0.02)), float(1.02 * np.sin(0.02))
    for i in range(122):
        if i < 12:
            xa, ya = 700 + 1200 * u("f1", "x", i), 500 + 400 * u("f1", "y", i)
            xb, yb = c * xa - s * ya - 600, s * xa + c * ya + 8
        else:
            xa, ya, xb, yb = (k * u("f1", n, i) for n, k in (("ax", 2000), ("ay", 1500), ("bx", 2000), ("by", 1500)))
        rows.append((1, 0, 1, i, xa, ya, xb, yb, 2000, 1500))
    return spark.createDataFrame(rows, "set_id long, a long, b long, match_id long, xa double, ya double, xb double, "
                                       "yb double, width int, height int")


def test_consensus_similarity_finds_sparse_inliers(spark):
    pairs, inliers = fitting.ransac_pairs(f1_points(spark), "similarity", seed=F.lit("f1"))
    p = fitting.pair_similarity(pairs).withColumn("s", sim_scale(F.col("t"))).first()
    assert (p.best_trial, p.n_inliers, p.verified, p.threshold) == (34, 12, True, 12.0)
    assert p.s == pytest.approx(1.02, abs=1e-6) and p.t.tx == pytest.approx(-600, abs=1e-6)
    assert sorted(r.match_id for r in inliers.collect()) == list(range(12))


def test_consensus_homography_does_not_verify_junk(spark):
    pairs, _ = fitting.ransac_pairs(f1_points(spark), "homography", trials=200)
    assert not any(r.verified for r in pairs.collect())


def test_pairs_of_one_chunk_give_the_candidates_and_scores_of_the_joins(spark):
    pts = f1_points(spark).withColumn("threshold", F.lit(12.0))
    few = pts.filter("match_id < 3").withColumn("set_id", F.lit(2).cast("long"))
    indexed = cut(fitting.index_points(pts.unionByName(few)))
    assert [(r.set_id, r.n, r.idx) for r in indexed.filter("match_id = 2").orderBy("set_id").collect()] == [(1, 122, 2), (2, 3, 2)]
    for model, col in (("similarity", "t"), ("homography", "h")):
        near = fitting.hypotheses(indexed, model, 60)
        joined = cut(fitting._joined_hypotheses(indexed, model, 60, None))
        rows = [sorted(map(tuple, m.select(*fitting.PAIR, "trial", "n", "threshold", col).collect())) for m in (near, joined)]
        assert rows[0] == rows[1] and rows[0]
        scores = [sorted(map(tuple, f(indexed, joined).select(*fitting.PAIR, "trial", "n_inliers", "n", "threshold", col).collect()))
                  for f in (fitting.score_hypotheses, fitting._joined_scores)]
        assert scores[0] == scores[1] and scores[0]


def test_a_pair_of_several_chunks_and_one_of_one_are_fitted_alike(spark, monkeypatch):
    pts = f1_points(spark)
    both = pts.unionByName(pts.filter("match_id < 40").withColumn("set_id", F.lit(2).cast("long")))
    found = []
    for rows in (8192, 50):
        monkeypatch.setattr(fitting, "CHUNK_ROWS", rows)
        pairs, inliers = fitting.ransac_pairs(both, "similarity", 200)
        found.append((sorted((r.set_id, r.best_trial, r.n_matches, r.n_inliers, r.n_overlap) for r in pairs.collect()), sorted(map(tuple, inliers.collect()))))
    assert found[0] == found[1] and len(found[0][0]) == 2


def test_points_on_a_border_count_as_they_lie_in_spite_of_rounding(spark):
    # x = 300 and y = 0 land on the lower borders (inside), x = 2300 and y = 1500 on the upper ones (outside), up to the rounding of the fit
    rows = []
    for set_id in range(20):
        for k in range(60):
            x, y = float(300 + (k * 37 + set_id * 11) % 2000), float((k * 53 + set_id * 7) % 1500)
            x, y = (300.0 if k % 6 == 0 else 2300.0 if k % 6 == 1 else x), (0.0 if k % 6 == 2 else 1500.0 if k % 6 == 3 else y)
            rows.append((set_id, 0, 1, k, x, y, x - 300.0, y, 2000, 1500))
    pts = spark.createDataFrame(rows, "set_id long, a long, b long, match_id long, xa double, ya double, xb double, yb double, width int, height int")
    pairs, _ = fitting.ransac_pairs(pts, "homography", trials=50)
    got = {r.set_id: r.n_overlap for r in pairs.collect()}
    assert got == {s: sum(r[0] == s and r[6] < 2000 and r[7] < 1500 for r in rows) for s in range(20)}


def test_samples_in_line_give_no_homography(spark):
    import pandas as pd
    good = [(67, 469), (68, 476), (187, 900), (900, 100)]
    line = [(67, 469), (68, 476), (187, 1309), (900, 100)]
    flat = lambda a, b: [float(c) for p, q in zip(a, b) for c in (*p, *q)]
    moved = [(x * 0.9 + 3, y * 1.1 - 4) for x, y in good]
    df = spark.createDataFrame(pd.DataFrame({"k": [0, 1, 2, 3], "v": [flat(good, moved), flat(line, moved), flat(good, [(x, 2 * x) for x, _ in good]), flat(good, good)]}))
    got = {r.k: r.h for r in df.select("k", fitting._h_from_sample("v").alias("h")).collect()}
    assert got[1] is None and got[2] is None
    assert got[0] == pytest.approx([0.9, 0, 3, 0, 1.1, -4, 0, 0, 1], abs=1e-6) and got[3] == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1], abs=1e-6)


def test_homography_fit_exact_and_degenerate(spark):
    m = np.array([[1.1, 0.05, 20], [-0.03, 0.95, -10], [1e-4, -5e-5, 1]])
    rng = np.random.default_rng(1)
    rows = []
    for k in range(20):
        x, y = rng.uniform(0, 1000, 2)
        p = m @ [x, y, 1]
        rows.append((1, float(x), float(y), float(p[0] / p[2]), float(p[1] / p[2])))
        rows.append((2, 5.0, 5.0, 5.0, 5.0))
    df = spark.createDataFrame(rows, "k long, xa double, ya double, xb double, yb double")
    got = {r.k: r.h for r in fitting.fit_homography(df, ["k"]).collect()}
    assert np.allclose(np.array(got[1]).reshape(3, 3), m, atol=1e-6)
    assert got[2] is None


def test_similarity_fit_plain_weighted_degenerate(spark):
    pts = spark.range(10).select(F.lit(1).alias("k"), (F.col("id") * 3.0).alias("xa"), (F.col("id") % 3 * 7.0).alias("ya"))
    t = sim_from_polar(F.lit(0.8), F.lit(-0.3), F.lit(4.0), F.lit(9.0))
    from tessera.functions.similarity import sim_apply
    x, y = sim_apply(t, F.col("xa"), F.col("ya"))
    df = pts.withColumns({"xb": x, "yb": y, "w": F.lit(1.0)})
    odd = df.unionByName(df.limit(1).withColumns({"xb": F.lit(1e4), "w": F.lit(0.0)}))
    for d, w in ((df, None), (odd, "w")):
        r = fitting.fit_similarity(d, ["k"], w).select("t.*").first()
        assert (r.a, r.b, r.tx, r.ty) == pytest.approx((0.8 * np.cos(0.3), -0.8 * np.sin(0.3), 4, 9), abs=1e-9)
    same = df.withColumn("xa", F.lit(1.0)).withColumn("ya", F.lit(1.0))
    assert fitting.fit_similarity(same, ["k"]).first().t is None


def test_components_match_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(220, 2))] + [(k, k + 1) for k in range(400, 440)]
    edges += [(900, k) for k in range(901, 960)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in graph.connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}


PAIRS = "set_id long, a long, b long, n_inliers long"


def test_groups_order_and_unplaced(spark):
    pairs = spark.createDataFrame([(1, 0, 1, 9), (1, 2, 3, 20), (1, 3, 4, 30), (1, 2, 4, 5), (2, 7, 8, 10)], PAIRS)
    g = graph.assemble_groups(pairs)
    got = sorted((r.set_id, r.group_id, r.source_id, r["size"], r.n_pairs) for r in g.collect())
    assert got == [(1, 1, 2, 3, 3), (1, 1, 3, 3, 3), (1, 1, 4, 3, 3), (1, 2, 0, 2, 1), (1, 2, 1, 2, 1),
                   (2, 1, 7, 2, 1), (2, 1, 8, 2, 1)]
    src = spark.createDataFrame([(1, k, f"s{k}") for k in range(6)] + [(2, 7, "s7")], "set_id long, source_id long, name string")
    assert [(r.set_id, r.source_id) for r in graph.unplaced(src, g).collect()] == [(1, 5)]
    report = graph.recognize_report(g, pairs, src.union(spark.createDataFrame([(2, 8, "s8")], src.schema)))
    texts = [r.text for r in report.collect()]
    assert "group 1: 3 sources, 3 pairs" in texts and "s2 <-> s3: 20 inliers" in texts and "s5" in texts
    want = [(2, 0), (3, 1), (4, 2)]
    for limit in (1000, 2):
        order = graph.placement_order(pairs, chunk=limit).collect()
        got = {(r.set_id, r.component): [] for r in order}
        for r in sorted(order, key=lambda r: r.step):
            got[(r.set_id, r.component)].append(r.source_id)
        assert got == {(1, 2): [3, 4, 2], (1, 0): [0, 1], (2, 7): [7, 8]}
    assert want


def test_growth_order_equals_plain_growth(spark):
    rnd = random.Random(8)
    pairs = sorted({(min(x), max(x)) for x in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(300)) if x[0] != x[1]} | {(k, k + 1) for k in range(59)})
    rows = [(1, a, b, rnd.randrange(12)) for a, b in pairs]
    best = min((-n, a, b) for _, a, b, n in rows)
    order = [best[1], best[2]]
    while len(order) < 60:
        n, a, b = min((-n, a, b) for _, a, b, n in rows if (a in order) != (b in order))
        order.append(b if a in order else a)
    df = spark.createDataFrame(rows, PAIRS)
    for chunk in (100_000, 70, 20):
        got = sorted((r.step, r.source_id) for r in graph.placement_order(df, chunk=chunk).collect())
        assert [s for _, s in got] == order
    chain = spark.range(20_000).selectExpr("1L as set_id", "id as a", "id + 1 as b", "id % 7 as n_inliers")
    assert graph.placement_order(chain, chunk=5000).agg(F.countDistinct("source_id"), F.max("step")).first() == (20_001, 20_000)


def test_choose_model(spark):
    g = "set_id long, size long"
    pano = spark.createDataFrame([(1, 3), (2, 3), (3, 3)], g)
    strip = spark.createDataFrame([(1, 4), (2, 3), (3, 3)], g)
    spread = spark.createDataFrame([(2, 40.0), (3, 5.0)], "set_id long, spread double")
    got = {r.set_id: r.model for r in graph.choose_model(pano, strip, spread).collect()}
    assert got == {1: "strip", 2: "strip", 3: "panorama"}


def test_recognize_end_to_end(spark):
    """Three sources see shifted parts of one field of vectors, a fourth sees something else."""
    rng = np.random.default_rng(11)
    world = rng.uniform(0, 1600, size=(240, 2))
    desc = rng.normal(size=(240, 32))
    desc /= np.linalg.norm(desc, axis=1, keepdims=True)
    rows = []
    for s, off in enumerate((0, 400, 800)):
        for f, (x, y) in enumerate(world):
            if off <= x < off + 800:
                d = desc[f] + rng.normal(size=32) * 0.02
                rows.append((1, s, f, float(x - off), float(y), (d / np.linalg.norm(d)).tolist()))
    for f in range(120):
        d = rng.normal(size=32)
        rows.append((1, 3, f, float(rng.uniform(0, 800)), float(rng.uniform(0, 1600)), (d / np.linalg.norm(d)).tolist()))
    feats = spark.createDataFrame(rows, FEATURES)
    sizes = spark.createDataFrame([(1, k, 800, 1600) for k in range(4)], "set_id long, source_id long, width int, height int")
    for model in ("similarity", "homography"):
        r = recognize(feats, sizes, model, trials=60)
        assert sorted(x.source_id for x in r.groups.collect()) == [0, 1, 2], model


def test_features_to_merged_outputs(spark):
    """Two strips of one set, one of another, and a source of its own: merged cells are the field the sources were cut from."""
    rng = np.random.default_rng(21)
    rows, cells, sizes = [], [], []

    def value(strip, x, y):
        return 0.3 + 0.002 * x + 0.001 * y + 0.1 * strip

    for strip, (set_id, offsets) in enumerate(((1, (0, 25, 50)), (1, (0, 28)), (2, (0, 24)))):
        world, desc = rng.uniform((0, 0), (100, 40), size=(160, 2)), rng.normal(size=(160, 32))
        for k, off in enumerate(offsets):
            source = 10 * strip + k
            sizes.append((set_id, source, 50, 40))
            cells += [(set_id, source, y, x, value(strip, x + off, y)) for y in range(40) for x in range(50)]
            for f, (x, y) in enumerate(world):
                if off <= x < off + 50:
                    d = desc[f] + rng.normal(size=32) * 0.02
                    rows.append((set_id, source, f, float(x - off), float(y), (d / np.linalg.norm(d)).tolist()))
    sizes.append((2, 99, 50, 40))
    for f in range(60):
        d = rng.normal(size=32)
        rows.append((2, 99, f, float(rng.uniform(0, 50)), float(rng.uniform(0, 40)), (d / np.linalg.norm(d)).tolist()))
    feats = spark.createDataFrame(rows, FEATURES)
    size_df = spark.createDataFrame(sizes, "set_id long, source_id long, width int, height int")
    cell_df = spark.createDataFrame(cells, "set_id long, source_id long, y int, x int, v double")
    out = merge_strips(feats, size_df, cell_df, width=F.round("extent_x").cast("int"), always_strip=True, levels=3, trials=40, crop=False)
    told = {(r.set_id, r.source_id): (r.out_id, r.status) for r in out.status.collect()}
    assert told.pop((2, 99)) == (None, "no group")
    assert told == {(1, 0): (1, "merged"), (1, 1): (1, "merged"), (1, 2): (1, "merged"), (1, 10): (2, "merged"), (1, 11): (2, "merged"),
                    (2, 20): (3, "merged"), (2, 21): (3, "merged")}
    assert {r.out_id: r["size"] for r in out.outputs.collect()} == {1: 3, 2: 2, 3: 2}
    assert all(r.rms < 1e-3 for r in out.quality.collect())
    widths = {r.out_id: (r.out_width, r.extent_y) for r in out.frames.collect()}
    assert {k: w for k, (w, _) in widths.items()} == {1: 100, 2: 78, 3: 74}
    got = out.cells.collect()
    for o, strip in ((1, 0), (2, 1), (3, 2)):
        mine = [(r.v, value(strip, r.x, r.y)) for r in got if r.out_id == o and 3 <= r.x < widths[o][0] - 3 and 3 <= r.y < 36]
        assert len(mine) > 0.95 * (widths[o][0] - 6) * 33 and max(abs(a - b) for a, b in mine) < 0.01
    assert {r.model for r in out.models.collect()} == {"strip"} and out.gains.select("out_id").distinct().count() == 3


@pytest.mark.parametrize("model", ["similarity", "homography"])
@pytest.mark.parametrize("chunk", [8192, 40])
def test_early_elimination_keeps_the_winner(spark, monkeypatch, model, chunk):
    """Pairs in one task and pairs cut into chunks: the winner of the full scoring, by far fewer residuals."""
    monkeypatch.setattr(fitting, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(fitting, "SCORE_ROWS", 32)
    rows = []
    for pair, n in ((1, 600), (2, 330), (3, 45), (4, 41), (5, 3), (6, 90)):
        for i in range(n):
            x, y = 1000 * u("e", pair, i, 0), 800 * u("e", pair, i, 1)
            good = u("e", pair, i, 2) < (0.7 if pair < 6 else 0.0)
            far = (0.9 * x - 0.1 * y + 40, 0.1 * x + 0.9 * y - 25) if good else (1000 * u("e", pair, i, 3), 800 * u("e", pair, i, 4))
            rows.append((1, pair, pair + 1, i, x, y, *far, 5.0))
    points = spark.createDataFrame(rows, "set_id long, a long, b long, match_id long, xa double, ya double, xb double, yb double, threshold double")
    indexed = fitting.index_points(points)
    models = cut(fitting.hypotheses(indexed, model, 60))
    scored = {}
    for r in fitting.score_hypotheses(indexed, models).collect():
        key = (-r["n_inliers"], r["trial"])
        scored[r["a"]] = min(scored.get(r["a"], key), key)
    got = {r["a"]: r for r in fitting.best_hypotheses(indexed, models).collect()}
    tried = {r["a"]: r["count"] for r in models.groupBy("a").count().collect()}
    assert set(got) == set(tried) and {a: (-r["n_inliers"], r["trial"]) for a, r in got.items() if r["n_inliers"]} == scored
    assert all(r["n_residuals"] <= (tried[a] + 1) * r["n"] for a, r in got.items())
    # most two-point samples that give a plausible similarity here are good ones, which no bound can drop
    assert got[1]["n_residuals"] < (0.95 if model == "similarity" else 0.75) * tried[1] * got[1]["n"]
    assert fitting.best_hypotheses(indexed.limit(0), models.limit(0)).collect() == []


def test_added_pairs_give_the_components_of_the_full_run(spark):
    rng = np.random.default_rng(11)
    kinds = "set_id long, a long, b long"
    drawn = [(int(s), int(a), int(b)) for s, a, b in zip(rng.integers(0, 3, 400), rng.integers(0, 400, 400), rng.integers(0, 400, 400))]
    drawn += [(7, 5, k) for k in range(6, 40)] + [(8, k, k + 1) for k in range(30)] + [(1, 3, 3)]
    stored, parts = None, [drawn[0::3], drawn[1::3], drawn[2::3], drawn[:20], [(None, 1, 2), (1, None, 2)]]
    for part in parts:
        rows = spark.createDataFrame(part, kinds)
        stored = graph.set_components(rows) if stored is None else cut(graph.add_pairs(stored, rows))
    full = graph.set_components(spark.createDataFrame(drawn, kinds))
    got = [tuple(r) for r in stored.collect()]
    assert sorted(got) == sorted(tuple(r) for r in full.collect()) and len(got) == len(set(got))
    none = spark.createDataFrame([], kinds)
    assert sorted(map(tuple, graph.add_pairs(stored, none).collect())) == sorted(got)
    assert sorted(map(tuple, graph.add_pairs(full.limit(0), spark.createDataFrame([(1, 2, 3)], kinds)).collect())) == [(1, 2, 2), (1, 3, 2)]


def test_a_block_is_searched_in_batches_of_bounded_products(monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 4)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = pa.table({"set_id": np.ones(6000, np.int64), "source_id": np.repeat([1, 2], 3000), "feature_id": np.arange(6000),
                      "descriptor": pa.array(list(v)), "_whole": np.ones(6000, bool), "_group": np.zeros(6000, np.int64),
                      "_lo": np.zeros(6000, np.int64), "_hi": np.zeros(6000, np.int64)})
    sizes, search = [], matching.full_search
    monkeypatch.setattr(matching, "full_search", lambda q, x: (sizes.append(len(q) * len(x)), search(q, x))[1])
    got = matching._block_matcher(0.8)(table)
    assert max(sizes) <= 1_000_000 and sum(sizes) == 9_000_000
    best, runner, first, second = search(v[:3000].astype(float), v[3000:].astype(float))
    d1, d2 = np.maximum(2 - 2 * best, 0), np.maximum(2 - 2 * runner, 0)
    keep = (d2 > matching.MIN_SECOND_SQ) & (d1 < 0.64 * d2)
    assert sorted(zip(got["fa"].to_pylist(), got["fb"].to_pylist())) == sorted(
        [(k, int(f) + 3000) for k in np.flatnonzero(keep).tolist() for f in (first[k], second[k])])
