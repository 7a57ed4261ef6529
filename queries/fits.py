"""Robust pair fits, global placement, frames and offset surfaces.

Match points come from line items: a pair per supplier, a planted transform for rows with a low discount and
unrelated positions for the others.  Placement uses line items as landmarks seen by four sources per supplier.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import Registry, load, rd, sq
from tessera.functions.projective import angles_ray, cam_project
from tessera.functions.similarity import sim, sim_apply, sim_from_polar, sim_inverse
from tessera.operators import fitting, matching, placement, surface
from tessera.session import cut

R = Registry()
TRIALS = 500

_ID = "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey)"
_POINTS = f"""li AS (SELECT l_suppkey AS a, {_ID} AS match_id, max(l_discount) AS disc, max(l_tax) AS tax, max(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
tru AS (SELECT *, (match_id % 2000)::DOUBLE AS xa, (match_id * 7 % 1500)::DOUBLE AS ya, 0.9::DOUBLE + 0.02::DOUBLE * (a % 10) AS sc,
  (a % 7 - 3) * 0.02::DOUBLE AS rot, -300::DOUBLE + (a % 5) * 50 AS tx, 8::DOUBLE AS ty FROM li),
mp AS (SELECT a, match_id, disc, xa, ya,
  CASE WHEN disc < 0.045 THEN sc*cos(rot)*xa - sc*sin(rot)*ya + tx + (tax - 0.04::DOUBLE) * 20 ELSE (match_id * 37 % 2000)::DOUBLE END AS xb,
  CASE WHEN disc < 0.045 THEN sc*sin(rot)*xa + sc*cos(rot)*ya + ty + (qty - 25) / 40 ELSE (match_id * 61 % 1500)::DOUBLE END AS yb FROM tru)"""


def points(spark, sf):
    li = load(spark, sf, "lineitem")
    ident = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")
    d = li.groupBy(F.col("l_suppkey").alias("a"), ident.alias("match_id")).agg(
        F.max("l_discount").alias("disc"), F.max("l_tax").alias("tax"), F.max("l_quantity").alias("qty"))
    a, m = F.col("a"), F.col("match_id")
    t = sim_from_polar(0.9 + 0.02 * (a % 10), (a % 7 - 3) * 0.02, -300.0 + (a % 5) * 50, F.lit(8.0))
    d = d.withColumns({"xa": (m % 2000).cast("double"), "ya": (m * 7 % 1500).cast("double"), "t": t})
    x, y = sim_apply(F.col("t"), F.col("xa"), F.col("ya"))
    good = F.col("disc") < 0.045
    return d.select(F.lit(1).cast("bigint").alias("set_id"), "a", (a + 1000000).alias("b"), "match_id", "disc", "xa", "ya",
                    F.when(good, x + (F.col("tax") - 0.04) * 20).otherwise((m * 37 % 2000).cast("double")).alias("xb"),
                    F.when(good, y + (F.col("qty") - 25) / 40).otherwise((m * 61 % 1500).cast("double")).alias("yb"),
                    F.lit(2000).alias("width"), F.lit(1500).alias("height"))


def _fit_sql(src: str, out: str, keys: str = "a") -> str:
    return f"""{out}_m AS (SELECT {keys}, count(*) AS n, avg(xa) AS mxa, avg(ya) AS mya, avg(xb) AS mxb, avg(yb) AS myb,
  count(*) * (var_pop(xa) + var_pop(ya)) AS den, count(*) * (covar_pop(xa, xb) + covar_pop(ya, yb)) AS re,
  count(*) * (covar_pop(xa, yb) - covar_pop(ya, xb)) AS im FROM {src} GROUP BY {keys}),
{out} AS (SELECT {keys}, n, re/den AS sa, im/den AS sb, mxb - (re/den*mxa - im/den*mya) AS tx, myb - (im/den*mxa + re/den*mya) AS ty
  FROM {out}_m WHERE n >= 2 AND den > 1e-12)"""


@R.add("fit_similarity", f"WITH {_POINTS}, {_fit_sql('mp', 'f')} SELECT a, n, {sq('sa')} AS sa, {sq('sb')} AS sb, {sq('tx', 3)} AS tx, {sq('ty', 3)} AS ty FROM f")
def _(spark, sf):
    f = fitting.fit_similarity(points(spark, sf), ["a"])
    return f.select("a", "n", rd("t.a").alias("sa"), rd("t.b").alias("sb"), rd("t.tx", 3).alias("tx"), rd("t.ty", 3).alias("ty"))


@R.add("fit_similarity_weighted", f"""WITH {_POINTS}, w AS (SELECT *, 1 - disc * 9 AS w FROM mp),
  c AS (SELECT a, count(*) AS n, sum(w*xa)/sum(w) AS mxa, sum(w*ya)/sum(w) AS mya, sum(w*xb)/sum(w) AS mxb, sum(w*yb)/sum(w) AS myb FROM w GROUP BY a),
  s AS (SELECT a, n, any_value(mxa) AS mxa, any_value(mya) AS mya, any_value(mxb) AS mxb, any_value(myb) AS myb,
    sum(w*((xa-mxa)*(xa-mxa) + (ya-mya)*(ya-mya))) AS den, sum(w*((xa-mxa)*(xb-mxb) + (ya-mya)*(yb-myb))) AS re,
    sum(w*((xa-mxa)*(yb-myb) - (ya-mya)*(xb-mxb))) AS im FROM w JOIN c USING (a) GROUP BY a, n)
  SELECT a, n, {sq('re/den')} AS sa, {sq('im/den')} AS sb, {sq('mxb - (re/den*mxa - im/den*mya)', 3)} AS tx FROM s""")
def _(spark, sf):
    f = fitting.fit_similarity(points(spark, sf).withColumn("w", 1 - F.col("disc") * 9), ["a"], "w")
    return f.select("a", "n", rd("t.a").alias("sa"), rd("t.b").alias("sb"), rd("t.tx", 3).alias("tx"))


# planted homographies with perspective: exact on the rows with a low discount, far off on the others
_BENT = """hm AS (SELECT DISTINCT a, sc*cos(rot) AS h00, -sc*sin(rot) AS h01, tx AS h02, sc*sin(rot) AS h10, sc*cos(rot) AS h11, ty AS h12,
  (a % 5 - 2) * 1e-5::DOUBLE AS h20, (a % 3 - 1) * 2e-5::DOUBLE AS h21 FROM tru),
tb AS (SELECT a, match_id, disc, xa, ya, (h00*xa + h01*ya + h02) / (h20*xa + h21*ya + 1) AS px, (h10*xa + h11*ya + h12) / (h20*xa + h21*ya + 1) AS py FROM tru JOIN hm USING (a))"""


def bent_points(spark, sf, spoil: bool = True):
    p, a, m = points(spark, sf), F.col("a"), F.col("match_id")
    sc, rot = 0.9 + 0.02 * (a % 10), (a % 7 - 3) * 0.02
    w = (a % 5 - 2) * 1e-5 * F.col("xa") + (a % 3 - 1) * 2e-5 * F.col("ya") + 1
    x = (sc * F.cos(rot) * F.col("xa") - sc * F.sin(rot) * F.col("ya") - 300.0 + (a % 5) * 50) / w
    y = (sc * F.sin(rot) * F.col("xa") + sc * F.cos(rot) * F.col("ya") + 8.0) / w
    good = (F.col("disc") < 0.045) if spoil else F.lit(True)
    return p.withColumns({"xb": F.when(good, x).otherwise((m * 37 % 2000 + 6000).cast("double")), "yb": F.when(good, y).otherwise((m * 61 % 1500 + 6000).cast("double"))})


@R.add("fit_homography", f"""WITH {_POINTS}, {_BENT} SELECT a, (SELECT count(*) FROM tru WHERE tru.a = hm.a) AS n, {sq('h00', 5)} AS h00, {sq('h01', 5)} AS h01, {sq('h02', 3)} AS h02,
  {sq('h10', 5)} AS h10, {sq('h11', 5)} AS h11, {sq('h12', 3)} AS h12, {sq('h20', 9)} AS h20, {sq('h21', 9)} AS h21 FROM hm""")
def _(spark, sf):
    # planted without noise, so the fit must return the planted matrix, perspective included
    f = fitting.fit_homography(bent_points(spark, sf, False), ["a"])
    return f.select("a", "n", *[rd(F.col("h")[k], d).alias(c) for k, c, d in ((0, "h00", 5), (1, "h01", 5), (2, "h02", 3), (3, "h10", 5), (4, "h11", 5), (5, "h12", 3),
                                                                              (6, "h20", 9), (7, "h21", 9))])


def _h(k: int) -> str:
    return f"('0x' || substr(md5(concat_ws('-', 1, a, a + 1000000, t, {k})), 1, 8))::BIGINT"


_TRIALS = f"""ix AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY match_id) - 1 AS idx, count(*) OVER (PARTITION BY a) AS n FROM mp),
dr AS (SELECT a, n, t, {_h(0)} % n AS i, {_h(1)} % (n - 1) AS j FROM (SELECT DISTINCT a, n FROM ix WHERE n >= 2), range({TRIALS}) r(t)),
sm AS (SELECT dr.a, t, p.xa, p.ya, p.xb, p.yb, q.xa - p.xa AS dx, q.ya - p.ya AS dy, q.xb - p.xb AS ex, q.yb - p.yb AS ey
  FROM dr JOIN ix p ON p.a = dr.a AND p.idx = i JOIN ix q ON q.a = dr.a AND q.idx = j + CASE WHEN j >= i THEN 1 ELSE 0 END),
ab AS (SELECT *, (dx*ex + dy*ey) / (dx*dx + dy*dy) AS sa, (dx*ey - dy*ex) / (dx*dx + dy*dy) AS sb FROM sm WHERE (dx*dx + dy*dy) / 2 > 1e-12),
hy AS (SELECT a, t, sa, sb, xb - (sa*xa - sb*ya) AS tx, yb - (sb*xa + sa*ya) AS ty FROM ab
  WHERE sqrt(sa*sa + sb*sb) BETWEEN 0.5 AND 2 AND abs(atan2(sb, sa)) < radians(20)),
sc AS (SELECT hy.a, t, any_value(sa) AS sa, any_value(sb) AS sb, any_value(tx) AS tx, any_value(ty) AS ty, count(*) AS n_inliers FROM hy JOIN ix ON ix.a = hy.a
  WHERE pow(sa*xa - sb*ya + tx - xb, 2) + pow(sb*xa + sa*ya + ty - yb, 2) < 144 GROUP BY hy.a, t)"""
_CONSENSUS = f"""{_TRIALS},
best AS (SELECT * FROM sc WHERE n_inliers >= 2 QUALIFY row_number() OVER (PARTITION BY a ORDER BY n_inliers DESC, t) = 1),
agreed AS (SELECT ix.a, xa, ya, xb, yb FROM ix JOIN best ON ix.a = best.a WHERE pow(sa*xa - sb*ya + tx - xb, 2) + pow(sb*xa + sa*ya + ty - yb, 2) < 144),
{_fit_sql('agreed', 'refit')},
ok AS (SELECT a, sa, sb, tx, ty FROM refit WHERE sqrt(sa*sa + sb*sb) BETWEEN 0.5 AND 2 AND abs(atan2(sb, sa)) < radians(20)),
landed AS (SELECT ix.a, match_id, xb, yb, sa*xa - sb*ya + tx AS px, sb*xa + sa*ya + ty AS py FROM ix JOIN ok ON ix.a = ok.a),
flagged AS (SELECT *, pow(px - xb, 2) + pow(py - yb, 2) < 144 AS hit, px >= 0 AND px < 2000 AND py >= 0 AND py < 1500 AS inside FROM landed)"""


@R.add("hypotheses", f"WITH {_POINTS}, {_TRIALS} SELECT a, t AS trial, {sq('sa', 5)} AS sa, {sq('sb', 5)} AS sb, {sq('tx', 2)} AS tx FROM hy")
def _(spark, sf):
    ix = cut(fitting.index_points(points(spark, sf).withColumn("threshold", F.lit(12.0))))
    h = fitting.hypotheses(ix, "similarity", TRIALS)
    return h.select("a", F.col("trial").cast("bigint").alias("trial"), rd("t.a", 5).alias("sa"), rd("t.b", 5).alias("sb"), rd("t.tx", 2).alias("tx"))


@R.add("score_hypotheses", f"WITH {_POINTS}, {_TRIALS} SELECT a, t AS trial, n_inliers FROM sc")
def _(spark, sf):
    limit = fitting.inlier_threshold("similarity", F.col("width"), F.col("height"))
    ix = cut(fitting.index_points(points(spark, sf).withColumn("threshold", limit)))
    return fitting.score_hypotheses(ix, fitting.hypotheses(ix, "similarity", TRIALS)).select(
        "a", F.col("trial").cast("bigint").alias("trial"), "n_inliers")


@R.add("ransac_similarity", f"""WITH {_POINTS}, {_CONSENSUS} SELECT a, count(*) AS n_matches, count(*) FILTER (hit) AS n_inliers,
  count(*) FILTER (inside) AS n_overlap, 12::DOUBLE AS threshold, any_value(best.t) AS best_trial, count(*) FILTER (hit) >= 8 AS verified,
  {sq('any_value(sqrt(ok.sa*ok.sa + ok.sb*ok.sb))')} AS scale, {sq('any_value(ok.tx)', 3)} AS tx
  FROM flagged JOIN ok USING (a) JOIN best USING (a) GROUP BY a""")
def _(spark, sf):
    pairs, _ = fitting.ransac_pairs(points(spark, sf), "similarity", TRIALS)
    p = fitting.pair_similarity(pairs)
    scale = F.sqrt(F.col("t.a") * F.col("t.a") + F.col("t.b") * F.col("t.b"))
    return p.select("a", "n_matches", "n_inliers", "n_overlap", "threshold", F.col("best_trial").cast("bigint").alias("best_trial"),
                    "verified", rd(scale).alias("scale"), rd("t.tx", 3).alias("tx"))


@R.add("ransac_inliers", f"WITH {_POINTS}, {_CONSENSUS} SELECT a, match_id FROM flagged WHERE hit")
def _(spark, sf):
    return fitting.ransac_pairs(points(spark, sf), "similarity", TRIALS)[1].select("a", "match_id")


@R.add("match_report", f"""WITH {_POINTS}, {_CONSENSUS}, v AS (SELECT a, count(*) AS n_matches, count(*) FILTER (hit) AS n_inliers FROM flagged GROUP BY a)
  SELECT a, match_id AS fa, v.n_matches, v.n_inliers, CASE WHEN hit THEN 'inlier' ELSE 'outlier' END AS role,
  CASE WHEN v.n_inliers >= 8 THEN 'verified' WHEN v.n_inliers IS NULL THEN 'no model' ELSE 'rejected' END AS verdict
  FROM mp LEFT JOIN flagged USING (a, match_id) LEFT JOIN v USING (a)""")
def _(spark, sf):
    p = points(spark, sf)
    pairs, inliers = fitting.ransac_pairs(p, "similarity", TRIALS)
    matches = p.select("set_id", "a", "b", F.col("match_id").alias("fa"), F.col("match_id").alias("fb"))
    hits = inliers.select("set_id", "a", "b", F.col("match_id").alias("fa"), F.col("match_id").alias("fb"))
    return matching.match_report(matches, pairs, hits).select("a", "fa", "n_matches", "n_inliers", "role", "verdict")


def _area(i: int, j: int, k: int) -> str:
    return f"(x[{j}] - x[{i}]) * (y[{k}] - y[{i}]) <> (y[{j}] - y[{i}]) * (x[{k}] - x[{i}])"


# the winner is the first trial whose four rows are all planted and no three in line: its model is the planted one, whatever rounding does
_FIRST_CLEAN = f"""ix AS (SELECT a, match_id, disc, xa AS x, ya AS y, row_number() OVER (PARTITION BY a ORDER BY match_id) - 1 AS idx, count(*) OVER (PARTITION BY a) AS n FROM tru),
d1 AS (SELECT a, t, n, {_h(0)} % n AS i0, {_h(1)} % (n - 1) AS r1, {_h(2)} % (n - 2) AS r2, {_h(3)} % (n - 3) AS r3 FROM (SELECT DISTINCT a, n FROM ix WHERE n >= 4), range({TRIALS}) r(t)),
d2 AS (SELECT *, r1 + (r1 >= i0)::INT AS i1 FROM d1),
d3 AS (SELECT *, r2 + (r2 >= least(i0, i1))::INT + (r2 + (r2 >= least(i0, i1))::INT >= greatest(i0, i1))::INT AS i2 FROM d2),
d4 AS (SELECT *, list_sort([i0, i1, i2]) AS l FROM d3), d5 AS (SELECT *, r3 + (r3 >= l[1])::INT AS x1 FROM d4), d6 AS (SELECT *, x1 + (x1 >= l[2])::INT AS x2 FROM d5),
d7 AS (SELECT a, t, [i0, i1, i2, x2 + (x2 >= l[3])::INT] AS four FROM d6),
d8 AS (SELECT d7.a, t, list(x ORDER BY idx) AS x, list(y ORDER BY idx) AS y FROM d7 JOIN ix ON ix.a = d7.a AND list_contains(four, ix.idx) WHERE disc < 0.045 GROUP BY d7.a, t HAVING count(*) = 4),
clean AS (SELECT a, min(t) AS best_trial FROM d8 WHERE {' AND '.join(_area(*k) for k in ((1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)))} GROUP BY a)"""


@R.add("ransac_homography", f"""WITH {_POINTS}, {_BENT}, {_FIRST_CLEAN}, g AS (SELECT a, count(*) AS n_matches, count(*) FILTER (disc < 0.045) AS n_inliers,
    count(*) FILTER (px >= 0 AND px < 2000 AND py >= 0 AND py < 1500) AS n_overlap FROM tb GROUP BY a)
  SELECT a, n_matches, n_inliers, n_overlap, best_trial, n_inliers > 8 + 0.3::DOUBLE * n_overlap AS verified, {sq('h00', 5)} AS h00, {sq('h02', 3)} AS h02, {sq('h20', 8)} AS h20, {sq('h21', 8)} AS h21
  FROM g JOIN clean USING (a) JOIN hm USING (a)""")
def _(spark, sf):
    pairs, _ = fitting.ransac_pairs(bent_points(spark, sf), "homography", TRIALS)
    h = F.col("h")
    return pairs.select("a", "n_matches", "n_inliers", "n_overlap", F.col("best_trial").cast("bigint").alias("best_trial"), "verified", rd(h[0], 5).alias("h00"),
                        rd(h[2], 3).alias("h02"), rd(h[6], 8).alias("h20"), rd(h[7], 8).alias("h21"))


@R.add("verify_pairs", f"""WITH {_POINTS}, g AS (SELECT a, count(*) FILTER (disc < 0.025) AS n_inliers, count(*) FILTER (disc < 0.085) AS n_overlap FROM mp GROUP BY a)
  SELECT a, n_inliers, n_overlap, n_inliers > 8 + 0.3::DOUBLE * n_overlap AS as_homography, n_inliers >= 8 AS as_similarity FROM g""")
def _(spark, sf):
    g = points(spark, sf).groupBy("a").agg(F.count(F.when(F.col("disc") < 0.025, 1)).alias("n_inliers"),
                                           F.count(F.when(F.col("disc") < 0.085, 1)).alias("n_overlap"))
    h = fitting.verify_pairs(g.withColumn("model", F.lit("homography"))).withColumnRenamed("verified", "as_homography")
    return fitting.verify_pairs(h.withColumn("model", F.lit("similarity"))).withColumnRenamed("verified", "as_similarity").drop("model")


# --- placement: line items as landmarks seen by four overlapping sources per supplier ----------------

_MARKS = f"""lm AS (SELECT l_suppkey AS set_id, ({_ID} * 37 % 2800 + 50)::DOUBLE AS wx, ({_ID} * 61 % 1500)::DOUBLE AS wy FROM lineitem),
src AS (SELECT set_id, s AS source_id, 1 + 0.01::DOUBLE * ((set_id + s) % 3 - 1) AS sc, 0.01::DOUBLE * ((set_id * (s + 1)) % 5 - 2) AS rot,
  700::DOUBLE * s AS tx, 10::DOUBLE * s AS ty FROM (SELECT DISTINCT l_suppkey AS set_id FROM lineitem), range(4) r(s)),
pr AS (SELECT i, j FROM range(4) a(i), range(4) b(j) WHERE i < j),
ob AS (SELECT set_id, i, j, wx, wy FROM lm, pr WHERE wx >= 700*i - 100 AND wx < 700*i + 1300 AND wx >= 700*j - 100 AND wx < 700*j + 1300)"""


def truth(set_id, s):
    return sim_from_polar(1 + 0.01 * ((set_id + s) % 3 - 1), 0.01 * ((set_id * (s + 1)) % 5 - 2), 700.0 * s, 10.0 * s)


def observations(spark, sf):
    li = load(spark, sf, "lineitem")
    ident = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")
    pairs = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j"))
                                for i in range(4) for j in range(i + 1, 4)]))
    lm = li.select(F.col("l_suppkey").alias("set_id"), (ident * 37 % 2800 + 50).cast("double").alias("wx"),
                   (ident * 61 % 1500).cast("double").alias("wy"), pairs.alias("p")).select("set_id", "p.*", "wx", "wy")
    for s in ("i", "j"):
        lm = lm.filter((F.col("wx") >= 700 * F.col(s) - 100) & (F.col("wx") < 700 * F.col(s) + 1300))
    lm = lm.withColumn("ti", sim_inverse(truth(F.col("set_id"), F.col("i")))).withColumn("tj", sim_inverse(truth(F.col("set_id"), F.col("j"))))
    px, py = sim_apply(F.col("ti"), F.col("wx"), F.col("wy"))
    qx, qy = sim_apply(F.col("tj"), F.col("wx"), F.col("wy"))
    return lm.select("set_id", F.lit(0).cast("bigint").alias("component"), "i", "j", px.alias("px"), py.alias("py"), qx.alias("qx"), qy.alias("qy"), "wx")


def sources(spark, sf):
    sets = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("set_id")).distinct()
    s = sets.withColumn("source_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))
    return s.withColumn("component", F.lit(0).cast("bigint"))


@R.add("place_similarity", f"""WITH {_MARKS}, ends AS (SELECT set_id, i AS s FROM ob UNION ALL SELECT set_id, j FROM ob),
  deg AS (SELECT set_id, s, count(*) AS d FROM ends GROUP BY 1, 2),
  anchor AS (SELECT set_id, s AS anchor FROM deg QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY d DESC, s) = 1),
  rel AS (SELECT d.set_id, d.s AS source_id, t.sc / a.sc AS sc, t.rot - a.rot AS rot,
    ((t.tx - a.tx) * cos(a.rot) + (t.ty - a.ty) * sin(a.rot)) / a.sc AS tx, ((t.ty - a.ty) * cos(a.rot) - (t.tx - a.tx) * sin(a.rot)) / a.sc AS ty
    FROM deg d JOIN anchor n ON d.set_id = n.set_id JOIN src t ON t.set_id = d.set_id AND t.source_id = d.s JOIN src a ON a.set_id = d.set_id AND a.source_id = n.anchor),
  g AS (SELECT set_id, exp(-avg(ln(sc))) AS gs, -avg(rot) AS gr FROM rel GROUP BY 1)
  SELECT set_id, source_id, {sq('sc * gs')} AS scale, {sq('rot + gr')} AS rotation, {sq('gs * (cos(gr)*tx - sin(gr)*ty)', 3)} AS tx,
  {sq('gs * (sin(gr)*tx + cos(gr)*ty)', 3)} AS ty FROM rel JOIN g USING (set_id)""")
def _(spark, sf):
    # the planted frame has no noise, so the robust solve must return it up to the gauge SQL applies
    placed, _ = placement.place_similarity(observations(spark, sf))
    t = F.col("t")
    return placed.select("set_id", "source_id", rd(F.sqrt(t["a"] * t["a"] + t["b"] * t["b"])).alias("scale"),
                         rd(F.atan2(t["b"], t["a"])).alias("rotation"), rd(t["tx"], 3).alias("tx"), rd(t["ty"], 3).alias("ty"))


_IMG = """im AS (SELECT o.set_id, o.i, o.j, o.wx, o.wy, ((o.wx - ti.tx) * cos(ti.rot) + (o.wy - ti.ty) * sin(ti.rot)) / ti.sc AS px,
  ((o.wy - ti.ty) * cos(ti.rot) - (o.wx - ti.tx) * sin(ti.rot)) / ti.sc AS py, ((o.wx - tj.tx) * cos(tj.rot) + (o.wy - tj.ty) * sin(tj.rot)) / tj.sc AS qx,
  ((o.wy - tj.ty) * cos(tj.rot) - (o.wx - tj.tx) * sin(tj.rot)) / tj.sc AS qy
  FROM ob o JOIN src ti ON ti.set_id = o.set_id AND ti.source_id = o.i JOIN src tj ON tj.set_id = o.set_id AND tj.source_id = o.j)"""


@R.add("residual_metrics", f"""WITH {_MARKS}, {_IMG}, r AS (SELECT set_id, (wx % 11) <> 0 AS ok, sqrt(pow(px + 700*i - qx - 700*j, 2) + pow(py + 10*i - qy - 10*j, 2)) AS r FROM im)
  SELECT set_id, count(*) FILTER (ok) AS n, {sq('sqrt(avg(r*r) FILTER (ok))', 4)} AS rms,
  {sq('sum(CASE WHEN NOT ok THEN 1000000 WHEN r < 10 THEN r*r ELSE 20*r - 100 END)', 2)} AS loss,
  {sq('avg(CASE WHEN r > 10 THEN 10 / r ELSE 1 END) FILTER (ok)')} AS mean_weight FROM r GROUP BY 1""")
def _(spark, sf):
    rough = sources(spark, sf).withColumn("t", sim(F.lit(1.0), F.lit(0.0), F.col("source_id") * 700.0, F.col("source_id") * 10.0))
    res = placement.placement_residuals(observations(spark, sf), rough).withColumn("ok", F.col("wx") % 11 != 0)
    m = placement.residual_metrics(res, ["set_id"], 10.0, "ok")
    return m.select("set_id", "n", rd("rms", 4).alias("rms"), rd("loss", 2).alias("loss"), rd("mean_weight").alias("mean_weight"))


@R.add("camera_residuals", f"""SELECT s_nationkey::BIGINT AS set_id, count(*) AS n, {sq('sqrt(avg(l_tax*l_tax + l_discount*l_discount))')} AS rms FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def _(spark, sf):
    # two cameras per nation see the same directions; what is added to one side must come back as the residual
    zero = F.lit(0.0)

    def rot(pan):
        return F.array(F.cos(pan), zero, -F.sin(pan), zero, F.lit(1.0), zero, F.sin(pan), zero, F.cos(pan))

    nations = load(spark, sf, "supplier").select(F.col("s_nationkey").cast("bigint").alias("set_id")).distinct()
    cams = nations.withColumn("source_id", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))).select(
        "set_id", "source_id", rot((F.col("source_id") * 0.4 - 0.2) + F.col("set_id") * 0.01).alias("rot"), (700 + 50.0 * F.col("source_id")).alias("focal"))
    li, su = load(spark, sf, "lineitem"), load(spark, sf, "supplier")
    d = li.join(su, li.l_suppkey == su.s_suppkey).select(
        F.col("s_nationkey").cast("bigint").alias("set_id"), "l_tax", "l_discount", F.lit(0).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"),
        angles_ray((F.col("l_partkey") % 50) * 0.01 - 0.25 + F.col("s_nationkey") * 0.01, (F.col("l_linenumber") - 4) * 0.1)[0].alias("dx"),
        (-F.sin((F.col("l_linenumber") - 4) * 0.1)).alias("dy"),
        angles_ray((F.col("l_partkey") % 50) * 0.01 - 0.25 + F.col("s_nationkey") * 0.01, (F.col("l_linenumber") - 4) * 0.1)[2].alias("dz"))
    ray = (F.col("dx"), F.col("dy"), F.col("dz"))
    ax, ay = cam_project(rot(-0.2 + F.col("set_id") * 0.01), F.lit(700.0), ray)
    bx, by = cam_project(rot(0.2 + F.col("set_id") * 0.01), F.lit(750.0), ray)
    obs = d.select("set_id", "a", "b", (ax + F.col("l_tax")).alias("ax"), (ay - F.col("l_discount")).alias("ay"), bx.alias("bx"), by.alias("by"))
    m = placement.residual_metrics(placement.camera_residuals(obs, cams), ["set_id"], 2.0, "usable")
    return m.select("set_id", "n", rd("rms").alias("rms"))


_FRAME = """sz AS (SELECT *, (1400 + set_id % 50)::INT AS width, (1500 - set_id % 40)::INT AS height FROM src),
cr AS (SELECT set_id, sc*cos(rot)*x - sc*sin(rot)*y + tx AS x, sc*sin(rot)*x + sc*cos(rot)*y + ty AS y FROM
  (SELECT *, unnest([0, width, 0, width])::DOUBLE AS x, unnest([0, 0, height, height])::DOUBLE AS y FROM sz)),
fr AS (SELECT set_id, min(x) AS ox, min(y) AS oy, max(x) - min(x) AS ex, max(y) - min(y) AS ey FROM cr GROUP BY 1)"""


def placed_sources(spark, sf):
    s = sources(spark, sf)
    return s.withColumn("t", truth(F.col("set_id"), F.col("source_id"))).withColumns({
        "width": (1400 + F.col("set_id") % 50).cast("int"), "height": (1500 - F.col("set_id") % 40).cast("int")})


@R.add("frame_extent", f"""WITH {_MARKS}, {_FRAME} SELECT set_id, {sq('ox', 3)} AS origin_x, {sq('oy', 3)} AS origin_y, {sq('ex', 3)} AS extent_x,
  {sq('ey', 3)} AS extent_y, {sq('700 / ex')} AS scale, greatest(1, floor(ey * (700 / ex)))::INT AS out_height FROM fr""")
def _(spark, sf):
    f = placement.rescale_frame(placement.frame_extent(placed_sources(spark, sf), 3000, ["set_id"]), 700)
    return f.select("set_id", *[rd(c, 3).alias(c) for c in ("origin_x", "origin_y", "extent_x", "extent_y")], rd("scale").alias("scale"), "out_height")


@R.add("angular_frame", f"""WITH cam AS (SELECT s_nationkey AS set_id, s_suppkey, (s_suppkey % 9 - 4) * 0.1::DOUBLE AS pan, 600 + s_acctbal / 20 AS f FROM supplier),
  e AS (SELECT *, unnest([k/16*1200, k/16*1200, 0, 1200])::DOUBLE AS x, unnest([0, 900, k/16*900, k/16*900])::DOUBLE AS y FROM cam, range(17) r(k)),
  q AS (SELECT *, (x - 600) / f AS qx, (y - 450) / f AS qy FROM e),
  d AS (SELECT set_id, cos(pan)*qx + sin(pan) AS dx, qy AS dy, cos(pan) - sin(pan)*qx AS dz FROM q),
  n AS (SELECT set_id, atan2(dx, dz) AS th, asin(-dy / sqrt(dx*dx + dy*dy + dz*dz)) AS ph FROM d),
  b AS (SELECT set_id, max(th) - min(th) AS span, min(th) AS u0, max(th) AS u1, min(tan(ph)) AS v0, max(tan(ph)) AS v1 FROM n GROUP BY 1)
  SELECT set_id, {sq('span')} AS theta_span, {sq('u1 - u0')} AS extent_x, {sq('v1 - v0')} AS extent_y, {sq('1000 / (u1 - u0)', 4)} AS scale,
  greatest(1, floor((v1 - v0) * (1000 / (u1 - u0))))::INT AS out_height FROM b""")
def _(spark, sf):
    pan = (F.col("s_suppkey") % 9 - 4) * 0.1
    zero = F.lit(0.0)
    rot = F.array(F.cos(pan), zero, -F.sin(pan), zero, F.lit(1.0), zero, F.sin(pan), zero, F.cos(pan))
    cams = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("set_id"), rot.alias("rot"), (600 + F.col("s_acctbal") / 20).alias("focal"),
                                              F.lit(1200).alias("width"), F.lit(900).alias("height"))
    f = placement.angular_frame(cams, F.lit("cylindrical"), 1000, ["set_id"])
    return f.select("set_id", rd(F.col("theta_max") - F.col("theta_min")).alias("theta_span"), rd("extent_x").alias("extent_x"),
                    rd("extent_y").alias("extent_y"), rd("scale", 4).alias("scale"), "out_height")


_MESH = f"""pt AS (SELECT DISTINCT l_suppkey AS set_id, l_orderkey, l_linenumber, l_partkey, ({_ID} % 830 - 10)::DOUBLE AS x, ({_ID} * 7 % 610 - 5)::DOUBLE AS y FROM lineitem),
g AS (SELECT *, least(greatest(x, 0), 800) / 800 * 8 AS gx, least(greatest(y, 0), 600) / 600 * 6 AS gy FROM pt),
c AS (SELECT *, least(floor(gx), 7) AS c0, least(floor(gy), 5) AS r0 FROM g),
f AS (SELECT *, gx - c0 AS fx, gy - r0 AS fy FROM c)"""


def _dx(r, c):
    return f"(({r}) * 3 + ({c}) + set_id % 5)"


@R.add("mesh_offset", f"""WITH {_MESH} SELECT l_orderkey, l_linenumber, l_partkey,
  {sq(f"(1-fx)*(1-fy)*{_dx('r0', 'c0')} + fx*(1-fy)*{_dx('r0', 'c0+1')} + (1-fx)*fy*{_dx('r0+1', 'c0')} + fx*fy*{_dx('r0+1', 'c0+1')}")} AS ox,
  {sq('(1-fx)*(1-fy)*(r0-c0) + fx*(1-fy)*(r0-c0-1) + (1-fx)*fy*(r0+1-c0) + fx*fy*(r0-c0)')} AS oy FROM f""")
def _(spark, sf):
    li = load(spark, sf, "lineitem")
    ident = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")
    pts = li.select(F.col("l_suppkey").alias("set_id"), F.lit(0).cast("bigint").alias("source_id"), "l_orderkey", "l_linenumber", "l_partkey",
                    (ident % 830 - 10).cast("double").alias("x"), (ident * 7 % 610 - 5).cast("double").alias("y"),
                    F.lit(800).alias("width"), F.lit(600).alias("height")).distinct()
    mesh = (pts.select("set_id", "source_id").distinct().withColumn("vr", F.explode(F.sequence(F.lit(0), F.lit(6))))
            .withColumn("vc", F.explode(F.sequence(F.lit(0), F.lit(8))))
            .withColumn("dx", (F.col("vr") * 3 + F.col("vc") + F.col("set_id") % 5).cast("double"))
            .withColumn("dy", (F.col("vr") - F.col("vc")).cast("double")))
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    # line items can repeat within an order line, so the supplier is part of the grouping key and copies count once
    got = surface.mesh_offset(pts, mesh, ["set_id", *key], 100)
    return got.select(*key, rd("ox").alias("ox"), rd("oy").alias("oy"))


@R.add("mesh_max_offset", """WITH m AS (SELECT DISTINCT l_suppkey AS set_id FROM lineitem)
  SELECT set_id, max(sqrt(pow(r*3 + c + set_id % 5, 2) + pow(r - c, 2))) AS max_offset FROM m, range(7) a(r), range(9) b(c) GROUP BY 1""")
def _(spark, sf):
    mesh = (load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.lit(0).alias("source_id")).distinct()
            .withColumn("vr", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("vc", F.explode(F.sequence(F.lit(0), F.lit(8))))
            .withColumn("dx", (F.col("vr") * 3 + F.col("vc") + F.col("set_id") % 5).cast("double"))
            .withColumn("dy", (F.col("vr") - F.col("vc")).cast("double")))
    return surface.mesh_max_offset(mesh).select("set_id", "max_offset")


def _rough(spark, sf):
    """Placements that are off by up to two along x, by source."""
    return placed_sources(spark, sf).withColumn("t", F.struct(F.col("t.a"), F.col("t.b"), (F.col("t.tx") + F.col("source_id") % 3).alias("tx"), F.col("t.ty")))


@R.add("fit_offset_surface")
def _(spark, sf):
    mesh, metrics = surface.fit_offset_surface(observations(spark, sf), _rough(spark, sf))
    rms = metrics.groupBy("set_id").agg(*[F.max(F.when(F.col("stage") == s, F.col("rms"))).alias(f"rms_{s}") for s in ("before", "after")])
    return mesh.join(rms, "set_id").select("set_id", "source_id", "vr", "vc", rd("dx", 4).alias("dx"), rd("dy", 4).alias("dy"),
                                           rd("rms_before", 4).alias("rms_before"), rd("rms_after", 4).alias("rms_after"))


def _coarse_surface(sweeps: int) -> str:
    """Offset surfaces of two by two vertices in SQL: four unknowns a source, eliminated column by column in every sweep."""
    four = range(4)
    edges = [(0, 1), (2, 3), (0, 2), (1, 3)]

    def weights(x: str, y: str, w: str, h: str) -> list[str]:
        fx, fy = f"least(greatest({x}, 0), {w}) / {w}", f"least(greatest({y}, 0), {h}) / {h}"
        return [f"(1 - {fx}) * (1 - {fy})", f"{fx} * (1 - {fy})", f"(1 - {fx}) * ({fy})", f"{fx} * ({fy})"]

    tied = {(a, b): -1.0 for e in edges for a, b in (e, e[::-1])} | {(a, a): 0.02 + sum(a in e for e in edges) for a in four}
    steps = []
    for k in range(sweeps):
        off = {c: " + ".join(f"u{a} * o.{c}{a}" for a in four) for c in "xy"}
        steps.append(f"""p{k} AS (SELECT c.*, c.ux + {off['x']} AS vx, c.uy + {off['y']} AS vy FROM con c JOIN s{k} o ON o.set_id = c.set_id AND o.s = c.o),
q{k} AS (SELECT *, sco * (cos(roto) * vx - sin(roto) * vy) + txo AS wx, sco * (sin(roto) * vx + cos(roto) * vy) + tyo AS wy FROM p{k}),
g{k} AS (SELECT *, (cos(rot) * (wx - tx) + sin(rot) * (wy - ty)) / sc - x AS pullx, (cos(rot) * (wy - ty) - sin(rot) * (wx - tx)) / sc - y AS pully FROM q{k})""")
        if k == sweeps - 1:
            break
        sides = ", ".join(f"sum(w{a} * pull{c}) AS r{c}{a}" for c in "xy" for a in four)
        steps.append(f"e{k}_0 AS (SELECT m.*, {', '.join(f'r{c}{a}' for c in 'xy' for a in four)} FROM mat m JOIN (SELECT set_id, s, {sides} FROM g{k} GROUP BY ALL) USING (set_id, s))")
        for j in range(3):
            less = [f"{n}{a}{b} - {n}{j}{b} * m{a}{j} / m{j}{j} AS {n}{a}{b}" for n in "m" for a in range(j + 1, 4) for b in range(j, 4)]
            less += [f"r{c}{a} - r{c}{j} * m{a}{j} / m{j}{j} AS r{c}{a}" for c in "xy" for a in range(j + 1, 4)]
            steps.append(f"e{k}_{j + 1} AS (SELECT * REPLACE ({', '.join(less)}) FROM e{k}_{j})")
        back = f"e{k}_3"
        for a in (3, 2, 1, 0):
            found = ", ".join(f"(r{c}{a}{''.join(f' - m{a}{b} * n{c}{b}' for b in range(a + 1, 4))}) / m{a}{a} AS n{c}{a}" for c in "xy")
            steps.append(f"b{k}_{a} AS (SELECT *, {found} FROM {back})")
            back = f"b{k}_{a}"
        steps.append(f"s{k + 1} AS (SELECT o.set_id, o.s, {', '.join(f'{c}{a} + 0.5::DOUBLE * coalesce(n{c}{a} - {c}{a}, 0) AS {c}{a}' for c in 'xy' for a in four)} "
                     f"FROM s{k} o LEFT JOIN {back} USING (set_id, s))")
    rms = [f"""m{k} AS (SELECT g.set_id, sqrt(avg(pow(pullx - ({' + '.join(f'w{a} * o.x{a}' for a in four)}), 2) + pow(pully - ({' + '.join(f'w{a} * o.y{a}' for a in four)}), 2))) AS rms
  FROM g{k} g JOIN s{k} o ON o.set_id = g.set_id AND o.s = g.s GROUP BY g.set_id)""" for k in (0, sweeps - 1)]
    own, other = weights("x", "y", "w", "h"), weights("ux", "uy", "wo", "ho")
    cells = ", ".join(f"sum(w{a} * w{b}) + {tied.get((a, b), 0.0)}::DOUBLE AS m{a}{b}" for a in four for b in four)
    last = sweeps - 1
    return f"""WITH {_MARKS}, rough AS (SELECT set_id, source_id AS s, sc, rot, tx + source_id % 3 AS tx, ty, tx AS true_tx, 1400 + set_id % 50 AS w, 1500 - set_id % 40 AS h FROM src),
ends AS (SELECT set_id, i AS s, j AS o, wx AS lx, wy AS ly FROM ob UNION ALL SELECT set_id, j, i, wx, wy FROM ob),
pts AS (SELECT e.set_id, e.s, e.o, a.sc, a.rot, a.tx, a.ty, a.w::DOUBLE AS w, a.h::DOUBLE AS h, b.sc AS sco, b.rot AS roto, b.tx AS txo, b.ty AS tyo, b.w::DOUBLE AS wo, b.h::DOUBLE AS ho,
  (cos(a.rot) * (lx - a.true_tx) + sin(a.rot) * (ly - a.ty)) / a.sc AS x, (cos(a.rot) * (ly - a.ty) - sin(a.rot) * (lx - a.true_tx)) / a.sc AS y,
  (cos(b.rot) * (lx - b.true_tx) + sin(b.rot) * (ly - b.ty)) / b.sc AS ux, (cos(b.rot) * (ly - b.ty) - sin(b.rot) * (lx - b.true_tx)) / b.sc AS uy
  FROM ends e JOIN rough a ON a.set_id = e.set_id AND a.s = e.s JOIN rough b ON b.set_id = e.set_id AND b.s = e.o),
con AS (SELECT *, {', '.join(f'{e} AS w{a}' for a, e in enumerate(own))}, {', '.join(f'{e} AS u{a}' for a, e in enumerate(other))} FROM pts),
mat AS (SELECT set_id, s, {cells} FROM con GROUP BY ALL),
s0 AS (SELECT set_id, s, {', '.join(f'0::DOUBLE AS {c}{a}' for c in 'xy' for a in four)} FROM rough),
{', '.join([*steps, *rms])}
SELECT set_id, s AS source_id, vr, vc, {sq('CASE vr * 2 + vc ' + ' '.join(f'WHEN {a} THEN x{a}' for a in four) + ' END', 4)} AS dx,
  {sq('CASE vr * 2 + vc ' + ' '.join(f'WHEN {a} THEN y{a}' for a in four) + ' END', 4)} AS dy, {sq('m0.rms', 4)} AS rms_before, {sq(f'm{last}.rms', 4)} AS rms_after
FROM s{last} JOIN m0 USING (set_id) JOIN m{last} USING (set_id), (SELECT k::INT // 2 AS vr, k::INT % 2 AS vc FROM range(4) v(k))"""


@R.add("fit_offset_surface_coarse", _coarse_surface(5))
def _(spark, sf):
    mesh, metrics = surface.fit_offset_surface(observations(spark, sf), _rough(spark, sf), spacing=4000, sweeps=4)
    rms = metrics.groupBy("set_id").agg(*[F.max(F.when(F.col("stage") == s, F.col("rms"))).alias(f"rms_{s}") for s in ("before", "after")])
    return mesh.join(rms, "set_id").select("set_id", "source_id", "vr", "vc", rd("dx", 4).alias("dx"), rd("dy", 4).alias("dy"),
                                           rd("rms_before", 4).alias("rms_before"), rd("rms_after", 4).alias("rms_after"))


QUERIES, ORACLE = R.queries, R.oracle
