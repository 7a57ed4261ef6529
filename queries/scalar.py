"""Scalar column functions and catalogue operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from queries.common import Registry, load, rd, sq
from tessera.functions import plane, projective, similarity as S
from tessera.operators.matching import feature_summary, top_k_response
from tessera.operators.placement import auto_projection, camera_widths, natural_width, strip_widths, working_width
from tessera.session import checkpoint_dir
from tessera.sources.files import exclude_own, normalize_catalog, scan_files, write_groups

R = Registry()

# --- transforms from line items: discount sets the scale, tax the tilt, the rest position ------------

_T = """t AS (SELECT l_orderkey, l_linenumber, 0.45::DOUBLE + l_discount * 10 AS sc, l_tax * 4 - 0.16::DOUBLE AS rot,
  l_quantity * 10 AS tx, l_extendedprice / 100 AS ty, (l_partkey % 1000)::DOUBLE AS x, (l_suppkey % 700)::DOUBLE AS y
  FROM lineitem),
s AS (SELECT *, sc * cos(rot) AS a, sc * sin(rot) AS b FROM t),
i AS (SELECT *, a / (a*a + b*b) AS ia, -b / (a*a + b*b) AS ib FROM s),
j AS (SELECT *, -(ia*tx - ib*ty) AS itx, -(ib*tx + ia*ty) AS ity FROM i)"""


def transforms(spark, sf):
    li = load(spark, sf, "lineitem")
    base = li.select("l_orderkey", "l_linenumber", (0.45 + F.col("l_discount") * 10).alias("sc"),
                     (F.col("l_tax") * 4 - 0.16).alias("rot"), (F.col("l_quantity") * 10).alias("tx"),
                     (F.col("l_extendedprice") / 100).alias("ty"), (F.col("l_partkey") % 1000).cast("double").alias("x"),
                     (F.col("l_suppkey") % 700).cast("double").alias("y"))
    return base.withColumn("t", S.sim_from_polar(F.col("sc"), F.col("rot"), F.col("tx"), F.col("ty")))


KEY = ["l_orderkey", "l_linenumber"]


@R.add("sim_apply", f"WITH {_T} SELECT l_orderkey, l_linenumber, {sq('a*x - b*y + tx', 4)} AS px, "
                    f"{sq('b*x + a*y + ty', 4)} AS py FROM s")
def _(spark, sf):
    x, y = S.sim_apply(F.col("t"), F.col("x"), F.col("y"))
    return transforms(spark, sf).select(*KEY, rd(x, 4).alias("px"), rd(y, 4).alias("py"))


@R.add("sim_inverse", f"WITH {_T} SELECT l_orderkey, l_linenumber, {sq('ia')} AS a, {sq('ib')} AS b, "
                      f"{sq('itx', 4)} AS tx, {sq('ity', 4)} AS ty FROM j")
def _(spark, sf):
    d = transforms(spark, sf).withColumn("i", S.sim_inverse(F.col("t")))
    return d.select(*KEY, rd(F.col("i.a")).alias("a"), rd(F.col("i.b")).alias("b"), rd(F.col("i.tx"), 4).alias("tx"),
                    rd(F.col("i.ty"), 4).alias("ty"))


@R.add("sim_compose", f"""WITH {_T} SELECT l_orderkey, l_linenumber, {sq('a*ia - b*ib')} AS a, {sq('a*ib + b*ia')} AS b,
  {sq('a*x - b*y + tx', 4)} AS tx, {sq('b*x + a*y + ty', 4)} AS ty FROM j""")
def _(spark, sf):
    d = transforms(spark, sf).withColumn("i", S.sim_inverse(F.col("t")))
    inner = S.sim(F.col("i.a"), F.col("i.b"), F.col("x"), F.col("y"))
    d = d.withColumn("c", S.sim_compose(F.col("t"), inner))
    return d.select(*KEY, rd(F.col("c.a")).alias("a"), rd(F.col("c.b")).alias("b"), rd(F.col("c.tx"), 4).alias("tx"),
                    rd(F.col("c.ty"), 4).alias("ty"))


@R.add("sim_polar", f"WITH {_T} SELECT l_orderkey, l_linenumber, {sq('sqrt(a*a + b*b)')} AS scale, "
                    f"{sq('atan2(b, a)')} AS rotation, (sqrt(a*a + b*b) >= 0.5 AND sqrt(a*a + b*b) <= 2 "
                    f"AND abs(atan2(b, a)) < radians(20)) AS plausible FROM s")
def _(spark, sf):
    d = transforms(spark, sf)
    return d.select(*KEY, rd(S.sim_scale(F.col("t"))).alias("scale"), rd(S.sim_rotation(F.col("t"))).alias("rotation"),
                    S.sim_plausible(F.col("t")).alias("plausible"))


@R.add("sim_homography", f"""WITH {_T}, h AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 0.001::DOUBLE ELSE 0::DOUBLE END AS p,
  2.0::DOUBLE AS z FROM s) SELECT l_orderkey, l_linenumber, {sq('CASE WHEN abs(p) < 1e-9 THEN a * (1 / z) END')} AS a,
  {sq('CASE WHEN abs(p) < 1e-9 THEN tx * (1 / z) END', 4)} AS tx FROM h""")
def _(spark, sf):
    t = F.col("t")
    m = S.sim_to_h(t)
    p = F.when(F.col("l_linenumber") % 2 == 0, 0.001).otherwise(0.0)
    h = F.array(*[m[k] for k in range(6)], p, m[7], m[8] * 2)
    d = transforms(spark, sf).withColumn("h", h).withColumn("s", S.h_to_sim(F.col("h")))
    return d.select(*KEY, rd(F.col("s.a")).alias("a"), rd(F.col("s.tx"), 4).alias("tx"))


@R.add("h_apply", f"""WITH {_T}, w AS (SELECT *, a*x - b*y + tx AS u, b*x + a*y + ty AS v,
  CASE WHEN l_linenumber = 3 THEN 0 ELSE 0.001::DOUBLE * x + 0.0005::DOUBLE * y + (l_linenumber - 3) * 2 END AS w FROM s)
  SELECT l_orderkey, l_linenumber, {sq('CASE WHEN w <> 0 THEN u / w END', 3)} AS px,
  {sq('CASE WHEN w <> 0 THEN v / w END', 3)} AS py FROM w""")
def _(spark, sf):
    m = S.sim_to_h(F.col("t"))
    tilt = F.when(F.col("l_linenumber") == 3, 0.0)
    h = F.array(*[m[k] for k in range(6)], tilt.otherwise(0.001), tilt.otherwise(0.0005),
                ((F.col("l_linenumber") - 3) * 2).cast("double"))
    x, y = projective.h_apply(F.col("h"), F.col("x"), F.col("y"))
    return transforms(spark, sf).withColumn("h", h).select(*KEY, rd(x, 3).alias("px"), rd(y, 3).alias("py"))


# --- cameras: one per supplier, looking at directions derived from line items ----------------------

_CAM = """c AS (SELECT l_orderkey, l_linenumber, (s_nationkey - 12) * 0.05::DOUBLE AS pan, 600 + s_acctbal / 20 AS f,
  ((l_partkey % 180) * 0.01::DOUBLE - 0.9::DOUBLE) AS th, (l_linenumber - 4) * 0.1::DOUBLE AS ph
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
d AS (SELECT *, sin(th)*cos(ph) AS dx, -sin(ph) AS dy, cos(th)*cos(ph) AS dz FROM c),
p AS (SELECT *, cos(pan)*dx - sin(pan)*dz AS cx, dy AS cy, sin(pan)*dx + cos(pan)*dz AS cz FROM d)"""


def seen(spark, sf):
    li, su = load(spark, sf, "lineitem"), load(spark, sf, "supplier")
    pan = (F.col("s_nationkey") - 12) * 0.05
    zero = F.lit(0.0)
    rot = F.array(F.cos("pan"), zero, -F.sin("pan"), zero, F.lit(1.0), zero, F.sin("pan"), zero, F.cos("pan"))
    return (li.join(su, li.l_suppkey == su.s_suppkey)
            .select(*KEY, pan.alias("pan"), (600 + F.col("s_acctbal") / 20).alias("f"),
                    ((F.col("l_partkey") % 180) * 0.01 - 0.9).alias("th"), ((F.col("l_linenumber") - 4) * 0.1).alias("ph"))
            .withColumn("rot", rot))


@R.add("camera_project", f"""WITH {_CAM.replace('AS th', '* 3 AS th')}
  SELECT l_orderkey, l_linenumber, {sq('CASE WHEN cz > 1e-9 THEN f*cx/cz END', 2)} AS px,
  {sq('CASE WHEN cz > 1e-9 THEN f*cy/cz END', 2)} AS py FROM p""")
def _(spark, sf):
    wide = seen(spark, sf).withColumn("th", F.col("th") * 3)
    x, y = projective.cam_project(F.col("rot"), F.col("f"), projective.angles_ray(F.col("th"), F.col("ph")))
    return wide.select(*KEY, rd(x, 2).alias("px"), rd(y, 2).alias("py"))


@R.add("camera_ray", f"""WITH {_CAM}, q AS (SELECT *, (l_linenumber * 100 - 400::DOUBLE) / f AS qx, (th * 300) / f AS qy FROM c),
  w AS (SELECT *, cos(pan)*qx + sin(pan) AS wx, qy AS wy, cos(pan) - sin(pan)*qx AS wz FROM q)
  SELECT l_orderkey, l_linenumber, {sq('wx / sqrt(wx*wx + wy*wy + wz*wz)')} AS rx,
  {sq('wy / sqrt(wx*wx + wy*wy + wz*wz)')} AS ry, {sq('wz / sqrt(wx*wx + wy*wy + wz*wz)')} AS rz FROM w""")
def _(spark, sf):
    cx, cy = projective.cam_centered(F.lit(800.0), F.lit(0.0), F.col("l_linenumber") * 100, F.col("th") * 300)
    r = projective.cam_ray(F.col("rot"), F.col("f"), cx, cy)
    return seen(spark, sf).select(*KEY, rd(r[0]).alias("rx"), rd(r[1]).alias("ry"), rd(r[2]).alias("rz"))


@R.add("camera_homography", f"""SELECT i.s_suppkey AS i, j.s_suppkey AS j,
  {sq('(600 + i.s_acctbal/20) * cos((i.s_nationkey - j.s_nationkey) * 0.05::DOUBLE) / (600 + j.s_acctbal/20)')} AS h00,
  {sq('-(600 + i.s_acctbal/20) * sin((i.s_nationkey - j.s_nationkey) * 0.05::DOUBLE)', 3)} AS h02,
  {sq('sin((i.s_nationkey - j.s_nationkey) * 0.05::DOUBLE) / (600 + j.s_acctbal/20)', 8)} AS h20
  FROM supplier i JOIN supplier j ON j.s_suppkey = i.s_suppkey + 1""")
def _(spark, sf):
    su = load(spark, sf, "supplier")
    zero = F.lit(0.0)

    def cam(shift, n):
        pan = (F.col("s_nationkey") - 12) * 0.05
        rot = F.array(F.cos(pan), zero, -F.sin(pan), zero, F.lit(1.0), zero, F.sin(pan), zero, F.cos(pan))
        return su.select((F.col("s_suppkey") - shift).alias("k"), F.col("s_suppkey").alias(n), rot.alias("r" + n),
                         (600 + F.col("s_acctbal") / 20).alias("f" + n))

    h = projective.cam_homography(F.col("ri"), F.col("fi"), F.col("rj"), F.col("fj"))
    return (cam(0, "i").join(cam(1, "j"), "k").withColumn("h", h)
            .select("i", "j", rd(F.col("h")[0]).alias("h00"), rd(F.col("h")[2], 3).alias("h02"), rd(F.col("h")[6], 8).alias("h20")))


_KIND = "CASE l_linenumber % 3 WHEN 0 THEN 'spherical' WHEN 1 THEN 'cylindrical' ELSE 'pannini' END"
_PROJ = f"""k AS (SELECT *, {_KIND} AS kind FROM c),
u AS (SELECT *, CASE kind WHEN 'pannini' THEN 2*sin(th)/greatest(1 + cos(th), 0.2::DOUBLE) ELSE th END AS u,
  CASE kind WHEN 'spherical' THEN ph WHEN 'cylindrical' THEN tan(least(greatest(ph, -1.4::DOUBLE), 1.4::DOUBLE))
  ELSE 2*tan(least(greatest(ph, -1.4::DOUBLE), 1.4::DOUBLE))/greatest(1 + cos(th), 0.2::DOUBLE) END AS v FROM k)"""


def kind_column():
    return (F.when(F.col("l_linenumber") % 3 == 0, "spherical").when(F.col("l_linenumber") % 3 == 1, "cylindrical")
            .otherwise("pannini"))


@R.add("proj_forward", f"WITH {_CAM}, {_PROJ} SELECT l_orderkey, l_linenumber, kind, {sq('u')} AS u, {sq('v')} AS v FROM u")
def _(spark, sf):
    d = seen(spark, sf).withColumn("kind", kind_column())
    u, v = projective.proj_forward(F.col("kind"), F.col("th"), F.col("ph"))
    return d.select(*KEY, "kind", rd(u).alias("u"), rd(v).alias("v"))


@R.add("proj_inverse", f"WITH {_CAM}, k AS (SELECT *, {_KIND} AS kind FROM c) SELECT l_orderkey, l_linenumber, kind, "
                       f"{sq('th')} AS theta, {sq('ph')} AS phi FROM k")
def _(spark, sf):
    # SQL keeps the angles it started from: forward then inverse must give them back
    d = seen(spark, sf).withColumn("kind", kind_column())
    u, v = projective.proj_forward(F.col("kind"), F.col("th"), F.col("ph"))
    d = d.withColumns({"u": u, "v": v})
    t, p = projective.proj_inverse(F.col("kind"), F.col("u"), F.col("v"))
    return d.select(*KEY, "kind", rd(t).alias("theta"), rd(p).alias("phi"))


@R.add("pixel_ray_round_trip", f"WITH {_CAM}, k AS (SELECT *, {_KIND} AS kind FROM c) SELECT l_orderkey, l_linenumber, "
                               f"{sq('(l_orderkey % 900)::DOUBLE', 4)} AS px, {sq('(l_partkey % 400)::DOUBLE', 4)} AS py "
                               f"FROM lineitem")
def _(spark, sf):
    d = load(spark, sf, "lineitem").withColumn("kind", kind_column())
    frame = (F.col("kind"), F.lit(-0.9), F.lit(0.45), F.lit(500.0))
    ray = projective.pixel_to_ray(*frame, (F.col("l_orderkey") % 900).cast("double"), (F.col("l_partkey") % 400).cast("double"))
    d = d.withColumns({f"d{k}": c for k, c in enumerate(ray)})
    x, y = projective.ray_to_pixel(*frame, (F.col("d0"), F.col("d1"), F.col("d2")))
    return d.select(*KEY, rd(x, 4).alias("px"), rd(y, 4).alias("py"))


@R.add("frame_point", f"""SELECT l_orderkey, l_linenumber, {sq('l_tax + (l_partkey + 0.5::DOUBLE) / (1 + l_discount)', 4)} AS fx,
  {sq('l_discount + (l_suppkey + 0.5::DOUBLE) / (1 + l_discount)', 4)} AS fy,
  {sq('(l_extendedprice - l_tax) * (1 + l_discount) - 0.5::DOUBLE', 3)} AS ox FROM lineitem""")
def _(spark, sf):
    li = load(spark, sf, "lineitem")
    s = 1 + F.col("l_discount")
    fx, fy = plane.frame_point(F.col("l_tax"), F.col("l_discount"), s, F.col("l_partkey"), F.col("l_suppkey"))
    ox, _ = plane.output_point(F.col("l_tax"), F.col("l_discount"), s, F.col("l_extendedprice"), F.col("l_quantity"))
    return li.select(*KEY, rd(fx, 4).alias("fx"), rd(fy, 4).alias("fy"), rd(ox, 3).alias("ox"))


@R.add("tent_weight", f"""SELECT l_orderkey, l_linenumber,
  {sq('greatest((1 - abs(2*(l_quantity - 0.5::DOUBLE)/50 - 1)) * (1 - abs(2*l_extendedprice/110000 - 1)), 1e-5::DOUBLE)')} AS tent
  FROM lineitem""")
def _(spark, sf):
    t = plane.tent_weight(F.col("l_quantity") - 0.5, F.col("l_extendedprice"), F.lit(50), F.lit(110000), 1e-5)
    return load(spark, sf, "lineitem").select(*KEY, rd(t).alias("tent"))


@R.add("intensity", f"SELECT l_orderkey, l_linenumber, {sq('(l_discount + l_tax + l_quantity) / 3')} AS i FROM lineitem")
def _(spark, sf):
    i = plane.intensity(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"))
    return load(spark, sf, "lineitem").select(*KEY, rd(i).alias("i"))


@R.add("source_dimension", """SELECT c_custkey, ceil(greatest(c_custkey % 3000 + 1000, c_custkey % 2000 + 900) * 350.5::DOUBLE
  / (600 + abs(c_acctbal)) * 1.2::DOUBLE)::BIGINT AS dim_frame, ceil(greatest(c_custkey % 3000 + 1000, c_custkey % 2000 + 900)
  * 0.75::DOUBLE * (1 + abs(c_acctbal) / 10000) * 1.2::DOUBLE)::BIGINT AS dim_flat FROM customer""")
def _(spark, sf):
    w, h = F.col("c_custkey") % 3000 + 1000, F.col("c_custkey") % 2000 + 900
    bal = F.abs("c_acctbal")
    return load(spark, sf, "customer").select(
        "c_custkey", plane.source_dimension_frame(w, h, F.lit(350.5), 600 + bal).alias("dim_frame"),
        plane.source_dimension_flat(w, h, F.lit(0.75), 1 + bal / 10000).alias("dim_flat"))


_VEC = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e),
u AS (SELECT vec_id, CASE WHEN n > 1e-12 THEN [x / n FOR x IN v] ELSE v END AS u FROM n),
c AS (SELECT vec_id, u, [least(x, 0.2::DOUBLE) FOR x IN u] AS c FROM u),
w AS (SELECT vec_id, CASE WHEN list_max(u) > 0.2 THEN [x / sqrt(list_dot_product(c, c)) FOR x IN c] ELSE u END AS w FROM c)"""


@R.add("vec_unit_clip", f"WITH {_VEC} SELECT vec_id, {sq('list_dot_product(w, w)')} AS norm_sq, {sq('list_max(w)')} AS top, "
                        f"{sq('list_min(w)')} AS low, {sq('list_sum(w)')} AS total FROM w")
def _(spark, sf):
    d = load(spark, sf, "embeddings").select("vec_id", plane.vec_unit_clip(F.col("embedding")).alias("w"))
    return d.select("vec_id", rd(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x)).alias("norm_sq"),
                    rd(F.array_max("w")).alias("top"), rd(F.array_min("w")).alias("low"),
                    rd(F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).alias("total"))


# --- catalogue ------------------------------------------------------------------------------------

_META = """m AS (SELECT c_custkey, (1000 + c_custkey % 3000)::INT AS full_width, (800 + c_custkey % 2500)::INT AS full_height,
  CASE WHEN c_custkey % 5 <> 0 THEN 20 + abs(c_acctbal) / 500 END AS f35, abs(c_acctbal) / 100 AS lat,
  (c_custkey % 180)::DOUBLE AS lon, CASE c_mktsegment WHEN 'BUILDING' THEN 'S' WHEN 'MACHINERY' THEN NULL ELSE 'N' END AS lat_ref,
  CASE WHEN c_nationkey < 12 THEN 'W' WHEN c_nationkey < 20 THEN 'E' END AS lon_ref FROM customer)"""


def catalog(spark, sf):
    k, bal = F.col("c_custkey"), F.abs("c_acctbal")
    return load(spark, sf, "customer").select(
        "c_custkey", (1000 + k % 3000).cast("int").alias("full_width"), (800 + k % 2500).cast("int").alias("full_height"),
        F.when(k % 5 != 0, 20 + bal / 500).alias("f35"), (bal / 100).alias("lat"), (k % 180).cast("double").alias("lon"),
        F.when(F.col("c_mktsegment") == "BUILDING", "S").when(F.col("c_mktsegment") == "MACHINERY", None).otherwise("N").alias("lat_ref"),
        F.when(F.col("c_nationkey") < 12, "W").when(F.col("c_nationkey") < 20, "E").alias("lon_ref"))


@R.add("normalize_catalog", f"""WITH {_META}, s AS (SELECT *, least(1::DOUBLE, 2000::DOUBLE / greatest(full_width, full_height)) AS q FROM m),
  z AS (SELECT *, greatest(1, floor(full_width*q + 0.5::DOUBLE))::INT AS width, greatest(1, floor(full_height*q + 0.5::DOUBLE))::INT AS height FROM s)
  SELECT c_custkey, width, height, CASE WHEN coalesce(lat_ref, 'N') = 'S' THEN -lat ELSE lat END AS lat,
  CASE WHEN coalesce(lon_ref, 'E') = 'W' THEN -lon ELSE lon END AS lon,
  {sq("coalesce(f35 / 36 * greatest(width, height), 0.9::DOUBLE * greatest(width, height))", 4)} AS focal FROM z""")
def _(spark, sf):
    d = normalize_catalog(catalog(spark, sf), 2000)
    return d.select("c_custkey", "width", "height", (F.col("lat") + 0.0).alias("lat"), "lon", rd("focal", 4).alias("focal"))


@R.add("exclude_own", """SELECT doc_id, n_chars FROM documents WHERE source <> (SELECT min(source) FROM documents)
  AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def _(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "n_chars", F.col("source").alias("producer"),
                                               F.concat(F.lit("docs/"), F.col("doc_id")).alias("path"))
    own = docs.agg(F.min("producer")).first()[0]
    written = load(spark, sf, "labels").filter("quality = 0").select(F.concat(F.lit("docs/"), F.col("doc_id")).alias("path"))
    return exclude_own(docs, own, written).select("doc_id", "n_chars")


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@R.add("scan_files", " UNION ALL ".join(f"SELECT '{t}.parquet' AS name, count(*) AS n_rows FROM {t}" for t in _TABLES))
def _(spark, sf):
    """The tables that lie in the folder, and the rows that each of the files found holds."""
    found = scan_files(spark, [f"{sf}/{t}.parquet" for t in _TABLES], ["PARQUET"]).select("name", "path").distinct()
    rows = None
    for t in _TABLES:
        one = load(spark, sf, t).select(F.col("_metadata.file_path").alias("file"), F.lit(f"{t}.parquet").alias("table"))
        rows = one if rows is None else rows.unionByName(one)
    held = rows.groupBy("file", "table").agg(F.count(F.lit(1)).alias("n"))
    bare = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "/")
    return (found.withColumn("file", bare).join(held.withColumn("file", F.regexp_replace(F.col("file"), "^[a-z0-9]+:/*", "/")), "file")
            .groupBy(F.col("table").alias("name")).agg(F.sum("n").alias("n_rows")))


@R.add("write_groups", """WITH g AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) AS k FROM (SELECT DISTINCT o_orderstatus FROM orders))
  SELECT CASE WHEN k = 1 THEN 'orders' ELSE 'orders.' || k END AS output_name, 'tessera' AS producer, count(*) AS n
  FROM orders JOIN g USING (o_orderstatus) GROUP BY ALL""")
def _(spark, sf):
    base = f"{checkpoint_dir(spark).rstrip('/')}/orders-by-status-{uuid.uuid4().hex}"
    write_groups(load(spark, sf, "orders"), base, "orders.parquet", key="o_orderstatus")
    return spark.read.parquet(base).groupBy("output_name", "producer").agg(F.count(F.lit(1)).alias("n"))


_FEAT = """f AS (SELECT label::BIGINT AS source_id, vec_id, abs(embedding[1]::DOUBLE) AS scale, embedding[2]::DOUBLE AS response FROM embeddings)"""


def plain_features(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select(F.lit(1).cast("bigint").alias("set_id"), F.col("label").cast("bigint").alias("source_id"),
                    F.col("vec_id").alias("feature_id"), F.abs(F.col("embedding")[0].cast("double")).alias("scale"),
                    F.col("embedding")[1].cast("double").alias("response"))


@R.add("feature_summary", f"WITH {_FEAT} SELECT source_id, count(*) AS n_features, min(scale) AS min_scale, max(scale) AS max_scale FROM f GROUP BY 1")
def _(spark, sf):
    return feature_summary(plain_features(spark, sf)).drop("set_id")


@R.add("top_k_response", f"""WITH {_FEAT} SELECT source_id, vec_id AS feature_id, response FROM f
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY abs(response) DESC, vec_id) <= 20""")
def _(spark, sf):
    return top_k_response(plain_features(spark, sf), 20).select("source_id", "feature_id", "response")


@R.add("natural_width", """WITH o AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) / 500000 AS span,
  avg(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 60 END) AS px FROM orders GROUP BY 1)
  SELECT o_custkey, CASE WHEN floor(span * px) IS NULL THEN 4000 ELSE least(greatest(1000, floor(span * px)), 5000) END::INT AS width,
  greatest(700, least(2500, floor(sqrt(700 * 700 * 9 / 16 * (n::DOUBLE / 2)))))::INT AS working,
  CASE WHEN o_custkey % 7 = 0 THEN 'cylindrical' WHEN span * 5 < radians(160) THEN 'pannini' ELSE 'spherical' END AS projection FROM o""")
def _(spark, sf):
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("o_totalprice") / 500000).alias("span"),
        F.avg(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") / 60)).alias("px"))
    choice = F.when(F.col("o_custkey") % 7 == 0, "cylindrical")
    return o.select("o_custkey", natural_width(F.col("span"), F.col("px"), 5000).alias("width"),
                    working_width(F.col("n") / 2).alias("working"),
                    auto_projection(F.col("span") * 5, choice).alias("projection"))


# customers as the sources of their nations, the account balance standing for what varies between them
_RIG = """c AS (SELECT c_nationkey::BIGINT AS set_id, c_custkey AS source_id, 1000 + 100 * (c_custkey % 7) AS width, 3000 + 50 * (c_custkey % 20) AS full_width,
  700 + abs(c_acctbal) / 100 AS focal, 0.8 + 0.01 * (c_custkey % 40) AS sc FROM customer)"""


def _rig(spark, sf):
    k = F.col("c_custkey")
    return load(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("set_id"), k.alias("source_id"), (1000 + 100 * (k % 7)).alias("width"),
                                              (3000 + 50 * (k % 20)).alias("full_width"), (700 + F.abs("c_acctbal") / 100).alias("focal"),
                                              S.sim_from_polar(0.8 + 0.01 * (k % 40), F.lit(0.3), F.lit(0.0), F.lit(0.0)).alias("t"))


@R.add("camera_widths", f"""WITH {_RIG} SELECT set_id, least(greatest(1000, floor((1 + set_id % 9) * 0.5::DOUBLE * avg(focal * full_width / width))), 12000)::INT AS width FROM c GROUP BY set_id""")
def _(spark, sf):
    rig = _rig(spark, sf)
    frame = rig.select("set_id").distinct().withColumn("extent_x", (1 + F.col("set_id") % 9) * 0.5)
    return camera_widths(rig, rig, frame)


@R.add("strip_widths", f"""WITH {_RIG} SELECT set_id, least(greatest(1000, floor(200 * (1 + set_id) * avg(full_width::DOUBLE / width / sc))), 20000)::INT AS width FROM c GROUP BY set_id""")
def _(spark, sf):
    rig = _rig(spark, sf)
    frame = rig.select("set_id").distinct().withColumn("extent_x", 200.0 * (1 + F.col("set_id")))
    return strip_widths(rig, rig, frame)


QUERIES, ORACLE = R.queries, R.oracle
