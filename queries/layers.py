"""Overlap, calibration, ownership, blending and coverage.

Suppliers overlap in the parts they ship; seven line-number layers overlap on a part x supplier grid.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import Registry, load, rd, sq
from queries.grid import sample_sql
from tessera.functions.similarity import sim, sim_from_polar
from tessera.operators import blending, coverage, overlap, ownership, placement, regrid as G
from tessera.operators.grids import crop_cells, gaussian_taps
from tessera.plans.composite import composite
from tessera.session import cut

R = Registry()

# --- suppliers sharing parts ------------------------------------------------------------------------

_SHIP = """sh AS (SELECT l_suppkey AS s, l_partkey AS p, avg(l_extendedprice) / 105000 AS v FROM lineitem GROUP BY 1, 2),
ov AS (SELECT x.s AS a, y.s AS b, count(*) AS n, sum(x.v) / count(*) AS ia, sum(y.v) / count(*) AS ib FROM sh x JOIN sh y ON x.p = y.p AND x.s < y.s
  GROUP BY 1, 2 HAVING count(*) > 25)"""


def shipments(spark, sf):
    return load(spark, sf, "lineitem").groupBy(
        F.lit(1).cast("bigint").alias("set_id"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("cell")).agg(
        (F.avg("l_extendedprice") / 105000).alias("v"))


@R.add("overlap_stats", f"WITH {_SHIP} SELECT a, b, n, {sq('ia')} AS mean_a, {sq('ib')} AS mean_b FROM ov")
def _(spark, sf):
    return overlap.overlap_stats(shipments(spark, sf), ["cell"]).select(
        "a", "b", "n", rd("mean_a").alias("mean_a"), rd("mean_b").alias("mean_b"))


@R.add("shared_cells", f"WITH {_SHIP} SELECT x.s AS a, y.s AS b, x.p AS cell, {sq('x.v')} AS va, {sq('y.v')} AS vb FROM sh x JOIN sh y ON x.p = y.p AND y.s = x.s + 1")
def _(spark, sf):
    c = shipments(spark, sf)
    pairs = c.select("set_id", F.col("source_id").alias("a")).distinct().withColumn("b", F.col("a") + 1)
    return overlap.shared_cells(c, pairs, ["cell"]).select("a", "b", "cell", rd("va").alias("va"), rd("vb").alias("vb"))


# solves cells (i, j, val) x = rh (i, rhs) over the unknowns ids (i, k)
_CG = """full_m AS (SELECT x.k AS r, y.k AS c, coalesce(val, 0) AS val FROM ids x JOIN ids y ON true LEFT JOIN cells ON cells.i = x.i AND cells.j = y.i),
mat AS (SELECT list(line ORDER BY r) AS m FROM (SELECT r, list(val ORDER BY c) AS line FROM full_m GROUP BY r)),
vec AS (SELECT list(rhs ORDER BY k) AS b, list(1.0::DOUBLE ORDER BY k) AS one, count(*) AS n FROM rh JOIN ids USING (i)),
cg AS (
  SELECT 0 AS it, one AS x, [b[i] - list_dot_product(m[i], one) FOR i IN range(1, n + 1)] AS r, [b[i] - list_dot_product(m[i], one) FOR i IN range(1, n + 1)] AS p, n FROM vec, mat
  UNION ALL
  SELECT it + 1, [x[i] + al*p[i] FOR i IN range(1, n + 1)], r2, [r2[i] + list_dot_product(r2, r2) / rr * p[i] FOR i IN range(1, n + 1)], n FROM (
    SELECT *, [r[i] - al*q[i] FOR i IN range(1, n + 1)] AS r2 FROM (
      SELECT *, rr / list_dot_product(p, q) AS al FROM (
        SELECT it, x, r, p, n, list_dot_product(r, r) AS rr, [list_dot_product(line, p) FOR line IN m] AS q FROM cg, mat WHERE it < 400) WHERE rr > 1e-12)))"""
_SN, _SG = "(255.0::DOUBLE / 10) * (255.0::DOUBLE / 10)", "100.0::DOUBLE"
_GAINS = f"""{_SHIP},
one AS (SELECT a AS i, b AS j, n, ia, ib FROM ov UNION ALL SELECT b, a, n, ib, ia FROM ov),
ids AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM (SELECT DISTINCT i FROM one)),
dg AS (SELECT i, i AS j, sum(n * (ia*ia*{_SN} + {_SG})) AS val, sum(n * {_SG}) AS rhs FROM one GROUP BY 1),
rh AS (SELECT i, rhs FROM dg),
cells AS (SELECT i, j, val FROM dg UNION ALL SELECT i, j, -n*ia*ib*{_SN} FROM one),
{_CG},
sol AS (SELECT x FROM cg ORDER BY it DESC LIMIT 1),
gains AS (SELECT i AS source_id, least(greatest(x[k], 0.5), 2) AS gain FROM ids, sol),
allg AS (SELECT s AS source_id, coalesce(gain, 1) AS gain FROM (SELECT DISTINCT s FROM sh) LEFT JOIN gains ON s = source_id)"""


@R.add("calibrate_sources", f"WITH RECURSIVE {_GAINS} SELECT source_id, {sq('gain', 5)} AS gain FROM allg")
def _(spark, sf):
    g = overlap.calibrate_sources(shipments(spark, sf), ["cell"])
    return g.select("source_id", rd("gain", 5).alias("gain"))


@R.add("calibration_summary", f"""WITH RECURSIVE {_GAINS} SELECT source_id, s_name || ' ' || printf('%.2f', gain) AS text FROM allg JOIN supplier ON s_suppkey = source_id""")
def _(spark, sf):
    names = load(spark, sf, "supplier").select(F.lit(1).cast("bigint").alias("set_id"), F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"))
    return overlap.calibration_summary(overlap.calibrate_sources(shipments(spark, sf), ["cell"]), names).select("source_id", "text")


# --- seven layers on a part x supplier grid ------------------------------------------------------------

_LAY = """ly AS (SELECT l_linenumber::BIGINT AS s, (l_partkey // 50)::INT AS x, (l_suppkey // 5)::INT AS y, avg(l_extendedprice) / 105000 AS v, avg(l_quantity) / 50 AS tent,
  avg(l_discount) AS dsc FROM lineitem GROUP BY 1, 2, 3)"""


def layers(spark, sf):
    return load(spark, sf, "lineitem").groupBy(
        F.lit(1).cast("bigint").alias("set_id"), F.col("l_linenumber").cast("bigint").alias("source_id"),
        F.floor(F.col("l_partkey") / 50).cast("int").alias("x"), F.floor(F.col("l_suppkey") / 5).cast("int").alias("y")).agg(
        (F.avg("l_extendedprice") / 105000).alias("v"), (F.avg("l_quantity") / 50).alias("tent"), F.avg("l_discount").alias("dsc"))


@R.add("weighted_blend", f"WITH {_LAY} SELECT x, y, {sq('sum(v*tent)/sum(tent)')} AS v, {sq('sum(dsc*tent)/sum(tent)')} AS dsc FROM ly GROUP BY 1, 2")
def _(spark, sf):
    return blending.weighted_blend(layers(spark, sf), ["v", "dsc"]).select("x", "y", rd("v").alias("v"), rd("dsc").alias("dsc"))


_OWN = f"{_LAY}, own AS (SELECT x, y, s FROM ly QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY tent DESC, s) = 1)"


@R.add("own_by_locality", f"WITH {_OWN} SELECT x, y, s AS source_id FROM own")
def _(spark, sf):
    return ownership.own_by_locality(layers(spark, sf)).select("x", "y", "source_id")


@R.add("owner_mask", f"WITH {_OWN} SELECT ly.s AS source_id, x, y, CASE WHEN own.s = ly.s THEN 1::DOUBLE ELSE 0 END AS mask FROM ly JOIN own USING (x, y)")
def _(spark, sf):
    d = layers(spark, sf)
    return ownership.owner_mask(d, ownership.own_by_locality(d)).select("source_id", "x", "y", "mask")


@R.add("upsample_owner", f"""WITH {_OWN}, sz AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM ly), f AS (SELECT DISTINCT (l_partkey // 25)::INT AS x, (l_suppkey // 2)::INT AS y FROM lineitem)
  SELECT f.x, f.y, own.s AS owner FROM f JOIN sz ON true LEFT JOIN own ON own.x = least(w - 1, greatest(0, floor((f.x + 0.5)*0.5::DOUBLE))) AND own.y = least(h - 1, greatest(0, floor((f.y + 0.5)*0.5::DOUBLE)))""")
def _(spark, sf):
    d = layers(spark, sf)
    size = d.groupBy("set_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    full = load(spark, sf, "lineitem").select(F.lit(1).cast("bigint").alias("set_id"), F.floor(F.col("l_partkey") / 25).cast("int").alias("x"),
                                              F.floor(F.col("l_suppkey") / 2).cast("int").alias("y")).distinct().join(size, "set_id")
    return ownership.upsample_owner(ownership.own_by_locality(d), full, (F.col("w"), F.col("h")), F.lit(0.5)).select("x", "y", "owner")


@R.add("own_consistent", f"""WITH RECURSIVE {_LAY}, pc AS (SELECT x, y, count(*) AS n, max(v) - min(v) AS gap, min(s) AS lone, arg_max(s, (tent, -s)) AS near FROM ly GROUP BY 1, 2),
  sp AS (SELECT x, y, x * 100000 + y AS id FROM pc WHERE n > 1 AND gap > 0.6),
  e AS (SELECT p.id AS u, q.id AS v FROM sp p JOIN sp q ON abs(p.x - q.x) + abs(p.y - q.y) = 1),
  rc AS (SELECT id AS node, id AS seen FROM sp UNION SELECT e.v, rc.seen FROM rc JOIN e ON e.u = rc.node),
  bl AS (SELECT x, y, b FROM sp JOIN (SELECT node, min(seen) AS b FROM rc GROUP BY 1) ON node = id),
  tc AS (SELECT b, min(lone) AS pull FROM bl JOIN pc ON abs(bl.x - pc.x) + abs(bl.y - pc.y) = 1 WHERE pc.n = 1 GROUP BY 1 HAVING min(lone) = max(lone)),
  vt AS (SELECT b, s, count(*) AS cover, sum(tent) AS t FROM ly JOIN bl USING (x, y) GROUP BY 1, 2),
  ch AS (SELECT b, s AS owner FROM vt LEFT JOIN tc USING (b) QUALIFY row_number() OVER (PARTITION BY b ORDER BY cover DESC, coalesce(s = pull, false) DESC, t DESC, s) = 1),
  dc AS (SELECT bl.x, bl.y, owner FROM bl JOIN ch USING (b) JOIN ly ON ly.x = bl.x AND ly.y = bl.y AND ly.s = owner)
  SELECT x, y, coalesce(owner, near) AS source_id FROM pc LEFT JOIN dc USING (x, y)""")
def _(spark, sf):
    return ownership.own_consistent(layers(spark, sf), 0.6).select("x", "y", "source_id")


@R.add("apply_gain", f"WITH {_LAY} SELECT s AS source_id, x, y, {sq('v * (0.7::DOUBLE + 0.1::DOUBLE * s)')} AS v FROM ly")
def _(spark, sf):
    d = layers(spark, sf)
    gains = d.select("set_id", "source_id").distinct().select(
        "set_id", "source_id", F.lit(0).alias("br"), F.lit(0).alias("bc"), F.lit(1).alias("n_rows"), F.lit(1).alias("n_cols"),
        (0.7 + 0.1 * F.col("source_id")).alias("gain"))
    return overlap.apply_gain(d, gains, ["v"]).select("source_id", "x", "y", rd("v").alias("v"))


def _tap(r, c):
    return f"(1 + 0.01::DOUBLE * s + 0.1::DOUBLE * ({r}) - 0.05::DOUBLE * ({c}))"


@R.add("gain_at", f"""WITH {_LAY}, bx AS (SELECT s, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM ly GROUP BY 1),
  f AS (SELECT ly.*, least(greatest((x - x0 + 0.5)::DOUBLE / w * 4 - 0.5, 0), 3) AS fx, least(greatest((y - y0 + 0.5)::DOUBLE / h * 3 - 0.5, 0), 2) AS fy FROM ly JOIN bx USING (s)),
  g AS (SELECT *, least(floor(fx), 2) AS c0, least(floor(fy), 1) AS r0 FROM f), q AS (SELECT *, fx - c0 AS wx, fy - r0 AS wy FROM g)
  SELECT s AS source_id, x, y, {sq(f"v * (({_tap('r0', 'c0')}*(1-wx) + {_tap('r0', 'c0+1')}*wx)*(1-wy) + ({_tap('r0+1', 'c0')}*(1-wx) + {_tap('r0+1', 'c0+1')}*wx)*wy)")} AS v FROM q""")
def _(spark, sf):
    d = layers(spark, sf)
    gains = (d.select("set_id", "source_id").distinct().withColumn("br", F.explode(F.sequence(F.lit(0), F.lit(2))))
             .withColumn("bc", F.explode(F.sequence(F.lit(0), F.lit(3))))
             .select("*", F.lit(3).alias("n_rows"), F.lit(4).alias("n_cols"),
                     (1 + 0.01 * F.col("source_id") + 0.1 * F.col("br") - 0.05 * F.col("bc")).alias("gain")))
    return overlap.apply_gain(d, gains, ["v"], overlap.layer_boxes(d)).select("source_id", "x", "y", rd("v").alias("v"))


_BLOCKS = f"""{_LAY}, bx AS (SELECT s, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM ly GROUP BY 1),
bg AS (SELECT *, ceil(w / greatest(4, ceil(greatest(w, h) / 4)))::INT AS nc, ceil(h / greatest(4, ceil(greatest(w, h) / 4)))::INT AS nr FROM bx),
tg AS (SELECT s, x, y, v, s * 1000 + least(nr - 1, floor((y - y0) / (h / nr))) * nc + least(nc - 1, floor((x - x0) / (w / nc))) AS e FROM ly JOIN bg USING (s)),
ov AS (SELECT p.e AS a, q.e AS b, count(*) AS n, avg(p.v) AS ia, avg(q.v) AS ib FROM tg p JOIN tg q ON p.x = q.x AND p.y = q.y AND p.s < q.s GROUP BY 1, 2 HAVING count(*) > 25),
one AS (SELECT a AS i, b AS j, n, ia, ib FROM ov UNION ALL SELECT b, a, n, ib, ia FROM ov),
sl AS (SELECT s, r.r, c.c, nr, nc, s * 1000 + r.r * nc + c.c AS i, (w / nc) * (h / nr) * {_SG} AS lam FROM bg, range(50) r(r), range(50) c(c) WHERE r.r < nr AND c.c < nc),
nb AS (SELECT i, i + 1 AS j, lam FROM sl WHERE c + 1 < nc UNION ALL SELECT i, i + nc, lam FROM sl WHERE r + 1 < nr),
parts AS (SELECT i, i AS j, n * (ia*ia*{_SN} + {_SG}) AS val FROM one UNION ALL SELECT i, j, -n*ia*ib*{_SN} FROM one UNION ALL SELECT i, i, 1 FROM sl
  UNION ALL SELECT i, i, lam FROM nb UNION ALL SELECT j, j, lam FROM nb UNION ALL SELECT i, j, -lam FROM nb UNION ALL SELECT j, i, -lam FROM nb),
cells AS (SELECT i, j, sum(val) AS val FROM parts GROUP BY 1, 2),
rh AS (SELECT i, sum(rhs) AS rhs FROM (SELECT i, n * {_SG} AS rhs FROM one UNION ALL SELECT i, 1 FROM sl) GROUP BY 1),
ids AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM sl),
{_CG}, sol AS (SELECT x FROM cg ORDER BY it DESC LIMIT 1)"""


@R.add("calibrate_blocks", f"""WITH RECURSIVE {_BLOCKS} SELECT s AS source_id, r::INT AS br, c::INT AS bc, nr AS n_rows, nc AS n_cols,
  {sq('least(greatest(x[k], 0.5), 2)', 4)} AS gain FROM sl JOIN ids USING (i), sol""")
def _(spark, sf):
    g = overlap.calibrate_blocks(layers(spark, sf), "v", blocks_across=4, min_block=4)
    return g.select("source_id", "br", "bc", "n_rows", "n_cols", rd("gain", 4).alias("gain"))


@R.add("calibration_summary_blocks", f"""WITH RECURSIVE {_BLOCKS}, g AS (SELECT s, least(greatest(x[k], 0.5), 2) AS gain FROM sl JOIN ids USING (i), sol)
  SELECT s AS source_id, count(*) AS blocks, 'layer ' || s || ' ' || CASE WHEN count(*) = 1 THEN printf('%.2f', avg(gain)) ELSE printf('%.2f [%.2f, %.2f]', avg(gain), min(gain), max(gain)) END AS text FROM g GROUP BY s""")
def _(spark, sf):
    d = layers(spark, sf)
    names = d.select("set_id", "source_id").distinct().withColumn("name", F.concat(F.lit("layer "), F.col("source_id")))
    g = overlap.calibrate_blocks(d, "v", blocks_across=4, min_block=4)
    return overlap.calibration_summary(g, names).select("source_id", "blocks", "text")


@R.add("coverage", f"WITH {_LAY} SELECT DISTINCT x, y FROM ly WHERE tent > 0.5")
def _(spark, sf):
    return coverage.coverage(layers(spark, sf), weight="tent", eps=0.5).select("x", "y")


@R.add("crop_cells", f"WITH {_LAY} SELECT s AS source_id, x - 2 AS x, y - 1 AS y, {sq('v')} AS v FROM ly WHERE x >= 2 AND x < 22 AND y >= 1 AND y < 11")
def _(spark, sf):
    return crop_cells(layers(spark, sf), 2, 1, 20, 10).select("source_id", "x", "y", rd("v").alias("v"))


# users run down and days across, so a row stays short however many users there are
_DAYS = "cv AS (SELECT DISTINCT event_type AS k, (day(ts) - 1)::INT AS x, user_id::INT AS y FROM events)"
_RECT = f"""{_DAYS}, rn AS (SELECT *, y - row_number() OVER (PARTITION BY k, x ORDER BY y) AS run FROM cv),
  ht AS (SELECT *, row_number() OVER (PARTITION BY k, x, run ORDER BY y) AS h FROM rn),
  isl AS (SELECT *, x - row_number() OVER (PARTITION BY k, y ORDER BY x) AS isle FROM ht),
  sp AS (SELECT l.k, l.y, l.x AS x0, r.x AS x1, min(m.h) AS tall FROM isl l JOIN isl r ON l.k = r.k AND l.y = r.y AND l.isle = r.isle AND l.x <= r.x
    JOIN isl m ON m.k = l.k AND m.y = l.y AND m.isle = l.isle AND m.x BETWEEN l.x AND r.x GROUP BY 1, 2, 3, 4),
  rc AS (SELECT k, x0 AS x, y - tall + 1 AS y, x1 - x0 + 1 AS w, tall AS h, tall * (x1 - x0 + 1) AS area FROM sp
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY tall * (x1 - x0 + 1) DESC, sp.y, x1, tall DESC) = 1)"""


def user_days(spark, sf):
    e = load(spark, sf, "events")
    return e.select(F.col("event_type").alias("k"), (F.dayofmonth("ts") - 1).cast("int").alias("x"), F.col("user_id").cast("int").alias("y")).distinct()


def user_count(spark, sf):
    return int(load(spark, sf, "events").agg(F.max("user_id")).first()[0]) + 1


@R.add("largest_full_rect", f"WITH {_RECT} SELECT k AS event_type, x, y::INT AS y, w, h::INT AS h, area::BIGINT AS area FROM rc")
def _(spark, sf):
    r = coverage.largest_full_rect(user_days(spark, sf), 30, user_count(spark, sf), "k")
    return r.withColumnRenamed("k", "event_type")


@R.add("auto_crop", f"""WITH {_RECT.replace('event_type AS k, (day(ts) - 1)::INT AS x, user_id::INT AS y', "1 AS k, (user_id % 6)::INT AS x, (day(ts) - 1)::INT AS y")},
  ev AS (SELECT (user_id % 6)::INT AS x, (day(ts) - 1)::INT AS y, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT *, w > 6 // 4 AND h > 30 // 4 AS big FROM rc)
  SELECT ev.x - CASE WHEN big THEN b.x ELSE 0 END AS x, (ev.y - CASE WHEN big THEN b.y ELSE 0 END)::INT AS y, n FROM ev, b
  WHERE NOT big OR (ev.x >= b.x AND ev.x < b.x + w AND ev.y >= b.y AND ev.y < b.y + h)""")
def _(spark, sf):
    c = load(spark, sf, "events").groupBy(F.lit(1).alias("k"), (F.col("user_id") % 6).cast("int").alias("x"),
                                          (F.dayofmonth("ts") - 1).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return coverage.auto_crop(c, c.select("k", "y", "x"), 6, 30, "k").select("x", "y", "n")


def bands_sql(levels: int, size: str = "SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM ly") -> str:
    """CTEs that blend the layers ``ly`` owned by ``own`` in ``levels`` bands on a frame of ``size``; table ``bl`` holds x, y, v."""
    align, eps = 1 << (levels - 1), "1e-5::DOUBLE"
    taps = gaussian_taps(blending.BAND_SIGMA)
    rows = ", ".join(f"({k - len(taps) // 2}, {t!r}::DOUBLE)" for k, t in enumerate(taps))
    parts = [f"""t(d, w) AS (VALUES {rows}),
dm AS (SELECT s AS k, min(x) // {align} * {align} AS gx, min(y) // {align} * {align} AS gy, max(x) AS x1, max(y) AS y1 FROM ly GROUP BY 1),
dl AS (SELECT k, gx, gy, (x1 - gx + {align}) // {align} * {align} AS lw, (y1 - gy + {align}) // {align} * {align} AS lh FROM dm),
fz AS (SELECT w, h, (w + {align - 1}) // {align} * {align} AS fw, (h + {align - 1}) // {align} * {align} AS fh FROM ({size})),
c0 AS (SELECT k, yy.y, xx.x, coalesce(ly.v, 0) AS c, CASE WHEN ly.v IS NULL THEN 0 ELSE 1 END::DOUBLE AS a, CASE WHEN own.s = k THEN 1 ELSE 0 END::DOUBLE AS m
  FROM dl, (SELECT unnest(range((SELECT max(lh) FROM dl))) AS y) yy, (SELECT unnest(range((SELECT max(lw) FROM dl))) AS x) xx
  LEFT JOIN ly ON ly.s = k AND ly.x = xx.x + gx AND ly.y = yy.y + gy LEFT JOIN own ON own.x = ly.x AND own.y = ly.y WHERE yy.y < lh AND xx.x < lw)"""]
    for n in range(levels):
        if n < levels - 1:
            parts.append(f"""bx{n} AS (SELECT o.k, o.y, o.x, sum(w * s.c) AS c, sum(w * s.a) AS a, sum(w * s.m) AS m FROM c{n} o JOIN dl ON dl.k = o.k JOIN t ON true
  JOIN c{n} s ON s.k = o.k AND s.y = o.y AND s.x = least(greatest(o.x + d, 0), (lw >> {n}) - 1) GROUP BY 1, 2, 3),
by{n} AS (SELECT o.k, o.y, o.x, sum(w * s.c) AS c, sum(w * s.a) AS a, sum(w * s.m) AS m FROM bx{n} o JOIN dl ON dl.k = o.k JOIN t ON true
  JOIN bx{n} s ON s.k = o.k AND s.x = o.x AND s.y = least(greatest(o.y + d, 0), (lh >> {n}) - 1) GROUP BY 1, 2, 3),
c{n + 1} AS (SELECT k, y // 2 AS y, x // 2 AS x, sum(c) / 4 AS c, sum(a) / 4 AS a, sum(m) / 4 AS m FROM by{n} GROUP BY 1, 2, 3),
lo{n} AS (SELECT k, y, x, CASE WHEN a > {eps} THEN c / a ELSE 0 END AS v FROM c{n + 1}),
p{n} AS (SELECT c.k, c.y, c.x, (c.x + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS sx, (c.y + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS sy, lw >> {n + 1} AS ww, lh >> {n + 1} AS hh FROM c{n} c JOIN dl ON dl.k = c.k),
{sample_sql(f"lo{n}", f"p{n}", "ww", "hh")}""")
            finer = f"CASE WHEN a > {eps} THEN c / a ELSE 0 END - u.v"
            more = f"JOIN p{n}_v u ON u.k = c.k AND u.y = c.y AND u.x = c.x"
        else:
            finer, more = f"CASE WHEN a > {eps} THEN c / a ELSE 0 END", ""
        parts.append(f"""bd{n} AS (SELECT (gy >> {n}) + c.y AS y, (gx >> {n}) + c.x AS x, sum(m) AS w, sum(({finer}) * m) AS v FROM c{n} c JOIN dl ON dl.k = c.k {more}, fz
  WHERE a > {eps} AND m > 0 AND (gx >> {n}) + c.x < fw >> {n} AND (gy >> {n}) + c.y < fh >> {n} GROUP BY 1, 2),
gr{n} AS (SELECT 0 AS k, yy.y, xx.x, CASE WHEN w > {eps} THEN v / w ELSE 0 END AS v FROM (SELECT unnest(range((SELECT fh >> {n} FROM fz))) AS y) yy,
  (SELECT unnest(range((SELECT fw >> {n} FROM fz))) AS x) xx LEFT JOIN bd{n} b ON b.y = yy.y AND b.x = xx.x)""")
    parts.append(f"up{levels - 1} AS (SELECT k, y, x, v FROM gr{levels - 1})")
    for n in range(levels - 2, -1, -1):
        parts.append(f"""q{n} AS (SELECT k, y, x, v AS own_v, (x + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS sx, (y + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS sy, fw >> {n + 1} AS ww, fh >> {n + 1} AS hh FROM gr{n}, fz),
{sample_sql(f"up{n + 1}", f"q{n}", "ww", "hh")},
up{n} AS (SELECT k, y, x, own_v + v AS v FROM q{n}_v)""")
    parts.append(f"bl AS (SELECT u.x, u.y, least(greatest(u.v, 0), 1) AS v FROM up0 u JOIN bd0 b ON b.x = u.x AND b.y = u.y, fz WHERE b.w > {eps} AND u.x < fz.w AND u.y < fz.h)")
    return ",\n".join(parts)


@R.add("multiband_blend", f"WITH {_OWN}, {bands_sql(5)} SELECT x::INT AS x, y::INT AS y, {sq('v')} AS v FROM bl")
def _(spark, sf):
    # written, as it is read several times
    d = cut(layers(spark, sf))
    size = d.agg(F.max("x"), F.max("y")).first()
    out = blending.multiband_blend(d, ownership.own_by_locality(d), size[0] + 1, size[1] + 1, 5, ["v"])
    return out.select("x", "y", rd("v").alias("v"))


# --- event grids (hour x day) placed in one frame ------------------------------------------------------

_PLACE = """ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS s FROM (SELECT DISTINCT event_type FROM events)),
ce AS (SELECT s, x, y, coalesce(v, 0) AS v FROM ty JOIN (SELECT x.x, y.y FROM range(24) x(x), range(30) y(y)) ON true
  LEFT JOIN (SELECT event_type, hour(ts) AS x, day(ts) - 1 AS y, sum(value) AS v FROM events GROUP BY 1, 2, 3) USING (event_type, x, y)),
pl AS (SELECT s, cos(0.05::DOUBLE * s) AS a, sin(0.05::DOUBLE * s) AS b, 10.25::DOUBLE * s AS tx, 3.5::DOUBLE * s AS ty FROM ty),
cr AS (SELECT s, a*cx - b*cy + tx AS x, b*cx + a*cy + ty AS y FROM (SELECT *, unnest([0, 24, 0, 24]) AS cx, unnest([0, 0, 30, 30]) AS cy FROM pl)),
fr AS (SELECT min(x) AS ox, min(y) AS oy, max(x) - min(x) AS ex, max(y) - min(y) AS ey, 100 / (max(x) - min(x)) AS sc FROM cr),
fs AS (SELECT *, greatest(1, floor(ey*sc)) AS oh FROM fr),
bb AS (SELECT s, trunc(min((x - ox)*sc - 0.5) - 2) AS xl, trunc(max((x - ox)*sc - 0.5) + 2) AS xh, trunc(min((y - oy)*sc - 0.5) - 2) AS yl, trunc(max((y - oy)*sc - 0.5) + 2) AS yh
  FROM cr, fs GROUP BY s),
oc AS (SELECT pl.*, px.x, py.y, ox + (px.x + 0.5)/sc AS fx, oy + (py.y + 0.5)/sc AS fy FROM pl JOIN bb USING (s), fs, range(100) px(x), range(500) py(y)
  WHERE px.x BETWEEN greatest(0, xl) AND least(99, xh) AND py.y BETWEEN greatest(0, yl) AND least(oh - 1, yh)),
iv AS (SELECT s, x, y, (a*(fx - tx) + b*(fy - ty)) / (a*a + b*b) AS sx, (a*(fy - ty) - b*(fx - tx)) / (a*a + b*b) AS sy FROM oc),
ins AS (SELECT *, floor(sx)::BIGINT AS x0, floor(sy)::BIGINT AS y0, sx - floor(sx) AS wx, sy - floor(sy) AS wy FROM iv WHERE sx >= 0 AND sx < 23 AND sy >= 0 AND sy < 29),
smp AS (SELECT ins.s, ins.x, ins.y, ins.sx, ins.sy, (t00.v*(1-wx) + t01.v*wx)*(1-wy) + (t10.v*(1-wx) + t11.v*wx)*wy AS v FROM ins
  JOIN ce t00 ON t00.s = ins.s AND t00.x = x0 AND t00.y = y0 JOIN ce t01 ON t01.s = ins.s AND t01.x = x0 + 1 AND t01.y = y0
  JOIN ce t10 ON t10.s = ins.s AND t10.x = x0 AND t10.y = y0 + 1 JOIN ce t11 ON t11.s = ins.s AND t11.x = x0 + 1 AND t11.y = y0 + 1)"""


def event_sources(spark, sf):
    """Event types numbered by name, with their dense hour x day grids and planted placements."""
    e = load(spark, sf, "events")
    # one row per event type: a handful of names, ranked by counting the smaller ones
    types = e.select("event_type").distinct()
    named = types.agg(F.sort_array(F.collect_set("event_type")).alias("all"))
    ids = named.select(F.posexplode("all").alias("s", "event_type")).select("event_type", F.col("s").cast("bigint").alias("source_id"))
    cells = e.groupBy("event_type", F.hour("ts").alias("x"), (F.dayofmonth("ts") - 1).alias("y")).agg(F.sum("value").alias("v"))
    full = (ids.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(23)))))
    dense = full.join(cells, ["event_type", "y", "x"], "left").select(
        F.lit(1).cast("bigint").alias("set_id"), "source_id", "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))
    s = F.col("source_id")
    t = sim_from_polar(F.lit(1.0), 0.05 * s, 10.25 * s, 3.5 * s)
    placed = ids.select(F.lit(1).cast("bigint").alias("set_id"), "source_id", t.alias("t"), F.lit(24).alias("width"), F.lit(30).alias("height"))
    return cut(dense), cut(placed)


@R.add("regrid", f"""WITH {_PLACE} SELECT s AS source_id, x::INT AS x, y::INT AS y, {sq('v', 4)} AS v,
  {sq('greatest((1 - abs(2*sx/24 - 1)) * (1 - abs(2*sy/30 - 1)), 1e-5::DOUBLE)')} AS tent FROM smp""")
def _(spark, sf):
    cells, placed = event_sources(spark, sf)
    frame = placement.frame_extent(placed, 100, ["set_id"])
    return G.regrid(cells, placed, frame).select("source_id", "x", "y", rd("v", 4).alias("v"), rd("tent").alias("tent"))


def _ring(steps: int) -> str:
    """Azimuth and elevation of the border samples of every camera."""
    return f"""SELECT s, atan2(dx, dz) AS th, asin(-dy / sqrt(dx*dx + dy*dy + dz*dz)) AS ph FROM (SELECT s, cos(pan)*qx + sin(pan) AS dx, qy AS dy, cos(pan) - sin(pan)*qx AS dz
  FROM (SELECT s, pan, (ex - 12) / 30 AS qx, (ey - 15) / 30 AS qy FROM (SELECT s, pan, unnest([k/{steps}*24, k/{steps}*24, 0, 24]) AS ex, unnest([0, 30, k/{steps}*30, k/{steps}*30]) AS ey FROM cam, range({steps + 1}) r(k))))"""


_TURN = f"""{_PLACE[:_PLACE.index('pl AS')]}cam AS (SELECT s, (s - 2) * 0.3::DOUBLE AS pan FROM ty),
fr AS (SELECT min(th) AS u0, max(th) AS u1, min(ph) AS v0, max(ph) AS v1 FROM ({_ring(16)})),
fs AS (SELECT *, 120 / (u1 - u0) AS sc, greatest(1, floor((v1 - v0) * (120 / (u1 - u0)))) AS oh FROM fr),
bb AS (SELECT s, min((th - u0)*sc - 0.5) AS xl, max((th - u0)*sc - 0.5) AS xh, min((v1 - ph)*sc - 0.5) AS yl, max((v1 - ph)*sc - 0.5) AS yh, any_value(sqrt(0.18::DOUBLE) * sc / 30 + 2) AS pad FROM ({_ring(24)}), fs GROUP BY s),
oc AS (SELECT cam.s, pan, px.x, py.y, u0 + (px.x + 0.5)/sc AS th, v1 - (py.y + 0.5)/sc AS ph FROM cam JOIN bb USING (s), fs, range(120) px(x), range(600) py(y)
  WHERE px.x BETWEEN greatest(0, trunc(xl - pad)) AND least(119, trunc(xh + pad)) AND py.y BETWEEN greatest(0, trunc(yl - pad)) AND least(oh - 1, trunc(yh + pad))),
cd AS (SELECT *, cos(pan)*sin(th)*cos(ph) - sin(pan)*cos(th)*cos(ph) AS cx, -sin(ph) AS cy, sin(pan)*sin(th)*cos(ph) + cos(pan)*cos(th)*cos(ph) AS cz FROM oc),
im AS (SELECT s, x, y, 30*cx/cz + 12 AS ix, 30*cy/cz + 15 AS iy FROM cd WHERE cz > 1e-9),
iv AS (SELECT s, x, y, ix - 0.1::DOUBLE * least(greatest(iy, 0), 30) / 30 * 3 AS sx, iy + 0.1::DOUBLE * least(greatest(ix, 0), 24) / 24 * 3 AS sy FROM im),
{_PLACE[_PLACE.index('ins AS'):]}"""


@R.add("regrid_cameras", f"""WITH {_TURN} SELECT s AS source_id, x::INT AS x, y::INT AS y, {sq('v', 4)} AS v,
  {sq('greatest((1 - abs(2*sx/24 - 1)) * (1 - abs(2*sy/30 - 1)), 1e-5::DOUBLE)')} AS tent FROM smp""")
def _(spark, sf):
    cells, placed = event_sources(spark, sf)
    pan = (F.col("source_id") - 2) * 0.3
    zero = F.lit(0.0)
    rot = F.array(F.cos(pan), zero, -F.sin(pan), zero, F.lit(1.0), zero, F.sin(pan), zero, F.cos(pan))
    cams = placed.select("set_id", "source_id", rot.alias("rot"), F.lit(30.0).alias("focal"), "width", "height")
    frame = placement.angular_frame(cams, F.lit("spherical"), 120, ["set_id"])
    mesh = (cams.select("set_id", "source_id").withColumn("vr", F.explode(F.sequence(F.lit(0), F.lit(3))))
            .withColumn("vc", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("dx", 0.1 * F.col("vr")).withColumn("dy", -0.1 * F.col("vc")))
    out = G.regrid_cameras(cells, cams, frame, F.lit("spherical"), mesh=mesh, spacing=10)
    return out.select("source_id", "x", "y", rd("v", 4).alias("v"), rd("tent").alias("tent"))


@R.add("composite_mean", f"""WITH {_PLACE}, m AS (SELECT max(v) AS top FROM ce), tw AS (SELECT smp.x, smp.y, v / top AS v, greatest((1 - abs(2*sx/24 - 1)) * (1 - abs(2*sy/30 - 1)), 1e-5::DOUBLE) AS t FROM smp, m)
  SELECT x::INT AS x, y::INT AS y, {sq('sum(v*t)/sum(t)', 5)} AS v FROM tw GROUP BY 1, 2""")
def _(spark, sf):
    cells, placed = event_sources(spark, sf)
    frame = placement.frame_extent(placed, 100, ["set_id"])
    top = cells.groupBy("set_id").agg(F.max("v").alias("top"))
    scaled = cells.join(top, "set_id").withColumn("v", F.col("v") / F.col("top")).drop("top")
    return blending.weighted_blend(G.regrid(scaled, placed, frame), ["v"]).select("x", "y", rd("v", 5).alias("v"))


_WHOLE = f"""{_PLACE}, top AS (SELECT max(v) AS top FROM ce),
l0 AS (SELECT s, x::INT AS x, y::INT AS y, v / top AS v, greatest((1 - abs(2*sx/24 - 1)) * (1 - abs(2*sy/30 - 1)), 1e-5::DOUBLE) AS tent FROM smp, top),
sh AS (SELECT DISTINCT s FROM l0),
ov AS (SELECT p.s AS a, q.s AS b, count(*) AS n, avg(p.v) AS ia, avg(q.v) AS ib FROM l0 p JOIN l0 q ON p.x = q.x AND p.y = q.y AND p.s < q.s GROUP BY 1, 2 HAVING count(*) > 25){_GAINS[len(_SHIP):]},
ly AS (SELECT s, x, y, v * gain AS v, tent FROM l0 JOIN allg ON source_id = s),
own AS (SELECT x, y, s FROM ly QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY tent DESC, s) = 1),
{bands_sql(5, "SELECT 100 AS w, oh::INT AS h FROM fs")},
cv AS (SELECT 1 AS k, x::INT AS x, y::INT AS y FROM bl), {_RECT[len(_DAYS) + 2:]}"""


@R.add("composite", f"""WITH RECURSIVE {_WHOLE}, f AS (SELECT rc.*, w > 100 // 4 AND h > oh // 4 AS big FROM rc, fs)
  SELECT (bl.x - CASE WHEN big THEN f.x ELSE 0 END)::INT AS x, (bl.y - CASE WHEN big THEN f.y ELSE 0 END)::INT AS y, {sq('v', 5)} AS v FROM bl, f
  WHERE NOT big OR (bl.x >= f.x AND bl.x < f.x + w AND bl.y >= f.y AND bl.y < f.y + h)""")
def _(spark, sf):
    cells, placed = event_sources(spark, sf)
    frame = cut(placement.frame_extent(placed, 100, ["set_id"]))
    top = cells.groupBy("set_id").agg(F.max("v").alias("top"))
    scaled = cells.join(top, "set_id").withColumn("v", F.col("v") / F.col("top")).drop("top")
    out, _ = composite(scaled, placed, frame)
    return out.select("x", "y", rd("v", 5).alias("v"))


QUERIES, ORACLE = R.queries, R.oracle
