"""Positions: customers as sources, nations as sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import Registry, load, rd, sq
from tessera.functions.plane import ground_distance, hash_unit
from tessera.operators import positions as P
from tessera.session import cut

R = Registry()


def _dist(lat1, lon1, lat2, lon2):
    return (f"sqrt(pow(radians({lon2} - {lon1}) * cos(radians(({lat1} + {lat2}) / 2)), 2) + pow(radians({lat2} - {lat1}), 2)) * 6371000")


_POS = """po AS (SELECT c_nationkey::BIGINT AS set_id, c_custkey AS source_id, c_name AS name, 30 + c_acctbal / 1000 AS lat,
  -80 + ('0x' || substr(md5(concat_ws('-', 'lon', c_custkey)), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 10 AS lon FROM customer)"""
_NEAR = f"""{_POS}, nn AS (SELECT p.set_id, p.source_id, min({_dist('p.lat', 'p.lon', 'q.lat', 'q.lon')}) AS nearest
  FROM po p JOIN po q ON p.set_id = q.set_id AND p.source_id <> q.source_id GROUP BY 1, 2),
st AS (SELECT set_id, nearest AS step FROM nn QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY nearest, source_id) - 1 = count(*) OVER (PARTITION BY set_id) // 2),
sp AS (SELECT p.set_id, max({_dist('p.lat', 'p.lon', 'q.lat', 'q.lon')}) AS spread FROM po p JOIN po q ON p.set_id = q.set_id AND p.source_id < q.source_id GROUP BY 1)"""


def positions(spark, sf):
    return load(spark, sf, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("set_id"), F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name"),
        (30 + F.col("c_acctbal") / 1000).alias("lat"), (-80 + hash_unit(F.lit("lon"), F.col("c_custkey")) * 10).alias("lon"))


@R.add("ground_distance", f"""WITH {_POS} SELECT p.source_id, {sq(_dist('p.lat', 'p.lon', 'q.lat', 'q.lon'), 2)} AS metres
  FROM po p JOIN po q ON q.source_id = p.source_id + 1""")
def _(spark, sf):
    p = positions(spark, sf)
    q = p.select((F.col("source_id") - 1).alias("source_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    d = ground_distance(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return p.join(q, "source_id").select("source_id", rd(d, 2).alias("metres"))


@R.add("nearest_neighbor", f"WITH {_NEAR} SELECT set_id, source_id, {sq('nearest', 3)} AS nearest FROM nn")
def _(spark, sf):
    return P.nearest_neighbor(positions(spark, sf)).select("set_id", "source_id", rd("nearest", 3).alias("nearest"))


@R.add("gps_spread", f"WITH {_NEAR} SELECT set_id, {sq('spread', 3)} AS spread FROM sp")
def _(spark, sf):
    return P.gps_spread(positions(spark, sf)).select("set_id", rd("spread", 3).alias("spread"))


@R.add("typical_step", f"WITH {_NEAR} SELECT set_id, {sq('step', 3)} AS step FROM st")
def _(spark, sf):
    return P.typical_step(P.nearest_neighbor(positions(spark, sf))).select("set_id", rd("step", 3).alias("step"))


@R.add("gap_notes", f"""WITH {_NEAR} SELECT set_id, source_id, name, {sq('nearest', 3)} AS nearest, {sq('nearest / step')} AS ratio, 'apart' AS status
  FROM po JOIN nn USING (set_id, source_id) JOIN st USING (set_id) WHERE step > 0 AND nearest / step >= 1.6 AND source_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def _(spark, sf):
    pos = positions(spark, sf)
    near = cut(P.nearest_neighbor(pos))
    placed = load(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("source_id")).distinct()
    notes = P.gap_notes(pos.join(placed, "source_id", "left_anti"), near, P.typical_step(near))
    return notes.select("set_id", "source_id", "name", rd("nearest", 3).alias("nearest"), rd("ratio").alias("ratio"), "status")


@R.add("gps_summary", f"""WITH {_NEAR}, n AS (SELECT set_id, count(*) AS placed, count(*) + set_id % 2 AS total FROM po GROUP BY set_id)
  SELECT set_id, placed, total, total - placed AS missing, {sq('spread', 3)} AS spread, {sq('step', 3)} AS step,
  CASE WHEN spread < 15 THEN 'standing' ELSE 'moving' END AS status FROM n JOIN sp USING (set_id) JOIN st USING (set_id)""")
def _(spark, sf):
    pos = positions(spark, sf)
    totals = pos.groupBy("set_id").agg((F.count(F.lit(1)) + F.col("set_id") % 2).alias("total"))
    s = P.gps_summary(pos, totals, P.gps_spread(pos), P.typical_step(P.nearest_neighbor(pos)))
    return s.select("set_id", "placed", "total", "missing", rd("spread", 3).alias("spread"), rd("step", 3).alias("step"), "status")


QUERIES, ORACLE = R.queries, R.oracle
