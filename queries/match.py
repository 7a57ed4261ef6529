"""Matching and grouping on the embeddings: source = label, feature = vec_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import Registry, load, rd, sq
from tessera.functions.plane import hash_unit
from tessera.functions.similarity import sim_apply, sim_from_polar, sim_inverse
from tessera.operators import graph, matching
from tessera.plans.recognize import group_edges, recognize
from tessera.session import cut

R = Registry()
RATIO = 0.95

MATCHES = f"""emb AS (SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS e FROM embeddings),
dots AS (SELECT p.label AS a, q.label AS b, p.vec_id AS fa, q.vec_id AS fb, list_dot_product(p.e, q.e) AS dot
  FROM emb p JOIN emb q ON p.label < q.label),
ranked AS (SELECT *, row_number() OVER w AS rn, lead(dot) OVER w AS runner FROM dots WINDOW w AS (PARTITION BY a, b, fa ORDER BY dot DESC, fb)),
matches AS (SELECT a, b, fa, fb, sqrt(greatest(2 - 2*dot, 0)) AS distance FROM ranked WHERE rn = 1 AND greatest(2 - 2*runner, 0) > 1e-7
  AND greatest(2 - 2*dot, 0) < {RATIO}::DOUBLE * {RATIO}::DOUBLE * greatest(2 - 2*runner, 0)),
counts AS (SELECT a, b, count(*) AS n FROM matches GROUP BY 1, 2),
ends AS (SELECT a AS s, b AS o, n FROM counts UNION ALL SELECT b, a, n FROM counts)"""


def candidates_sql(m: int, name: str) -> str:
    return (f"{name} AS (SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b, n FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY s ORDER BY n DESC, o) AS rn FROM ends) WHERE rn <= {m} AND n >= 4)")


def components_sql(edges: str, name: str) -> str:
    """Label every node of ``edges`` (a, b) with the smallest node it reaches."""
    return (f"{name}_e AS (SELECT a AS u, b AS v FROM {edges} UNION SELECT b, a FROM {edges}), "
            f"{name}_r AS (SELECT u AS node, u AS seen FROM {name}_e UNION SELECT e.v, r.seen FROM {name}_r r JOIN {name}_e e ON e.u = r.node), "
            f"{name} AS (SELECT node, min(seen) AS component FROM {name}_r GROUP BY 1)")


def features(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select(F.lit(1).cast("bigint").alias("set_id"), F.col("label").cast("bigint").alias("source_id"),
                    F.col("vec_id").alias("feature_id"), (F.col("embedding")[0].cast("double") * 1000).alias("x"),
                    (F.col("embedding")[1].cast("double") * 1000).alias("y"), F.col("embedding").alias("descriptor"))


def found(spark, sf):
    return matching.match_2nn(features(spark, sf), RATIO)


@R.add("match_2nn", f"WITH {MATCHES} SELECT a, b, fa, fb, {sq('distance')} AS distance FROM matches")
def _(spark, sf):
    return found(spark, sf).select("a", "b", "fa", "fb", rd("distance").alias("distance"))


@R.add("match_counts", f"WITH {MATCHES} SELECT a, b, n AS n_matches FROM counts")
def _(spark, sf):
    return matching.match_counts(found(spark, sf)).drop("set_id")


@R.add("match_points", f"""WITH {MATCHES} SELECT m.a, m.b, m.fa, m.fb, {sq('p.e[1] * 1000', 4)} AS xa, {sq('p.e[2] * 1000', 4)} AS ya,
  {sq('q.e[1] * 1000', 4)} AS xb, {sq('q.e[2] * 1000', 4)} AS yb FROM matches m JOIN emb p ON p.vec_id = m.fa JOIN emb q ON q.vec_id = m.fb""")
def _(spark, sf):
    p = matching.match_points(found(spark, sf), features(spark, sf))
    return p.select("a", "b", "fa", "fb", *[rd(c, 4).alias(c) for c in ("xa", "ya", "xb", "yb")])


@R.add("candidate_pairs", f"WITH {MATCHES}, {candidates_sql(6, 'c')} SELECT a, b, n AS n_matches FROM c")
def _(spark, sf):
    return matching.candidate_pairs(matching.match_counts(found(spark, sf))).drop("set_id")


_GROUPS = f"""WITH RECURSIVE {MATCHES}, {candidates_sql(1, 'c')}, {components_sql('c', 'cc')},
sizes AS (SELECT component, count(*) AS size FROM cc GROUP BY 1),
npairs AS (SELECT component, count(*) AS n_pairs FROM c JOIN cc ON c.a = cc.node GROUP BY 1),
groups AS (SELECT component, size, n_pairs, row_number() OVER (ORDER BY size DESC, component) AS group_id FROM sizes JOIN npairs USING (component) WHERE size >= 2)"""


def edges(spark, sf, m=1):
    return group_edges(found(spark, sf), m)


@R.add("recognize_groups", f"{_GROUPS} SELECT group_id, node AS source_id, component, size, n_pairs FROM groups JOIN cc USING (component)")
def _(spark, sf):
    return graph.assemble_groups(edges(spark, sf)).drop("set_id")


@R.add("connected_components", f"WITH RECURSIVE {MATCHES}, {candidates_sql(1, 'c')}, {components_sql('c', 'cc')} SELECT node, component FROM cc")
def _(spark, sf):
    return graph.connected_components(edges(spark, sf))


# components stored before the sources with odd numbers came, then theirs added
@R.add("add_pairs", f"WITH RECURSIVE {MATCHES}, {candidates_sql(1, 'c')}, {components_sql('c', 'cc')} SELECT node AS source_id, component FROM cc")
def _(spark, sf):
    pairs = cut(edges(spark, sf).select("set_id", "a", "b"))
    late = (F.col("a") % 2 == 1) | (F.col("b") % 2 == 1)
    return graph.add_pairs(graph.set_components(pairs.filter(~late)), pairs.filter(late)).select("source_id", "component")


# every vector also names a source by its number, and half of these sources are in no group at all
@R.add("unplaced", f"{_GROUPS} SELECT DISTINCT vec_id % 20 AS source_id FROM embeddings WHERE vec_id % 20 NOT IN (SELECT node FROM cc)")
def _(spark, sf):
    known = load(spark, sf, "embeddings").select(F.lit(1).cast("bigint").alias("set_id"), (F.col("vec_id") % 20).alias("source_id")).distinct()
    return graph.unplaced(known, graph.assemble_groups(edges(spark, sf))).select("source_id")


@R.add("recognize_report", f"""{_GROUPS}, nm AS (SELECT DISTINCT label::BIGINT AS label, 'source ' || label AS name FROM embeddings)
  SELECT group_id, 'group' AS kind, NULL::BIGINT AS a, NULL::BIGINT AS b, size AS n, 'group ' || group_id || ': ' || size || ' sources, ' || n_pairs || ' pairs' AS text FROM groups
  UNION ALL SELECT group_id, 'member', node, NULL, 1, name FROM groups JOIN cc USING (component) JOIN nm ON nm.label = node
  UNION ALL SELECT group_id, 'pair', a, b, n, 'source ' || a || ' <-> source ' || b || ': ' || n || ' inliers' FROM c JOIN cc ON c.a = cc.node JOIN groups USING (component)
  UNION ALL SELECT NULL, 'unmatched', label, NULL, 0, name FROM nm WHERE label NOT IN (SELECT node FROM cc)""")
def _(spark, sf):
    e = edges(spark, sf)
    sources = features(spark, sf).select("set_id", "source_id").distinct().withColumn(
        "name", F.concat(F.lit("source "), F.col("source_id")))
    return graph.recognize_report(graph.assemble_groups(e), e, sources).drop("set_id")


@R.add("placement_order", f"""WITH RECURSIVE {MATCHES}, {candidates_sql(6, 'c')}, {components_sql('c', 'cc')},
  e AS (SELECT component, a, b, n FROM c JOIN cc ON c.a = cc.node),
  seed AS (SELECT component, a, b FROM e QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, a, b) = 1),
  grow AS (SELECT component, [a, b] AS placed, 1::BIGINT AS step, b AS node FROM seed
    UNION ALL SELECT component, list_append(placed, node), step + 1, node FROM (
      SELECT g.component, g.placed, g.step, CASE WHEN list_contains(g.placed, e.a) THEN e.b ELSE e.a END AS node,
        row_number() OVER (PARTITION BY g.component ORDER BY e.n DESC, e.a, e.b) AS rn
      FROM grow g JOIN e ON e.component = g.component AND list_contains(g.placed, e.a) <> list_contains(g.placed, e.b)) WHERE rn = 1)
  SELECT component, a AS source_id, 0::BIGINT AS step FROM seed UNION ALL SELECT component, node, step FROM grow""")
def _(spark, sf):
    return graph.placement_order(edges(spark, sf, 6)).drop("set_id")


@R.add("choose_model", f"""{_GROUPS}, {candidates_sql(2, 'd')}, {components_sql('d', 'dd')},
  p AS (SELECT max(size) AS best FROM groups), s AS (SELECT max(n) AS best FROM (SELECT count(*) AS n FROM dd GROUP BY component)),
  far AS (SELECT max(abs(embedding[1]::DOUBLE)) * 1000 AS spread FROM embeddings)
  SELECT p.best AS pano_best, s.best AS strip_best, {sq('spread', 4)} AS spread,
  CASE WHEN s.best > p.best OR (s.best = p.best AND spread >= 15) THEN 'strip' ELSE 'panorama' END AS model FROM p, s, far""")
def _(spark, sf):
    m = cut(found(spark, sf))
    spread = features(spark, sf).groupBy("set_id").agg(F.max(F.abs("x")).alias("spread"))
    d = graph.choose_model(graph.assemble_groups(group_edges(m, 1)), graph.assemble_groups(group_edges(m, 2)), spread)
    return d.select("pano_best", "strip_best", rd("spread", 4).alias("spread"), "model")


# --- whole recognition: every label is a set whose vectors lie in a plane seen by four sources -----------

_SEEN = """lm AS (SELECT label::BIGINT AS set_id, vec_id, ('0x' || substr(md5(concat_ws('-', 'wx', vec_id)), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2800 AS wx FROM embeddings),
vis AS (SELECT set_id, vec_id, s FROM lm, range(4) r(s) WHERE wx >= 700*s - 100 AND wx < 700*s + 1300),
c AS (SELECT a.set_id, a.s AS a, b.s AS b, count(*) AS n FROM vis a JOIN vis b ON a.set_id = b.set_id AND a.vec_id = b.vec_id AND a.s < b.s GROUP BY 1, 2, 3 HAVING count(*) >= 8)"""


def plane_features(spark, sf):
    e = load(spark, sf, "embeddings")
    s = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint")))
    d = e.select(F.col("label").cast("bigint").alias("set_id"), F.col("vec_id").alias("feature_id"), F.col("embedding").alias("descriptor"),
                 (hash_unit(F.lit("wx"), F.col("vec_id")) * 2800).alias("wx"), (hash_unit(F.lit("wy"), F.col("vec_id")) * 1500).alias("wy"), s.alias("source_id"))
    k = F.col("source_id")
    d = d.filter((F.col("wx") >= 700 * k - 100) & (F.col("wx") < 700 * k + 1300))
    d = d.withColumn("t", sim_inverse(sim_from_polar(1 + 0.01 * (k % 3 - 1), 0.01 * (k - 2), 700.0 * k, 10.0 * k)))
    x, y = sim_apply(F.col("t"), F.col("wx"), F.col("wy"))
    return d.select("set_id", "source_id", "feature_id", "descriptor", x.alias("x"), y.alias("y"))


def plane_sizes(features_df):
    return features_df.select("set_id", "source_id").distinct().select("*", F.lit(1400).alias("width"), F.lit(1500).alias("height"))


@R.add("recognize_similarity", f"""WITH RECURSIVE {_SEEN}, e AS (SELECT set_id, a AS u, b AS v FROM c UNION SELECT set_id, b, a FROM c),
  rc AS (SELECT set_id, u AS node, u AS seen FROM e UNION SELECT e.set_id, e.v, rc.seen FROM rc JOIN e ON e.set_id = rc.set_id AND e.u = rc.node),
  cc AS (SELECT set_id, node, min(seen) AS component FROM rc GROUP BY 1, 2), sz AS (SELECT set_id, component, count(*) AS size FROM cc GROUP BY 1, 2),
  np AS (SELECT c.set_id, component, count(*) AS n_pairs, sum(n)::BIGINT AS n_inliers FROM c JOIN cc ON cc.set_id = c.set_id AND cc.node = c.a GROUP BY 1, 2)
  SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY size DESC, component) AS group_id, component, size, n_pairs, n_inliers FROM sz JOIN np USING (set_id, component)""")
def _(spark, sf):
    # every shared vector is an exact match under the planted transforms, so SQL only counts shared vectors
    f = cut(plane_features(spark, sf))
    r = recognize(f, plane_sizes(f), "similarity")
    groups = cut(r.groups)
    ends = r.pairs.filter("verified").select("set_id", F.col("a").alias("source_id"), "n_inliers")
    total = groups.join(ends, ["set_id", "source_id"]).groupBy("set_id", "group_id").agg(F.sum("n_inliers").alias("n_inliers"))
    return groups.select("set_id", "group_id", "component", "size", "n_pairs").distinct().join(total, ["set_id", "group_id"])


_GROUPED = """e AS (SELECT set_id, a AS u, b AS v FROM c UNION SELECT set_id, b, a FROM c),
  rc AS (SELECT set_id, u AS node, u AS seen FROM e UNION SELECT e.set_id, e.v, rc.seen FROM rc JOIN e ON e.set_id = rc.set_id AND e.u = rc.node),
  cc AS (SELECT set_id, node, min(seen) AS component FROM rc GROUP BY 1, 2), sz AS (SELECT set_id, component, count(*) AS size FROM cc GROUP BY 1, 2),
  np AS (SELECT c.set_id, component, count(*) AS n_pairs FROM c JOIN cc ON cc.set_id = c.set_id AND cc.node = c.a GROUP BY 1, 2),
  gr AS (SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY size DESC, component) AS group_id, component, size, n_pairs FROM sz JOIN np USING (set_id, component))"""
_SEEN_H = _SEEN[:_SEEN.index("c AS (")].replace("* 2800 AS wx", "* 2800 AS wx, ('0x' || substr(md5(concat_ws('-', 'wy', vec_id)), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 1500 AS wy").replace(
    "SELECT set_id, vec_id, s FROM", "SELECT set_id, vec_id, s, wx, wy FROM") + """ps AS (SELECT *, 1 + 0.01::DOUBLE * (s % 3 - 1) AS sc, 0.01::DOUBLE * (s - 2) AS rot FROM vis),
spot AS (SELECT set_id, vec_id, s, ((wx - 700*s) * cos(rot) + (wy - 10*s) * sin(rot)) / sc AS x, ((wy - 10*s) * cos(rot) - (wx - 700*s) * sin(rot)) / sc AS y FROM ps),
n AS (SELECT a.set_id, a.s AS a, b.s AS b, count(*) AS n, count(*) FILTER (b.x >= 0 AND b.x < 1400 AND b.y >= 0 AND b.y < 1500) AS n_overlap FROM spot a JOIN spot b ON a.set_id = b.set_id
  AND a.vec_id = b.vec_id AND a.s < b.s GROUP BY 1, 2, 3),
c AS (SELECT * FROM n WHERE n >= 4 AND n > 8 + 0.3::DOUBLE * n_overlap)"""


@R.add("recognize_homography", f"WITH RECURSIVE {_SEEN_H}, {_GROUPED} SELECT gr.set_id, group_id, node AS source_id, gr.component, size, n_pairs FROM gr JOIN cc ON cc.set_id = gr.set_id AND cc.component = gr.component")
def _(spark, sf):
    # every shared vector agrees with the planted transforms; what remains is the count that a homography needs to be believed
    f = cut(plane_features(spark, sf))
    g = recognize(f, plane_sizes(f), "homography").groups
    return g.select("set_id", "group_id", "source_id", "component", "size", "n_pairs")


QUERIES, ORACLE = R.queries, R.oracle
