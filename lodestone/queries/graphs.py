"""Diagrams as node and edge tables: repair, audit, order and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import graph as G
from lodestone.queries.registry import query
from lodestone.sources.tables import table

#: Twelve customers in a row are the edges of a diagram of nine nodes; every third has a node on its own.
GRAPH_SQL = """e AS (
  SELECT c_custkey // 12 AS graph, (c_custkey * 5) % 9 AS src, (c_custkey * 7 + c_nationkey) % 9 AS dst, c_custkey AS pos,
         CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Over 500 K' WHEN 2 THEN 'Not approved' WHEN 3 THEN 'over  500 k' ELSE '' END AS condition,
         CAST(c_custkey % 50 AS DOUBLE) AS head_margin FROM customer),
ids AS (SELECT graph, src AS id FROM e UNION SELECT graph, dst FROM e UNION SELECT graph, 20 FROM e WHERE graph % 3 = 0),
n AS (
  SELECT graph, id, CASE WHEN id % 4 = 3 THEN 'Step A' ELSE 'Step ' || id END AS label,
         CASE WHEN id % 5 = 0 THEN 'approver' WHEN id = 8 THEN 'junction' ELSE 'step' END AS kind, id AS pos FROM ids)"""
LOOP_SQL = "regexp_matches(lower(coalesce({}, '')), 'not approved|rejected|reject|return|revise')"


SEQUENCE_SQL = f"""ah AS (SELECT graph, src, dst, pos FROM e WHERE NOT {LOOP_SQL.format('condition')}),
st AS (SELECT graph, arg_min(id, pos) AS id FROM n WHERE graph IN (SELECT graph FROM ah) AND NOT EXISTS (SELECT 1 FROM ah WHERE ah.graph = n.graph AND ah.dst = n.id) GROUP BY graph),
wy AS (SELECT graph, src, list(DISTINCT dst) AS ends FROM ah GROUP BY graph, src),
wk(graph, path) AS (
  SELECT graph, [id] FROM st
  UNION ALL
  SELECT wk.graph, list_append(path, list_filter(ends, lambda x: NOT list_contains(path, x))[1]) FROM wk JOIN wy ON wy.graph = wk.graph AND wy.src = path[-1]
  WHERE len(list_filter(ends, lambda x: NOT list_contains(path, x))) = 1),
lw AS (SELECT graph, arg_max(path, len(path)) AS path FROM wk GROUP BY graph),
sq AS (SELECT lw.graph, path, coalesce(len(list_filter(ends, lambda x: NOT list_contains(path, x))) > 1, false) AS branched FROM lw LEFT JOIN wy ON wy.graph = lw.graph AND wy.src = path[-1]),
se AS (SELECT graph, unnest(path) AS id, generate_subscripts(path, 1) AS place, branched FROM sq)"""
ESCALATION = r"regexp_matches(coalesce(condition, ''), '(?i)\b\d[\d,\.]*\s*(?:K|M|EGP|LE)\b')"
PROSE_SQL = f"""{SEQUENCE_SQL},
lb AS (SELECT graph, id, label FROM n),
p1 AS (SELECT graph, string_agg(label, '; ' ORDER BY pos) FILTER (kind <> 'approver') AS steps FROM n GROUP BY graph),
p2 AS (SELECT se.graph, count(*) AS k, bool_or(branched) AS branched, string_agg(chr(10) || '  ' || place || '. ' || label, '' ORDER BY place) AS lines, arg_max(label, place) AS final FROM se JOIN lb ON lb.graph = se.graph AND lb.id = se.id GROUP BY se.graph),
p3 AS (SELECT e.graph, string_agg(chr(10) || '  - ' || a.label || ' -> ' || b.label || CASE WHEN coalesce(condition, '') <> '' THEN ' [' || condition || ']' ELSE '' END, '' ORDER BY pos) AS routes
       FROM e JOIN lb a ON a.graph = e.graph AND a.id = e.src JOIN lb b ON b.graph = e.graph AND b.id = e.dst GROUP BY e.graph),
q4 AS (SELECT e.graph, trim(condition) AS condition, b.label AS who, min(pos) AS pos FROM e JOIN lb b ON b.graph = e.graph AND b.id = e.dst WHERE {ESCALATION} GROUP BY ALL),
p4 AS (SELECT graph, string_agg(chr(10) || '  - A purchase value of "' || condition || '" requires approval by ' || who || '. ' || who || ' approves at value: ' || condition || '.', '' ORDER BY pos) AS limits FROM q4 GROUP BY graph),
pr AS (
  SELECT graph, graph || chr(10) || 'Approval workflow: ' || graph || '.' || chr(10) || coalesce(chr(10) || 'Steps: ' || steps || '.', '')
    || CASE WHEN k > 1 AND branched THEN chr(10) || chr(10) || 'Order of approval so far, first to last (each one signs after the one before it); the route then branches:' || lines
              || chr(10) || '  After ' || final || ' the route branches; who signs next depends on the value, see Routing and Approval thresholds below.'
            WHEN k > 1 THEN chr(10) || chr(10) || 'Order of approval, first to last (each one signs after the one before it):' || lines ELSE '' END
    || chr(10) || chr(10) || 'Routing:' || coalesce(routes, '') || coalesce(chr(10) || chr(10) || 'Approval thresholds:' || limits, '') AS text
  FROM p1 LEFT JOIN p2 USING (graph) LEFT JOIN p3 USING (graph) LEFT JOIN p4 USING (graph))"""
LANES_SQL = """u AS (SELECT graph, src AS a, dst AS b FROM e UNION SELECT graph, dst, src FROM e),
cw(graph, id, r) AS (SELECT graph, a, a FROM u UNION SELECT cw.graph, cw.id, u.b FROM cw JOIN u ON u.graph = cw.graph AND u.a = cw.r),
cc AS (SELECT graph, id, min(r) AS root FROM cw GROUP BY graph, id),
cs AS (SELECT n.graph, root, count(*) AS size, arg_min(n.id, (n.pos, n.id)) AS lane, min(n.pos) AS first FROM n JOIN cc ON cc.graph = n.graph AND cc.id = n.id GROUP BY n.graph, root),
cb AS (SELECT graph, arg_max(lane, (size, -first)) AS lane FROM cs GROUP BY graph),
ca AS (SELECT graph, arg_min(id, (pos, id)) AS lane FROM n GROUP BY graph),
ln AS (SELECT n.graph, n.id, coalesce(cs.lane, cb.lane, ca.lane) AS lane FROM n LEFT JOIN cc ON cc.graph = n.graph AND cc.id = n.id LEFT JOIN cs ON cs.graph = n.graph AND cs.root = cc.root LEFT JOIN cb ON cb.graph = n.graph LEFT JOIN ca ON ca.graph = n.graph)"""


def edges(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = F.when(k % 5 == 1, "Over 500 K").when(k % 5 == 2, "Not approved").when(k % 5 == 3, "over  500 k").when(k % 5 == 4, "")
    graph = F.floor(k / 12).cast("long")
    return table(spark, sf_dir, "customer").select(graph.alias("graph"), ((k * 5) % 9).cast("long").alias("src"), ((k * 7 + n) % 9).cast("long").alias("dst"), k.cast("long").alias("pos"), c.alias("condition"), (k % 50).cast("double").alias("head_margin"))


def nodes(spark, sf_dir):
    e = edges(spark, sf_dir)
    ids = e.select("graph", F.explode(F.array("src", "dst", F.when(F.col("graph") % 3 == 0, F.lit(20).cast("long")))).alias("id")).where("id is not null").distinct()
    i = F.col("id")
    return ids.select("graph", "id", F.when(i % 4 == 3, "Step A").otherwise(F.concat(F.lit("Step "), i.cast("string"))).alias("label"), F.when(i % 5 == 0, "approver").when(i == 8, "junction").otherwise("step").alias("kind"), i.alias("pos"))


def both(spark, sf_dir):
    return nodes(spark, sf_dir), edges(spark, sf_dir)


@query(f"WITH {GRAPH_SQL} SELECT graph, id, label FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph = n.graph AND (e.src = n.id OR e.dst = n.id))")
def orphan_nodes(spark, sf_dir):
    return G.orphan_nodes(*both(spark, sf_dir)).select("graph", "id", "label")


@query(f"WITH {GRAPH_SQL}, b AS (SELECT graph, src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT graph, dst, 1, 0 FROM e) SELECT graph, id, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM b GROUP BY graph, id")
def node_degrees(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL}, m AS (SELECT *, trim(regexp_replace(lower(coalesce(condition, '')), '\\s+', ' ', 'g')) AS norm FROM e),
a AS (SELECT *, bool_or(norm <> '') OVER (PARTITION BY graph, src, dst) AS has, row_number() OVER (PARTITION BY graph, src, dst, norm ORDER BY pos) AS r FROM m)
SELECT graph, src, dst, condition, pos FROM a WHERE (norm <> '' OR NOT has) AND r = 1""")
def edge_dedupe(spark, sf_dir):
    return G.dedupe_edges(edges(spark, sf_dir)).select("graph", "src", "dst", "condition", "pos")


@query(f"""WITH {GRAPH_SQL},
u AS (SELECT graph, src, dst, list(coalesce(condition, '') ORDER BY pos) AS said, max(head_margin) AS head_margin FROM e GROUP BY graph, src, dst)
SELECT graph, src, dst, nullif(list_reduce(list_prepend('', said), lambda s, x: CASE WHEN x = '' OR contains(s, x) THEN s ELSE trim(s || ' ' || x) END), '') AS condition, head_margin FROM u""")
def edge_condition_union(spark, sf_dir):
    return G.union_conditions(edges(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL}, k AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), ''), CAST(id AS VARCHAR)) AS key FROM n),
m AS (SELECT graph, a.key AS src, b.key AS dst, trim(coalesce(condition, '')) AS condition, min(e.pos) AS pos FROM e JOIN k a USING (graph) JOIN k b USING (graph) WHERE a.id = e.src AND b.id = e.dst AND a.key <> b.key GROUP BY ALL)
SELECT * FROM m""")
def self_loop_drop_collapse(spark, sf_dir):
    return G.collapse(*both(spark, sf_dir))[1]


@query(f"""WITH RECURSIVE {GRAPH_SQL}, s AS (SELECT graph, min(src) AS id FROM e GROUP BY graph),
w(graph, id, depth) AS (SELECT graph, id, 0 FROM s UNION SELECT w.graph, e.dst, w.depth + 1 FROM w JOIN e ON e.graph = w.graph AND e.src = w.id JOIN (SELECT graph, count(*) AS most FROM ids GROUP BY graph) c ON c.graph = w.graph WHERE w.depth < most)
SELECT graph, id, min(depth) AS depth FROM w GROUP BY graph, id""")
def reachability(spark, sf_dir):
    e = edges(spark, sf_dir)
    return G.reachable(e, e.groupBy("graph").agg(F.min("src").alias("id")))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, u AS (SELECT graph * 1000 + src AS a, graph * 1000 + dst AS b FROM e UNION SELECT graph * 1000 + dst, graph * 1000 + src FROM e),
w(node, r) AS (SELECT a, a FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.r)
SELECT node, min(r) AS component FROM w GROUP BY node""")
def graph_components(spark, sf_dir):
    e = edges(spark, sf_dir)
    return G.component_minimum(e.select((F.col("graph") * 1000 + F.col("src")).alias("a"), (F.col("graph") * 1000 + F.col("dst")).alias("b")))


@query(f"""WITH {GRAPH_SQL}, m AS (SELECT *, lower(trim(coalesce(condition, ''))) AS norm FROM e),
p AS (SELECT 'parallel' AS kind, graph, src, dst FROM m GROUP BY graph, src, dst HAVING count(*) > 1 AND (bool_or(norm = '') OR count(DISTINCT norm) < count(*))),
l AS (SELECT graph, src, dst, arg_max_null(condition, pos) AS c FROM e GROUP BY graph, src, dst),
q AS (SELECT 'reciprocal' AS kind, l.graph, l.src, l.dst FROM l JOIN l b ON b.graph = l.graph AND b.src = l.dst AND b.dst = l.src
      WHERE CAST(l.src AS VARCHAR) < CAST(l.dst AS VARCHAR) AND NOT {LOOP_SQL.format('l.c')} AND NOT {LOOP_SQL.format('b.c')}
        AND (coalesce(l.c, '') = '' OR coalesce(b.c, '') = '' OR lower(trim(l.c)) = lower(trim(b.c))))
SELECT * FROM p UNION ALL SELECT * FROM q""")
def parallel_reciprocal_audit(spark, sf_dir):
    e = edges(spark, sf_dir)
    pairs = ["graph", "src", "dst"]
    out = G.parallel_anomalies(e).select(F.lit("parallel").alias("kind"), *pairs)
    return out.unionByName(G.reciprocal_anomalies(e).select(F.lit("reciprocal").alias("kind"), *pairs))


@query(f"""WITH {GRAPH_SQL}, a AS (SELECT DISTINCT graph, src, dst FROM e WHERE pos % 12 < 8), b AS (SELECT DISTINCT graph, src, dst FROM e WHERE pos % 12 >= 4)
SELECT 'loss' AS change, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'gain', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT 'kept', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def edge_set_diff(spark, sf_dir):
    e = edges(spark, sf_dir)
    a = e.where(F.col("pos") % 12 < 8).select("graph", "src", "dst").distinct()
    b = e.where(F.col("pos") % 12 >= 4).select("graph", "src", "dst").distinct()
    tag = lambda name, df: df.select(F.lit(name).alias("change"), "graph", "src", "dst")
    return tag("loss", a.subtract(b)).unionByName(tag("gain", b.subtract(a))).unionByName(tag("kept", a.intersect(b)))


@query(f"WITH {GRAPH_SQL} SELECT e.graph, trim(condition) AS condition, label AS approver FROM e JOIN n ON n.graph = e.graph AND n.id = e.dst WHERE regexp_matches(coalesce(condition, ''), '(?i)\\b\\d[\\d,\\.]*\\s*(?:K|M|EGP|LE)\\b')")
def escalation_thresholds(spark, sf_dir):
    return G.escalation(*both(spark, sf_dir)).drop("pos")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, u AS (SELECT graph, src AS a, dst AS b FROM e UNION SELECT graph, dst, src FROM e),
w(graph, id, r) AS (SELECT graph, a, a FROM u UNION SELECT w.graph, w.id, u.b FROM w JOIN u ON u.graph = w.graph AND u.a = w.r),
c AS (SELECT graph, count(DISTINCT r) AS parts FROM (SELECT graph, id, min(r) AS r FROM w GROUP BY graph, id) GROUP BY graph),
o AS (SELECT graph, count(*) AS orphans FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph = n.graph AND (e.src = n.id OR e.dst = n.id)) GROUP BY graph),
s AS (SELECT graph, count(*) AS self_loops FROM e WHERE src = dst GROUP BY graph),
d AS (SELECT graph, count(*) AS n_nodes, count(*) - count(DISTINCT label) AS duplicates FROM n GROUP BY graph)
SELECT graph, n_nodes, duplicates, parts + coalesce(orphans, 0) AS components, coalesce(self_loops, 0) AS self_loops, coalesce(orphans, 0) AS orphans,
       parts + coalesce(orphans, 0) = 1 AND duplicates = 0 AS clean FROM d LEFT JOIN c USING (graph) LEFT JOIN o USING (graph) LEFT JOIN s USING (graph)""")
def corpus_health(spark, sf_dir):
    return G.health(*both(spark, sf_dir))


@query(f"WITH RECURSIVE {GRAPH_SQL}, {SEQUENCE_SQL} SELECT graph, CAST(place AS INTEGER) AS place, id, branched FROM se")
def main_sequence(spark, sf_dir):
    return G.main_sequence(*both(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL}, w AS (SELECT graph, src, dst, coalesce(condition, '') AS c, head_margin AS m FROM e),
j AS (SELECT a.graph, a.src, b.dst, CASE WHEN a.c = '' OR a.c = b.c THEN b.c WHEN b.c = '' THEN a.c ELSE a.c || ' ' || b.c END AS c, greatest(a.m, b.m) AS m
      FROM w a JOIN w b ON b.graph = a.graph AND b.src = 8 AND b.dst <> 8 WHERE a.dst = 8 AND a.src <> 8)
SELECT graph, src, dst, nullif(c, '') AS condition, m AS head_margin FROM (SELECT * FROM w WHERE src <> 8 AND dst <> 8 UNION ALL SELECT * FROM j)""")
def junction_contraction(spark, sf_dir):
    return G.contract_junctions(*both(spark, sf_dir))


@query(f"WITH RECURSIVE {GRAPH_SQL}, {PROSE_SQL} SELECT graph, text FROM pr")
def render_prose(spark, sf_dir):
    return G.render_prose(*both(spark, sf_dir))


@query()
def workflow_narrative(spark, sf_dir):
    return G.narrative(*both(spark, sf_dir))


@query(f"WITH RECURSIVE {GRAPH_SQL}, {LANES_SQL} SELECT graph, id, lane FROM ln")
def lane_assignment(spark, sf_dir):
    return G.lanes(*both(spark, sf_dir))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, s AS (SELECT graph, min(src) AS id FROM e GROUP BY graph),
w(graph, id, depth) AS (SELECT graph, id, 0 FROM s UNION SELECT w.graph, e.dst, w.depth + 1 FROM w JOIN e ON e.graph = w.graph AND e.src = w.id JOIN (SELECT graph, count(*) AS most FROM ids GROUP BY graph) c ON c.graph = w.graph WHERE w.depth < most),
d AS (SELECT graph, id, min(depth) AS depth FROM w GROUP BY graph, id), p AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY depth, id) AS place FROM d)
SELECT e.graph, e.src, e.dst, e.pos FROM e JOIN p a ON a.graph = e.graph AND a.id = e.src JOIN p b ON b.graph = e.graph AND b.id = e.dst WHERE b.place < a.place""")
def back_edges(spark, sf_dir):
    e = edges(spark, sf_dir)
    order = Window.partitionBy("graph").orderBy("depth", "id")
    place = G.reachable(e, e.groupBy("graph").agg(F.min("src").alias("id"))).withColumn("place", F.row_number().over(order))
    at = lambda c: place.select("graph", F.col("id").alias(c), F.col("place").alias(f"{c}_place"))
    return e.join(at("src"), ["graph", "src"]).join(at("dst"), ["graph", "dst"]).where("dst_place < src_place").select("graph", "src", "dst", "pos")
