"""Tiles, fragments, shared lanes and answers against diagrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import diagrams as D
from lodestone.operators import graph as G
from lodestone.operators import scoring as S
from lodestone.queries import graphs
from lodestone.queries.geometry import SEG_SQL, SHAPES_SQL, segments
from lodestone.queries.registry import query
from lodestone.sources.tables import table


#: Four diagrams are the tiles of a page.
TILES_SQL = f"""{graphs.GRAPH_SQL},
tn AS (SELECT graph // 4 AS page, graph % 4 AS tile, 'n' || id AS id, label, regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g') AS key, kind, graph * 100 + pos AS pos FROM n),
mn AS (SELECT page, 'main' AS lane_key, key AS id, arg_min(label, pos) AS label, arg_min(kind, pos) AS kind, min(pos) AS pos FROM tn GROUP BY page, key),
te AS (SELECT e.graph // 4 AS page, e.graph % 4 AS tile, 'n' || src AS src, 'n' || dst AS dst, condition, pos, trim(regexp_replace(lower(coalesce(condition, '')), '\\s+', ' ', 'g')) AS norm FROM e),
me AS (SELECT te.page, 'main' AS lane_key, a.key AS src, b.key AS dst, condition, te.pos, norm FROM te JOIN tn a ON a.page = te.page AND a.tile = te.tile AND a.id = te.src JOIN tn b ON b.page = te.page AND b.tile = te.tile AND b.id = te.dst),
de AS (SELECT *, bool_or(norm <> '') OVER (PARTITION BY page, src, dst) AS has, row_number() OVER (PARTITION BY page, src, dst, norm ORDER BY pos) AS r FROM me),
oe AS (SELECT page, lane_key, src, dst, condition, pos FROM de WHERE (norm <> '' OR NOT has) AND r = 1),
us AS (SELECT page, src AS id FROM oe UNION SELECT page, dst FROM oe),
ct AS (SELECT DISTINCT mn.page, mn.id FROM mn JOIN mn o ON o.page = mn.page AND o.id <> mn.id AND starts_with(o.id, mn.id) WHERE NOT EXISTS (SELECT 1 FROM us WHERE us.page = mn.page AND us.id = mn.id)),
on_ AS (SELECT * FROM mn WHERE NOT EXISTS (SELECT 1 FROM ct WHERE ct.page = mn.page AND ct.id = mn.id))"""


def _tiles(spark, sf_dir):
    n, e = graphs.both(spark, sf_dir)
    page, tile = F.floor(F.col("graph") / 4).cast("long"), (F.col("graph") % 4).cast("string")
    n = n.select(page.alias("page"), tile.alias("tile"), F.when(F.col("graph") % 4 < 2, "Main").otherwise("main ").alias("lane"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), "label", "kind", (F.col("graph") * 100 + F.col("pos")).alias("pos"))
    e = e.select(page.alias("page"), tile.alias("tile"), F.when(F.col("graph") % 4 < 2, "Main").otherwise("main ").alias("lane"), F.concat(F.lit("n"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("dst").cast("string")).alias("dst"), "condition", "pos")
    return n, e


@query(f"WITH {TILES_SQL} SELECT page, lane_key, id, label, kind, pos FROM on_")
def merged_tile_nodes(spark, sf_dir):
    return D.merge_tiles(*_tiles(spark, sf_dir))[0]


@query(f"WITH {TILES_SQL} SELECT * FROM oe")
def merged_tile_edges(spark, sf_dir):
    return D.merge_tiles(*_tiles(spark, sf_dir))[1]


@query(f"""WITH RECURSIVE {graphs.GRAPH_SQL},
nm AS (SELECT graph // 3 AS page, CAST(graph AS VARCHAR) AS lane, CASE WHEN id < 3 THEN (graph // 3) || '-' || id ELSE graph || '.' || id END AS id, graph * 100 + pos AS pos FROM n),
ee AS (SELECT graph // 3 AS page, CAST(graph AS VARCHAR) AS lane, CASE WHEN src < 3 THEN (graph // 3) || '-' || src ELSE graph || '.' || src END AS src, CASE WHEN dst < 3 THEN (graph // 3) || '-' || dst ELSE graph || '.' || dst END AS dst FROM e),
hm AS (SELECT page, id, arg_min(lane, pos) AS home FROM nm GROUP BY page, id),
tc AS (SELECT page, lane, src AS a, dst AS b FROM ee UNION SELECT page, lane, dst, src FROM ee),
pl(page, lane, id) AS (
  SELECT t.page, t.lane, t.a FROM tc t JOIN hm ON hm.page = t.page AND hm.id = t.a AND hm.home <> t.lane WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.page = t.page AND nm.lane = t.lane AND nm.id = t.a)
  UNION
  SELECT pl.page, pl.lane, t.b FROM pl JOIN hm h0 ON h0.page = pl.page AND h0.id = pl.id JOIN tc t ON t.page = pl.page AND t.lane = h0.home AND t.a = pl.id
  JOIN hm ON hm.page = pl.page AND hm.id = t.b AND hm.home <> pl.lane WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.page = pl.page AND nm.lane = pl.lane AND nm.id = t.b)),
tk AS (SELECT DISTINCT pl.page, hm.home AS lane, pl.id FROM pl JOIN hm ON hm.page = pl.page AND hm.id = pl.id),
gn AS (SELECT nm.page, nm.lane FROM nm LEFT JOIN tk ON tk.page = nm.page AND tk.lane = nm.lane AND tk.id = nm.id GROUP BY nm.page, nm.lane HAVING count(*) = count(tk.id))
SELECT * FROM (SELECT page, lane, id, true AS pulled FROM pl UNION ALL SELECT page, lane, id, false FROM nm) x WHERE NOT EXISTS (SELECT 1 FROM gn WHERE gn.page = x.page AND gn.lane = x.lane)""")
def shared_lane_nodes(spark, sf_dir):
    n, e = graphs.both(spark, sf_dir)
    page = F.floor(F.col("graph") / 3).cast("long").alias("page")
    name = lambda c: F.when(F.col(c) < 3, F.concat((F.floor(F.col("graph") / 3)).cast("string"), F.lit("-"), F.col(c).cast("string"))).otherwise(F.concat(F.col("graph").cast("string"), F.lit("."), F.col(c).cast("string")))
    nodes = n.select(page, F.col("graph").cast("string").alias("lane"), name("id").alias("id"), (F.col("graph") * 100 + F.col("pos")).alias("pos"))
    edges = e.select(page, F.col("graph").cast("string").alias("lane"), name("src").alias("src"), name("dst").alias("dst"), "pos")
    return D.shared_lanes(nodes, edges)


#: Fragments on a grid of 50 points; a component of corners with two loose ends is one connector.
FRAGMENT_SQL = f"""{SHAPES_SQL}, {SEG_SQL},
fr AS (SELECT page, conn, floor(ax / 50) * 50 AS ax, floor(ay / 50) * 50 AS ay, floor(bx / 50) * 50 AS bx, floor(by_ / 50) * 50 AS by_, CASE WHEN conn % 5 = 0 THEN 'over ' || conn END AS label FROM seg),
fe AS (SELECT page, conn, 0 AS side, ax AS x, ay AS y FROM fr UNION ALL SELECT page, conn, 1, bx, by_ FROM fr),
fu AS (SELECT page, (ax, ay) AS a, (bx, by_) AS b FROM fr UNION SELECT page, (bx, by_), (ax, ay) FROM fr),
fw(page, k, r) AS (SELECT page, a, a FROM fu UNION SELECT fw.page, fw.k, fu.b FROM fw JOIN fu ON fu.page = fw.page AND fu.a = fw.r),
fg AS (SELECT page, k, min(r) AS g FROM fw GROUP BY page, k),
fm AS (SELECT fr.*, g FROM fr JOIN fg ON fg.page = fr.page AND fg.k = (ax, ay)),
fd AS (SELECT fe.page, g, (x, y) AS k, count(*) AS n, min((conn, side, x, y)) AS pt FROM fe JOIN fg ON fg.page = fe.page AND fg.k = (x, y) GROUP BY fe.page, g, (x, y)),
ff AS (SELECT page, g, list(pt ORDER BY pt) FILTER (n = 1) AS free FROM fd GROUP BY page, g),
fl AS (SELECT page, g, count(*) AS n, min(conn) AS conn, coalesce(string_agg(label, ' ' ORDER BY conn), '') AS label FROM fm GROUP BY page, g),
fx AS (SELECT fl.*, free, n > 1 AND len(coalesce(free, [])) = 2 AS one FROM fl JOIN ff USING (page, g))"""


@query(f"""WITH RECURSIVE {FRAGMENT_SQL}
SELECT page, conn, free[1][3] AS ax, free[1][4] AS ay, free[2][3] AS bx, free[2][4] AS "by", label, CAST(n AS INTEGER) AS n FROM fx WHERE one
UNION ALL SELECT fm.page, fm.conn, ax, ay, bx, by_, fx.label, 1 FROM fm JOIN fx ON fx.page = fm.page AND fx.g = fm.g WHERE NOT one""")
def connector_fragments(spark, sf_dir):
    s = segments(spark, sf_dir)
    grid = lambda c: (F.floor(F.col(c) / 50) * 50).cast("double").alias(c)
    label = F.when(F.col("conn") % 5 == 0, F.concat(F.lit("over "), F.col("conn").cast("string"))).alias("label")
    return D.merge_fragments(s.select("page", "conn", *map(grid, ("ax", "ay", "bx", "by")), label)).drop("members")


@query(r"""WITH p AS (SELECT c_nationkey AS page, 'Over ' || CAST(floor(c_acctbal) AS BIGINT) || ' K' AS text, c_custkey FROM customer),
a AS (SELECT DISTINCT page, upper(replace(unnest(regexp_extract_all(text, '(?i)\b\d[\d,\.]*\s*(?:K|M|EGP|LE)\b')), ' ', '')) AS amount FROM p),
b AS (SELECT DISTINCT page, upper(replace(unnest(regexp_extract_all(text, '(?i)\b\d[\d,\.]*\s*(?:K|M|EGP|LE)\b')), ' ', '')) AS amount FROM p WHERE c_custkey % 3 <> 0)
SELECT * FROM a EXCEPT SELECT * FROM b""")
def lost_amounts(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), F.concat(F.lit("Over "), F.floor("c_acctbal").cast("string"), F.lit(" K")).alias("text"), "c_custkey")
    return D.lost_amounts(p, p.where("c_custkey % 3 <> 0"))


@query("""WITH p AS (SELECT c_nationkey AS page, c_custkey AS idx, 'Label ' || (c_custkey % 50) AS line FROM customer), g AS (SELECT DISTINCT page, line FROM p WHERE idx % 2 = 0)
SELECT DISTINCT page, line FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.page = p.page AND contains(g.line, p.line))""")
def missing_page_labels(spark, sf_dir):
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), k.alias("idx"), F.concat(F.lit("Label "), (k % 50).cast("string")).alias("text"))
    return D.missing_labels(p, p.where("idx % 2 = 0"))


@query(f"""WITH {SHAPES_SQL}, {SEG_SQL}, c AS (SELECT page, count(*) AS spans, count(*) FILTER (conn % 7 = 0) AS unplaced, count(*) FILTER (conn % 50 = 0) AS blank FROM seg GROUP BY page)
SELECT page, concat_ws('; ', CASE WHEN unplaced > 0 THEN unplaced || ' of ' || spans || ' text spans unclassified' END, CASE WHEN blank > 0 THEN blank || ' node(s) without a label' END) AS warnings FROM c""")
def audit_warnings(spark, sf_dir):
    c = segments(spark, sf_dir).groupBy("page").agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("conn") % 7 == 0).alias("unplaced"), F.count_if(F.col("conn") % 50 == 0).alias("blank"))
    m = D.audit_messages(F.col("spans"), F.col("unplaced"), F.col("blank"), F.lit(0), F.array().cast("array<string>"))
    return c.select("page", F.array_join(m, "; ").alias("warnings"))


def _prose(spark, sf_dir):
    return G.render_prose(*graphs.both(spark, sf_dir)).select(F.col("graph").alias("answer_id"), "text")


def _routes(spark, sf_dir):
    """Routes between different labels; repeated ones and their conditions stay."""
    n, e = graphs.both(spark, sf_dir)
    at = lambda c: n.select("graph", F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    gold = e.join(at("src"), ["graph", "src"]).join(at("dst"), ["graph", "dst"]).where("src_label <> dst_label")
    return gold.select(F.col("graph").alias("answer_id"), F.col("src_label").alias("src"), F.col("dst_label").alias("dst"), "condition", "pos")


@query()
def answer_route_scores(spark, sf_dir):
    gold = _routes(spark, sf_dir).select("answer_id", "src", "dst").distinct()
    return S.score_answers(_prose(spark, sf_dir).withColumnRenamed("text", "answer"), gold)


#: Each route is told by a decision of its own; some in-between lines name another step, some conditions and targets are
#: others' or made up, and half of the answers end with a list of returns.
RETOLD_SQL = f"""{graphs.GRAPH_SQL},
rt AS (SELECT e.graph AS answer_id, a.label AS src, b.label AS dst, condition, e.pos FROM e JOIN n a ON a.graph = e.graph AND a.id = e.src JOIN n b ON b.graph = e.graph AND b.id = e.dst WHERE a.label <> b.label),
ln AS (
  SELECT *, 'Step ' || (pos % 9) AS other, CASE WHEN pos % 7 = 0 THEN 'Step ' || ((pos + 1) % 9) ELSE dst END AS target,
         CASE pos % 6 WHEN 0 THEN 'approved' WHEN 1 THEN 'over 500 K' WHEN 2 THEN 'Not  approved' WHEN 3 THEN '"Over 500"' WHEN 4 THEN '"below zero"' ELSE 'late' END AS said FROM rt),
an AS (
  SELECT answer_id, 'The workflow begins with ' || arg_min(src, pos) || '.' || chr(10)
           || string_agg(CASE WHEN pos % 5 = 0 THEN 'The process moves to ' || src || '.' ELSE (pos % 12 + 1) || '. The process moves to ' || src || '.' END
                || CASE WHEN pos % 4 <> 3 THEN ' A decision is made:' ELSE '' END
                || CASE WHEN pos % 3 = 0 THEN chr(10) || chr(10) || 'The ' || other || ' is informed first.' ELSE '' END
                || chr(10) || '   - If ' || said || ', it moves to ' || target || '.', chr(10) ORDER BY pos)
           || CASE WHEN answer_id % 2 = 0 THEN chr(10) || 'Returns and loops:' || chr(10) || '- ' || arg_max(dst, pos) || ' to ' || arg_max(src, pos) ELSE '' END AS answer,
         string_agg(src || ' to ' || dst || coalesce(' [' || condition || ']', ''), chr(10) ORDER BY pos) AS text
  FROM ln GROUP BY answer_id)"""
PLAIN_SQL = "array_to_string(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'), ' ')"
SAID_SQL = r"""coalesce(nullif(regexp_extract(line, '"([^"]{3,80})"', 1), ''), regexp_extract(line, 'If (.+?),', 1))"""


@query(rf"""WITH {RETOLD_SQL},
lb AS (SELECT answer_id, list(src) || list(dst) AS labels FROM rt GROUP BY answer_id),
sp AS (SELECT answer_id, string_split(answer, chr(10)) AS s FROM an),
l0 AS (SELECT answer_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM sp),
l1 AS (
  SELECT answer_id, i, line, list_filter(regexp_extract_all(line, 'Step (?:A|\d+)'), lambda x: list_contains(labels, x)) AS named, contains(line, 'begins with') AS lead,
         contains(line, 'begins with') OR regexp_matches(line, '^\d+\.') AS head, regexp_matches(line, '^\s*-') AS bullet, starts_with(line, 'Returns') AS returns, contains(line, 'A decision is made') AS decides
  FROM l0 JOIN lb USING (answer_id) WHERE trim(line) <> ''),
l2 AS (
  SELECT *, nullif(last_value(CASE WHEN returns THEN '' WHEN len(named) > 0 AND (head OR NOT bullet) THEN named[-1] END IGNORE NULLS) OVER w, '') AS walk,
         last_value(CASE WHEN head AND len(named) > 0 THEN named[-1] END IGNORE NULLS) OVER w AS step,
         coalesce(last_value(CASE WHEN head THEN decides END IGNORE NULLS) OVER w, false) AS deciding
  FROM l1 WINDOW w AS (PARTITION BY answer_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (
  SELECT DISTINCT answer_id, p[1] AS src, p[2] AS dst FROM (
    SELECT answer_id, unnest(list_transform(range(1, len(named)), lambda k: [named[k], named[k + 1]])) AS p FROM l2 WHERE NOT returns
    UNION ALL SELECT answer_id, [walk, named[1]] FROM l2 WHERE NOT returns AND NOT lead AND len(named) > 0 AND walk IS NOT NULL)
  WHERE p[1] <> p[2]),
go AS (SELECT DISTINCT answer_id, src, dst FROM rt),
g AS (SELECT answer_id, count(*) AS gold, count(st.src) AS covered FROM go LEFT JOIN st USING (answer_id, src, dst) GROUP BY answer_id),
x AS (SELECT answer_id, count(*) AS asserted FROM st ANTI JOIN go USING (answer_id, src, dst) GROUP BY answer_id),
q AS (SELECT answer_id, text, unnest(regexp_extract_all(answer, '"([^"]{{3,80}})"', 1)) AS quote FROM an),
qc AS (SELECT answer_id, count(*) AS quotes FROM q WHERE NOT contains({PLAIN_SQL.format('text')}, {PLAIN_SQL.format('quote')}) GROUP BY answer_id),
lv AS (SELECT answer_id, src, count(*) AS n FROM rt GROUP BY answer_id, src),
d AS (SELECT answer_id, CASE WHEN len(named) > 0 THEN named[-1] ELSE step END AS src FROM l2 WHERE decides),
dc AS (SELECT answer_id, count(*) AS decisions FROM d LEFT JOIN lv USING (answer_id, src) WHERE d.src IS NOT NULL AND coalesce(n, 0) < 2 GROUP BY answer_id),
b AS (SELECT * FROM l2 WHERE bullet AND NOT head AND deciding AND step IS NOT NULL),
wc AS (SELECT answer_id, count(*) AS wrong FROM b WHERE len(named) > 0 AND NOT EXISTS (SELECT 1 FROM go WHERE go.answer_id = b.answer_id AND go.src = b.step AND go.dst = b.named[1]) GROUP BY answer_id),
bs AS (SELECT answer_id, i, step, {PLAIN_SQL.format(SAID_SQL)} AS said FROM b),
bk AS (
  SELECT bs.answer_id, bs.i, bool_or(rt.src = bs.step) AS own
  FROM bs JOIN rt ON rt.answer_id = bs.answer_id AND coalesce(rt.condition, '') <> '' AND (contains({PLAIN_SQL.format('rt.condition')}, said) OR contains(said, {PLAIN_SQL.format('rt.condition')}))
  WHERE said NOT IN ('', 'approved', 'sent back', 'further action is required') GROUP BY bs.answer_id, bs.i),
bc AS (SELECT answer_id, count(*) AS borrowed FROM bk WHERE NOT own GROUP BY answer_id)
SELECT answer_id, CAST(coalesce(gold, 0) AS INTEGER) AS gold, CAST(coalesce(covered, 0) AS INTEGER) AS covered, round_even(100.0 * covered / gold, 1)::DOUBLE AS pct, CAST(coalesce(asserted, 0) AS INTEGER) AS asserted,
       CAST(coalesce(quotes, 0) AS INTEGER) AS quotes, CAST(coalesce(decisions, 0) AS INTEGER) AS decisions, CAST(coalesce(borrowed, 0) AS INTEGER) AS borrowed, CAST(coalesce(wrong, 0) AS INTEGER) AS wrong
FROM an LEFT JOIN g USING (answer_id) LEFT JOIN x USING (answer_id) LEFT JOIN qc USING (answer_id) LEFT JOIN dc USING (answer_id) LEFT JOIN bc USING (answer_id) LEFT JOIN wc USING (answer_id)""")
def answer_faults(spark, sf_dir):
    """Retold diagrams, their faults counted: see RETOLD_SQL for how they are told."""
    routes, pos = _routes(spark, sf_dir), F.col("pos")
    lit, step = F.lit, lambda n: F.concat(F.lit("Step "), n.cast("string"))
    said = F.element_at(F.array(*[lit(x) for x in ("approved", "over 500 K", "Not  approved", '"Over 500"', '"below zero"', "late")]), (pos % 6 + 1).cast("int"))
    row = F.concat(
        F.when(pos % 5 == 0, lit("")).otherwise(F.concat((pos % 12 + 1).cast("string"), lit(". "))), lit("The process moves to "), "src", lit("."),
        F.when(pos % 4 != 3, lit(" A decision is made:")).otherwise(""), F.when(pos % 3 == 0, F.concat(lit("\n\nThe "), step(pos % 9), lit(" is informed first."))).otherwise(""),
        lit("\n   - If "), said, lit(", it moves to "), F.when(pos % 7 == 0, step((pos + 1) % 9)).otherwise(F.col("dst")), lit("."))
    rows = F.array_sort(F.collect_list(F.struct("pos", row.alias("row"), "src", "dst", F.concat("src", lit(" to "), "dst", F.coalesce(F.concat(lit(" ["), "condition", lit("]")), lit(""))).alias("route"))))
    told = routes.groupBy("answer_id").agg(rows.alias("r"))
    last = F.element_at("r", -1)
    answer = F.concat(lit("The workflow begins with "), F.col("r")[0]["src"], lit(".\n"), F.array_join(F.col("r.row"), "\n"), F.when(F.col("answer_id") % 2 == 0, F.concat(lit("\nReturns and loops:\n- "), last["dst"], lit(" to "), last["src"])).otherwise(""))
    return S.score_answers(told.select("answer_id", answer.alias("answer"), F.array_join(F.col("r.route"), "\n").alias("text")), routes)


@query()
def route_mentions(spark, sf_dir):
    p = _prose(spark, sf_dir)
    told = G.narrative(*graphs.both(spark, sf_dir)).select(F.col("graph").alias("answer_id"), F.col("text").alias("answer"))
    return D.routes_mentioned(p, p.select("answer_id").join(told, "answer_id", "left").select("answer_id", F.coalesce("answer", F.lit("")).alias("answer")))


@query(rf"""WITH RECURSIVE {graphs.GRAPH_SQL}, {graphs.PROSE_SQL},
ss AS (SELECT graph AS doc, text, regexp_extract_all(text, '(?m)^\s+\d+\.\s+(.+)$', 1) AS s FROM pr),
sp AS (SELECT doc, text, 'order' AS type, unnest(s[1:-2]) AS a, unnest(s[2:]) AS b FROM ss),
rt AS (SELECT graph AS doc, text, 'routing' AS type, unnest(regexp_extract_all(text, '(?m)^\s+- (.+?) -> (.+?)(?: \[(.+)\])?$', 1)) AS a, unnest(regexp_extract_all(text, '(?m)^\s+- (.+?) -> (.+?)(?: \[(.+)\])?$', 2)) AS b FROM pr),
al AS (SELECT DISTINCT * FROM (SELECT * FROM sp UNION ALL SELECT * FROM rt) WHERE length(a) > 2 AND length(b) > 2 AND lower(a) NOT IN ('yes', 'no', 'end', 'start') AND lower(b) NOT IN ('yes', 'no', 'end', 'start') AND contains(text, b))
SELECT 'WF-' || doc || '-' || lpad(CAST(row_number() OVER (PARTITION BY doc ORDER BY type, a, b) AS VARCHAR), 2, '0') AS id, doc,
       CASE type WHEN 'order' THEN 'Who comes after ' || a || '?' ELSE 'Where does ' || a || ' go next?' END AS question, b AS target, type FROM al""")
def workflow_question_set(spark, sf_dir):
    return D.workflow_questions(_prose(spark, sf_dir).select(F.col("answer_id").alias("doc"), "text"))


@query("SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 25")
def seeded_sample(spark, sf_dir):
    return D.seeded_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), 25, 7, "doc_id")
