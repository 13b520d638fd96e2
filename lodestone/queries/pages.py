"""Drawn pages, made from suppliers by rule, and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import display_name, slug
from lodestone.operators import pages as A
from lodestone.operators.geometry import content_box, drawing_kind, polyline, tiles
from lodestone.queries.registry import query
from lodestone.sources.tables import table

#: A page per supplier: 4 to 6 boxes in a column, one of them perhaps a diamond, joined from top to bottom by arrows of two
#: fragments, one perhaps through a junction, one perhaps absent; conditions beside every second arrow.
PAGE_SQL = """pg AS (SELECT s_suppkey AS page, 4 + s_suppkey % 3 AS nb FROM supplier),
bx AS (
  SELECT page, nb, i, page % 2 = 0 AND i = 1 AS diamond, CASE WHEN i = 2 THEN 0 ELSE i END AS named,
         CASE WHEN page % 2 <> 0 OR i = 0 THEN i WHEN i = 1 THEN nb - 1 ELSE i - 1 END AS pos FROM pg, range(0, 6) r(i) WHERE i < nb),
nm AS (SELECT *, 'Step ' || named || ' of page ' || page AS label, row_number() OVER (PARTITION BY page, named ORDER BY pos) AS k FROM bx),
nd AS (
  SELECT page, i, CASE WHEN page % 5 <> 0 THEN 'Approval flow' WHEN i < 2 THEN 'Approval flow 1' ELSE 'Approval flow 2' END AS lane,
         'step_' || named || '_of_page_' || page || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS id, label, CASE WHEN diamond THEN 'decision' ELSE 'step' END AS kind, pos FROM nm),
ar AS (SELECT page, i FROM bx WHERE i < nb - 1 AND NOT (page % 5 = 0 AND i = 1)),
ed AS (
  SELECT ar.page, a.lane, a.id AS src, b.id AS dst, CASE WHEN ar.i % 2 = 1 THEN 'Over ' || ar.page || ' K' END AS condition, CASE WHEN ar.page % 4 = 1 AND ar.i = 2 THEN 15.0 ELSE 54.0 END::DOUBLE AS head_margin
  FROM ar JOIN nd a ON a.page = ar.page AND a.i = ar.i JOIN nd b ON b.page = ar.page AND b.i = ar.i + 1)"""


def _point(x, y) -> Column:
    c = lambda v: v.cast("double") if isinstance(v, Column) else F.lit(float(v))
    return F.struct(c(x).alias("x"), c(y).alias("y"))


def _item(op: str, *points: Column) -> Column:
    return F.struct(F.lit(op).alias("op"), F.array(*points).alias("points"))


def drawn(spark, sf_dir):
    """(drawings, spans, pages) in the form that :func:`lodestone.operators.pages.assemble` reads."""
    pg = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("page")).withColumn("nb", F.lit(4) + F.col("page") % 3)
    page, nb, i = F.col("page"), F.col("nb"), F.col("i")
    row = pg.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), nb - 1)))
    y, mid = 100 + 120 * i, 190 + 120 * i
    diamond, absent, through = (page % 2 == 0) & (i == 1), (i == nb - 1) | ((page % 5 == 0) & (i == 1)), (page % 4 == 1) & (i == 2)

    def draw(n, items, filled, x0, y0, x1, y1):
        c = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
        return F.struct((i * 10 + n).alias("draw"), items.alias("items"), F.lit(filled).alias("filled"), c(x0).alias("x0"), c(y0).alias("y0"), c(x1).alias("x1"), c(y1).alias("y1"))

    line = lambda a, b: F.array(_item("l", _point(130, a), _point(130, b)))
    box = F.when(diamond, draw(0, F.array(_item("l", _point(50, y + 35), _point(130, y - 5)), _item("l", _point(130, y - 5), _point(210, y + 35))), True, 50, y - 5, 210, y + 65)).otherwise(draw(0, F.array(_item("re", _point(50, y), _point(210, y + 60))), False, 50, y, 210, y + 60))
    head = draw(1, F.array(_item("l", _point(126, y + 113), _point(130, y + 121))), True, 126, y + 113, 134, y + 121)
    upper = draw(2, F.when(through, line(y + 60, mid - 15)).otherwise(line(y + 60, mid)), False, 130, y + 60, 130, mid)
    lower = draw(3, F.when(through, line(mid + 15, y + 120)).otherwise(line(mid, y + 120)), False, 130, mid, 130, y + 120)
    joint = draw(4, F.array(_item("l", _point(110, mid), _point(130, mid - 20))), True, 110, mid - 20, 150, mid + 20)
    arrows = F.array(head, upper, lower)
    drawings = row.withColumn("d", F.explode(F.concat(F.array(box), F.when(absent, F.slice(arrows, 1, 0)).when(through, F.array_append(arrows, joint)).otherwise(arrows))))
    drawings = drawings.select("page", "d.*")

    def span(n, text, size, x0, y0, w):
        c = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
        return F.struct((i * 10 + n).alias("span"), text.alias("text"), F.lit(size).alias("size"), c(x0).alias("x0"), c(y0).alias("y0"), c(x0 + w).alias("x1"), (c(y0) + 10).alias("y1"))

    s = lambda v: v.cast("string")
    inside = F.array(span(0, F.concat(F.lit("Step "), s(F.when(i == 2, F.lit(0).cast("long")).otherwise(i))), 10.0, 60, y + 10, 80), span(1, F.concat(F.lit(" of page "), s(page)), 10.0, 60, y + 24, 80))
    beside = F.when(~absent & (i % 2 == 1), F.array(span(2, F.concat(F.lit("Over "), s(page), F.lit(" K")), 10.0, 150, mid - 5, 60))).otherwise(F.slice(inside, 1, 0))
    edge = F.when(i == 0, F.concat(F.array(span(3, F.concat(F.lit("Flow "), s(page)), 16.0, 500, F.lit(20), 100), span(4, F.concat(F.lit("Rev. 2 page "), s(page)), 8.0, 50, F.lit(980), 100)), F.when(page % 3 == 0, F.array(span(5, F.lit("stray 5 M"), 10.0, 900, F.lit(600), 50))).otherwise(F.slice(inside, 1, 0)))).otherwise(F.slice(inside, 1, 0))
    spans = row.withColumn("s", F.explode(F.concat(inside, beside, edge))).select("page", "s.*")
    pages = pg.select("page", F.lit(1000.0).alias("height"), F.when(page % 2 == 0, F.concat(F.lit("Hint "), s(page))).alias("title_hint"))
    return drawings, spans, pages


@query(f"WITH {PAGE_SQL} SELECT page, lane, id, label, kind, pos FROM nd")
def page_graph_nodes(spark, sf_dir):
    return A.assemble(*drawn(spark, sf_dir)).nodes


@query(f"WITH {PAGE_SQL} SELECT page, lane, src, dst, condition, head_margin FROM ed")
def page_graph_edges(spark, sf_dir):
    return A.assemble(*drawn(spark, sf_dir)).edges.drop("pos")


@query(f"""WITH {PAGE_SQL}, n AS (SELECT page, count(*) FILTER (i % 2 = 1) AS conditions FROM ar GROUP BY page),
c AS (SELECT page, 2 * nb + conditions + 2 + CASE WHEN page % 3 = 0 THEN 1 ELSE 0 END AS spans, page % 3 = 0 AS stray FROM pg JOIN n USING (page))
SELECT page, CASE WHEN page % 2 = 0 THEN 'Hint ' ELSE 'Flow ' END || page AS title, 'Rev. 2 page ' || page AS revision, spans, CASE WHEN stray THEN spans - 1 ELSE spans END AS classified,
       round(CASE WHEN stray THEN (spans - 1) / spans ELSE 1.0 END, 4) AS coverage, CASE WHEN stray THEN 'stray 5 M' ELSE '' END AS unclassified, 0 AS blank_labels, CASE WHEN stray THEN '5M' ELSE '' END AS lost_amounts,
       CASE WHEN stray THEN '1 of ' || spans || ' text spans unclassified; amounts not in the graph: 5M' ELSE '' END AS warnings FROM c""")
def page_coverage(spark, sf_dir):
    out = A.assemble(*drawn(spark, sf_dir)).pages
    return out.select("page", "title", "revision", "spans", "classified", "coverage", F.array_join("unclassified", ",").alias("unclassified"), "blank_labels", F.array_join("lost_amounts", ",").alias("lost_amounts"), F.array_join("warnings", "; ").alias("warnings"))


@query(f"""WITH {PAGE_SQL},
t AS (SELECT page, lane, CASE WHEN page % 2 = 0 THEN 'Hint ' ELSE 'Flow ' END || page || ' - ' || lane AS head FROM nd GROUP BY page, lane),
st AS (SELECT page, lane, 'Steps: ' || string_agg(label, '; ' ORDER BY pos) || '.' AS steps FROM nd GROUP BY page, lane),
seq AS (SELECT page, lane, string_agg('  ' || k || '. ' || label, chr(10) ORDER BY k) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY page, lane ORDER BY i) AS k FROM nd) GROUP BY page, lane),
th AS (SELECT DISTINCT e.page, e.lane, e.condition, n.label FROM ed e JOIN nd n ON n.page = e.page AND n.id = e.dst WHERE condition IS NOT NULL)
SELECT t.page, t.lane AS section, starts_with(head, 'Hint') AS hinted, head || chr(10) || 'Approval workflow: ' || t.lane || '.' || chr(10) || chr(10) || steps || chr(10) || chr(10)
       || 'Order of approval, first to last (each one signs after the one before it):' || chr(10) || lines AS opening,
       (SELECT count(*) FROM ed WHERE ed.page = t.page AND ed.lane = t.lane) AS routes
FROM t JOIN st USING (page, lane) JOIN seq USING (page, lane)""")
def page_prose(spark, sf_dir):
    c = A.page_chunks(A.assemble(*drawn(spark, sf_dir)))
    routes = F.size(F.regexp_extract_all("text", F.lit(r"(?m)^  - .* -> "), F.lit(0))).cast("long")
    return c.select("page", "section", F.col("text").startswith("Hint").alias("hinted"), F.regexp_extract("text", r"(?s)^(.*?)\n\nRouting:", 1).alias("opening"), routes.alias("routes"))


_DRAW_SQL = """d AS (SELECT p_partkey, p_partkey % 5 AS form, CAST(10 + (p_partkey * 13) % 120 AS DOUBLE) AS w, CAST(5 + (p_partkey * 7) % 110 AS DOUBLE) AS h, p_partkey % 3 <> 0 AS filled FROM part)"""


def _drawings(spark, sf_dir):
    """Rectangles, lines, both, curves and nothing, filled or not, of many sizes."""
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select("p_partkey", (k % 5).alias("form"), (10 + (k * 13) % 120).cast("double").alias("w"), (5 + (k * 7) % 110).cast("double").alias("h"), (k % 3 != 0).alias("filled"))
    w, h, form = F.col("w"), F.col("h"), F.col("form")
    rect, line = _item("re", _point(0, 0), _point(w, h)), _item("l", _point(0, 0), _point(w, h))
    curve = _item("c", _point(1, 2), _point(0, h), _point(w, 0), _point(w, h))
    quad = _item("qu", _point(3, 4), _point(w, 0), _point(0, h), _point(w, h))
    none = F.slice(F.array(rect), 1, 0)
    return d.withColumn("items", F.when(form == 0, F.array(rect)).when(form == 1, F.array(line)).when(form == 2, F.array(rect, line)).when(form == 3, F.array(line, curve, quad)).otherwise(none))


@query(f"""WITH {_DRAW_SQL}
SELECT p_partkey, CASE WHEN form IN (0, 2) AND w >= 20 AND h >= 15 THEN 'node' WHEN filled AND form IN (1, 3, 4) AND greatest(w, h) <= 25 THEN 'arrowhead'
  WHEN filled AND form IN (1, 3) THEN CASE WHEN least(w, h) >= 70 THEN 'diamond' ELSE 'junction' END WHEN form IN (1, 2, 3) THEN 'connector' ELSE 'other' END AS kind,
  CASE form WHEN 1 THEN '0,0;' || CAST(w AS INTEGER) || ',' || CAST(h AS INTEGER) WHEN 2 THEN '0,0;' || CAST(w AS INTEGER) || ',' || CAST(h AS INTEGER)
    WHEN 3 THEN '0,0;' || CAST(w AS INTEGER) || ',' || CAST(h AS INTEGER) || ';1,2;' || CAST(w AS INTEGER) || ',' || CAST(h AS INTEGER) || ';3,4;' || CAST(w AS INTEGER) || ',' || CAST(h AS INTEGER) ELSE '' END AS points FROM d""")
def drawing_kinds(spark, sf_dir):
    d = _drawings(spark, sf_dir)
    n = lambda v: v.cast("int").cast("string")
    points = F.array_join(F.transform(polyline(F.col("items")), lambda p: F.concat_ws(",", n(p["x"]), n(p["y"]))), ";")
    return d.select("p_partkey", drawing_kind(F.col("items"), F.col("filled"), F.col("w"), F.col("h")).alias("kind"), points.alias("points"))


@query("""WITH s AS (SELECT c_nationkey AS page, c_custkey, 'Step ' || (c_custkey % 4) AS label FROM customer)
SELECT page, c_custkey, replace(lower(label), ' ', '_') || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY page, label ORDER BY c_custkey) AS k FROM s)""")
def unique_node_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), "c_custkey", F.concat(F.lit("Step "), (F.col("c_custkey") % 4).cast("string")).alias("label"))
    return A.unique_ids(c.withColumn("slug", slug(F.col("label"))), "page", "c_custkey").select("page", "c_custkey", "id")


@query(r"""SELECT page_id, trim(regexp_replace(replace(regexp_replace('PCN0' || (page_id % 10) || '_' || regexp_replace(url, '^.*/', '') || '.PDF', '\.pdf$', '', 'i'), '_', ' '), '^([PM])([A-Z]{2,3})(\d{2})\b', '\1-\2-\3')) AS shown FROM pages""")
def display_names(spark, sf_dir):
    name = F.concat(F.lit("PCN0"), (F.col("page_id") % 10).cast("string"), F.lit("_"), F.regexp_replace("url", "^.*/", ""), F.lit(".PDF"))
    return table(spark, sf_dir, "pages").select("page_id", display_name(name).alias("shown"))


#: A page's boxes, its box within the page 600 x 800, and tiles of 200 that keep to gutters.
TILE_SQL = """b AS (SELECT p_partkey // 6 AS page, CAST((p_partkey * 41) % 600 AS DOUBLE) AS x0, CAST((p_partkey * 59) % 800 AS DOUBLE) AS y0 FROM part),
r AS (SELECT *, x0 + 60 AS x1, y0 + 40 AS y1 FROM b),
c AS (SELECT page, greatest(min(x0) - 10, 0) AS x0, greatest(min(y0) - 10, 0) AS y0, least(max(x1) + 10, 640) AS x1, least(max(y1) + 10, 820) AS y1 FROM r GROUP BY page),
ax AS (SELECT page, 'x' AS axis, x0 AS lo, x1 AS hi FROM c UNION ALL SELECT page, 'y', y0, y1 FROM c),
iv AS (SELECT page, 'x' AS axis, x0 AS a, x1 AS b FROM r UNION ALL SELECT page, 'y', y0, y1 FROM r),
gp AS (SELECT *, max(b) OVER (PARTITION BY page, axis ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM iv),
gu AS (SELECT gp.page, gp.axis, (a + e) / 2 AS g FROM gp JOIN ax ON ax.page = gp.page AND ax.axis = gp.axis WHERE a - e >= 8 AND (a + e) / 2 > lo AND (a + e) / 2 < hi),
ex AS (SELECT ax.*, t, 200.0 * pow(1.25, t) AS ext, greatest(ceil((hi - lo) / (200.0 * pow(1.25, t))), 1) AS n FROM ax, range(0, 12) z(t)),
id AS (SELECT ex.*, i, lo + (hi - lo) / n * i AS ideal, (hi - lo) / n AS band FROM ex, range(1, 40) q(i) WHERE i < n),
nr AS (SELECT id.*, (SELECT min(struct_pack(d := abs(g - ideal), g := g)) FROM gu WHERE gu.page = id.page AND gu.axis = id.axis) AS near FROM id),
ct AS (SELECT DISTINCT page, axis, t, CASE WHEN near.d <= band / 2 THEN near.g ELSE ideal END AS cut FROM nr),
en AS (SELECT page, axis, t, lo AS cut FROM ex UNION ALL SELECT page, axis, t, hi FROM ex UNION ALL SELECT * FROM ct),
bd AS (SELECT *, lead(cut) OVER (PARTITION BY page, axis, t ORDER BY cut) AS nxt, row_number() OVER (PARTITION BY page, axis, t ORDER BY cut) - 1 AS k FROM en),
sz AS (SELECT page, t, count(*) FILTER (axis = 'x') AS cx, count(*) FILTER (axis = 'y') AS cy FROM bd WHERE nxt IS NOT NULL GROUP BY page, t),
ok AS (SELECT page, min(t) AS t FROM sz WHERE cx * cy <= 6 GROUP BY page)"""


@query(f"""WITH {TILE_SQL}
SELECT x.page, CAST(y.k AS INTEGER) AS row, CAST(x.k AS INTEGER) AS col, round(greatest(c.x0, x.cut - e), 4) AS x0, round(greatest(c.y0, y.cut - e), 4) AS y0, round(least(c.x1, x.nxt + e), 4) AS x1, round(least(c.y1, y.nxt + e), 4) AS y1
FROM ok JOIN bd x ON x.page = ok.page AND x.t = ok.t AND x.axis = 'x' AND x.nxt IS NOT NULL JOIN bd y ON y.page = ok.page AND y.t = ok.t AND y.axis = 'y' AND y.nxt IS NOT NULL
JOIN c ON c.page = ok.page, LATERAL (SELECT 0.12 * 200.0 * pow(1.25, ok.t) AS e)""")
def page_tiles(spark, sf_dir):
    k = F.col("p_partkey")
    x, y = ((k * 41) % 600).cast("double"), ((k * 59) % 800).cast("double")
    r = table(spark, sf_dir, "part").select(F.floor(k / 6).cast("long").alias("page"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 40).alias("y1"))
    whole = r.select("page").distinct().select("page", *[F.lit(v).alias(c) for c, v in (("px0", 0.0), ("py0", 0.0), ("px1", 640.0), ("py1", 820.0))])
    out = tiles(content_box(r, 10.0, whole), 200.0, most=6, rects=r)
    return out.select("page", "row", "col", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])
