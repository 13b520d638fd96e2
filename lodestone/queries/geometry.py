"""Rectangles, segments and gaps, made from parts and suppliers by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import geometry as G
from lodestone.functions.tables import register
from lodestone.queries.registry import query
from lodestone.sources.tables import table

SHAPES_SQL = """sp AS (SELECT p_partkey // 40 AS page, p_partkey AS span, CAST((p_partkey * 37) % 500 AS DOUBLE) AS x0, CAST((p_partkey * 53) % 700 AS DOUBLE) AS y0 FROM part),
spans AS (SELECT *, x0 + 40 AS x1, y0 + 12 AS y1 FROM sp),
bx AS (SELECT p_partkey // 40 AS page, p_partkey AS box, CAST((p_partkey * 41) % 500 AS DOUBLE) - 20 AS x0, CAST((p_partkey * 59) % 700 AS DOUBLE) - 10 AS y0 FROM part),
boxes AS (SELECT *, x0 + 160 AS x1, y0 + 90 AS y1 FROM bx)"""
SEG_SQL = "seg AS (SELECT page, span AS conn, x0 AS ax, y0 AS ay, CASE WHEN span % 9 = 0 THEN x0 ELSE CAST((span * 17) % 500 AS DOUBLE) END AS bx, CASE WHEN span % 9 = 0 THEN y0 ELSE CAST((span * 29) % 700 AS DOUBLE) END AS by_ FROM spans)"


def spans(spark, sf_dir):
    k = F.col("p_partkey")
    x, y = ((k * 37) % 500).cast("double"), ((k * 53) % 700).cast("double")
    return table(spark, sf_dir, "part").select(F.floor(k / 40).cast("long").alias("page"), k.cast("long").alias("span"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 12).alias("y1"), F.concat(F.lit("t"), k.cast("string")).alias("text"))


def boxes(spark, sf_dir):
    k = F.col("p_partkey")
    x, y = ((k * 41) % 500).cast("double") - 20, ((k * 59) % 700).cast("double") - 10
    return table(spark, sf_dir, "part").select(F.floor(k / 40).cast("long").alias("page"), k.cast("long").alias("box"), x.alias("x0"), y.alias("y0"), (x + 160).alias("x1"), (y + 90).alias("y1"))


def segments(spark, sf_dir):
    s, k = spans(spark, sf_dir), F.col("span")
    other = lambda a, m, n: F.when(k % 9 == 0, F.col(a)).otherwise(((k * m) % n).cast("double"))
    return s.select("page", k.alias("conn"), F.col("x0").alias("ax"), F.col("y0").alias("ay"), other("x0", 17, 500).alias("bx"), other("y0", 29, 700).alias("by"))


@query(f"""WITH {SHAPES_SQL},
p AS (SELECT s.page, s.span, b.box, round(greatest(least(s.x1, b.x1) - greatest(s.x0, b.x0), 0) * greatest(least(s.y1, b.y1) - greatest(s.y0, b.y0), 0) / ((s.x1 - s.x0) * (s.y1 - s.y0)), 6) AS share FROM spans s JOIN boxes b USING (page)),
r AS (SELECT *, row_number() OVER (PARTITION BY page, span ORDER BY share DESC, box DESC) AS r FROM p WHERE share >= 0.6) SELECT page, span, box, share FROM r WHERE r = 1""")
def overlap_argmax(spark, sf_dir):
    return G.assign_text(spans(spark, sf_dir).select("page", "span", "x0", "y0", "x1", "y1"), boxes(spark, sf_dir))


@query(f"""WITH {SHAPES_SQL}, {SEG_SQL}, c AS (SELECT page, box AS cluster, x0 AS x, y0 AS y FROM boxes),
t AS (SELECT c.*, seg.*, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS l2, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) AS dot FROM c JOIN seg ON seg.page = c.page),
u AS (SELECT *, greatest(0, least(1, dot / nullif(l2, 0))) AS tt FROM t),
d AS (SELECT page, cluster, conn, round(CASE WHEN l2 = 0 THEN abs(x - ax) + abs(y - ay) ELSE sqrt((x - (ax + tt * (bx - ax))) * (x - (ax + tt * (bx - ax))) + (y - (ay + tt * (by_ - ay))) * (y - (ay + tt * (by_ - ay)))) END, 6) AS dist FROM u),
r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(dist) OVER w, 1e9) AS nxt FROM d WINDOW w AS (PARTITION BY page, cluster ORDER BY dist, conn))
SELECT page, cluster, conn, dist FROM r WHERE r = 1 AND (dist <= 70 OR (dist <= 170 AND dist <= nxt * 0.6))""")
def nearest_with_margin(spark, sf_dir):
    c = boxes(spark, sf_dir).select("page", F.col("box").alias("cluster"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    return G.attach_labels(c, segments(spark, sf_dir))


@query(f"""WITH {SHAPES_SQL}, {SEG_SQL},
en AS (SELECT page, conn, 'a' AS e, ax AS x, ay AS y FROM seg UNION ALL SELECT page, conn, 'b', bx, by_ FROM seg),
bd AS (SELECT en.page, conn, e, box, greatest(b.x0 - x, 0, x - b.x1) + greatest(b.y0 - y, 0, y - b.y1) AS d FROM en JOIN boxes b ON b.page = en.page),
nb AS (SELECT *, row_number() OVER (PARTITION BY page, conn, e ORDER BY d, box) AS r FROM bd),
hd AS (SELECT en.page, conn, e, min(abs(h.x1 - x) + abs(h.y1 - y)) AS head FROM en JOIN (SELECT page, x1, y1 FROM spans WHERE span % 3 = 0) h ON h.page = en.page GROUP BY ALL),
ab AS (SELECT nb.page, nb.conn, max(box) FILTER (nb.e = 'a') AS ba, max(box) FILTER (nb.e = 'b') AS bb, max(head) FILTER (nb.e = 'a') AS ha, max(head) FILTER (nb.e = 'b') AS hb
       FROM nb JOIN hd ON hd.page = nb.page AND hd.conn = nb.conn AND hd.e = nb.e WHERE r = 1 AND d <= 30 GROUP BY ALL)
SELECT page, conn, CASE WHEN hb <= ha THEN ba ELSE bb END AS src, CASE WHEN hb <= ha THEN bb ELSE ba END AS dst, round(abs(ha - hb), 1) AS head_margin FROM ab WHERE ba IS NOT NULL AND bb IS NOT NULL AND ba <> bb""")
def directed_connectors(spark, sf_dir):
    heads = spans(spark, sf_dir).where("span % 3 = 0").select("page", F.col("x1").alias("hx"), F.col("y1").alias("hy"))
    return G.direct_edges(segments(spark, sf_dir), boxes(spark, sf_dir), heads)


@query(f"""WITH {SHAPES_SQL}, i AS (SELECT span // 8 AS page, x0 AS a, x0 + 25 AS b FROM spans),
m AS (SELECT *, max(b) OVER (PARTITION BY page ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM i) SELECT page, (a + e) / 2 AS centre FROM m WHERE a - e >= 8""")
def interval_gutters(spark, sf_dir):
    s = spans(spark, sf_dir)
    return G.gutters(s.select(F.floor(F.col("span") / 8).cast("long").alias("page"), F.col("x0").alias("a"), (F.col("x0") + 25).alias("b")))


@query(f"WITH {SHAPES_SQL} SELECT page, min(x0) - 10 AS x0, min(y0) - 10 AS y0, max(x1) + 10 AS x1, max(y1) + 10 AS y1 FROM boxes GROUP BY page")
def content_boxes(spark, sf_dir):
    return G.content_box(boxes(spark, sf_dir))


CLUSTERS_SQL = """WITH s AS (SELECT p_partkey // 24 AS page, p_partkey AS span, p_partkey % 24 % 4 AS col, p_partkey % 24 // 4 AS line FROM part),
c AS (SELECT page, col, line // 3 AS part, string_agg('t' || span, ' ' ORDER BY line) AS text, min(line) AS line, min(col) * 100.0 AS x0, min(line * 14.0 + line // 3 * 40) AS y0, max(col) * 100.0 + 60 AS x1, max(line * 14.0 + line // 3 * 40) + 12 AS y1 FROM s GROUP BY page, col, line // 3)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY y0, x0) - 1 AS INTEGER) AS cluster, text, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM c"""


@query(CLUSTERS_SQL)
def cluster_spans(spark, sf_dir):
    return G.cluster_spans(_wrapped(spark, sf_dir)).drop("size", "spans")


@query(CLUSTERS_SQL)
def cluster_table_function(spark, sf_dir):
    """The same from SQL: a table function that takes a table by page."""
    register(spark)
    return spark.sql("SELECT * FROM span_clusters(TABLE(SELECT * FROM {spans}))", spans=_wrapped(spark, sf_dir))


def _wrapped(spark, sf_dir):
    """Four columns of lines of text; each column has a gap after its third line."""
    k = F.col("p_partkey")
    col, line = k % 24 % 4, F.floor(k % 24 / 4)
    x, y = (col * 100).cast("double"), (line * 14 + F.floor(line / 3) * 40).cast("double")
    return table(spark, sf_dir, "part").select(F.floor(k / 24).cast("long").alias("page"), F.concat(F.lit("t"), k.cast("string")).alias("text"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 12).alias("y1"))
