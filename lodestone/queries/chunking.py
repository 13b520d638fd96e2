"""Headers, headings, sections and windows over the lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import arabic_share, is_arabic, normal_filename, share_of, text_quality_ok
from lodestone.operators import chunking as C
from lodestone.plans.sizes import broadcast_if_small
from lodestone.functions.tables import register
from lodestone.queries.registry import query
from lodestone.sources.pages import layout_lines as layout_of
from lodestone.sources.tables import table

#: A page has ten lines, the last of which says so; three lines of seven are numbered, by a short cycle, so that lists and
#: repeats occur. All other lines are whole.
LINES_SQL = """l AS (
  SELECT doc_id, generate_subscripts(x, 1) - 1 AS idx, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
n AS (
  SELECT doc_id, idx, idx // 10 AS page,
         CASE WHEN idx % 10 = 9 THEN 'Page ' || (idx // 10 + 1) || ' of ' || doc_id
              WHEN idx % 7 IN (1, 2, 3) THEN (idx % 7) || '. Item ' || raw
              ELSE raw END AS text,
         CASE WHEN idx % 11 = 0 THEN 14.0 ELSE 10.0 END::DOUBLE AS size, idx % 5 = 0 AS bold FROM l)"""
NUMBERED_SQL = r"^(\d{1,2}(?:\.\d{1,2}){0,3}\.?)\s+([A-Z][A-Za-z].{0,78})$"
LONE_SQL = r"^\d{1,2}(?:\.\d{1,2})?\.?\s*[\-–—]?\s*$"
HEADERS_SQL = f"""{LINES_SQL},
pg AS (SELECT doc_id, count(DISTINCT page) AS pages FROM n GROUP BY doc_id),
ks AS (SELECT doc_id, regexp_replace(text, '\\d+', '#', 'g') AS key, count(DISTINCT page) AS n_pages FROM n GROUP BY ALL),
hd AS (SELECT * FROM ks JOIN pg USING (doc_id) WHERE pages >= 3 AND n_pages >= 2 AND n_pages / pages >= 0.4)"""
CANDS_SQL = f"""{HEADERS_SQL},
nx AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY idx) AS next_text FROM n),
md AS (SELECT doc_id, median(size) AS body FROM n GROUP BY doc_id),
c0 AS (
  SELECT nx.*, CASE WHEN size >= body * 1.15 AND length(text) <= 80 THEN 'font_size'
                    WHEN bold AND regexp_matches(text, '{LONE_SQL}') THEN 'lone_number'
                    WHEN length(text) <= 80 AND regexp_matches(text, '{NUMBERED_SQL}') THEN 'numbering' END AS detector,
         CASE WHEN regexp_matches(text, '{NUMBERED_SQL}') THEN regexp_replace(regexp_extract(text, '{NUMBERED_SQL}', 1), '\\.$', '') END AS number,
         NOT bold AND NOT (size >= body * 1.15) AS plain
  FROM nx JOIN md USING (doc_id)
  WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.doc_id = nx.doc_id AND hd.key = regexp_replace(nx.text, '\\d+', '#', 'g'))),
c AS (SELECT * FROM c0 WHERE detector IS NOT NULL)"""
ISLANDS_SQL = f"""{CANDS_SQL},
e AS (SELECT *, plain AND detector = 'numbering' AND number IS NOT NULL AS ok, CASE WHEN regexp_matches(number, '^\\d+$') THEN CAST(number AS INTEGER) END AS v FROM c),
f AS (
  SELECT *, CASE WHEN coalesce(lag(ok) OVER w AND ok AND idx - lag(idx) OVER w <= 2 AND v = lag(v) OVER w + 1, false) THEN 0 ELSE 1 END AS fresh
  FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS island FROM f),
h AS (SELECT *, ok AND count(*) OVER (PARTITION BY doc_id, island) >= 3 AS in_list FROM g)"""
CLAIMS_SQL = f"""{ISLANDS_SQL},
k AS (
  SELECT *, coalesce(NOT in_list AND number IS NOT NULL AND plain AND idx > min(CASE WHEN NOT in_list AND number IS NOT NULL THEN idx END) OVER (PARTITION BY doc_id, number), false) AS duplicate FROM h)"""
RUNON_SQL = f"""{CLAIMS_SQL},
ro AS (
  SELECT *, NOT in_list AND NOT duplicate AND detector = 'numbering' AND plain
    AND NOT regexp_matches(rtrim(regexp_extract(text, '{NUMBERED_SQL}', 2)), '[.:;!?]$')
    AND coalesce(regexp_matches(next_text, '^\\p{{Ll}}'), false) AS run_on FROM k)"""


#: Windows of 1200 characters with 150 of the one before: blocks between blank lines, or their lines, or slices of these.
WINDOW_SQL = r"""bk AS (
  SELECT doc_id, generate_subscripts(x, 1) AS b, unnest(x) AS raw FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\n\s*\n') AS x FROM documents)),
bl AS (SELECT doc_id, b, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS u FROM bk),
un AS (
  SELECT doc_id, b, 1 AS i, u FROM bl WHERE length(u) BETWEEN 1 AND 1200
  UNION ALL SELECT doc_id, b, i, regexp_replace(u, '^\s+|\s+$', '', 'g') FROM (SELECT doc_id, b, generate_subscripts(x, 1) AS i, unnest(x) AS u FROM (SELECT doc_id, b, string_split(u, chr(10)) AS x FROM bl WHERE length(u) > 1200))),
uu AS (SELECT * FROM un WHERE u <> ''),
pt AS (
  SELECT doc_id, b, i, s, substr(u, CAST(s * 1050 + 1 AS BIGINT), CASE WHEN length(u) - s * 1050 > 1200 THEN 1200 ELSE 1000000000 END) AS p
  FROM uu, range(0, 100000) r(s) WHERE s < greatest(1, CAST(ceil((length(u) - 1200) / 1050.0) AS BIGINT) + 1)),
pn AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, i, s) AS k, p FROM pt),
ww(doc_id, k, w, cur) AS (
  SELECT doc_id, k, 0, p FROM pn WHERE k = 1
  UNION ALL
  SELECT pn.doc_id, pn.k, CASE WHEN length(cur) + length(p) + 2 > 1200 THEN w + 1 ELSE w END,
         CASE WHEN length(cur) + length(p) + 2 > 1200 THEN right(cur, 150) || chr(10) || chr(10) || p ELSE cur || chr(10) || chr(10) || p END
  FROM ww JOIN pn ON pn.doc_id = ww.doc_id AND pn.k = ww.k + 1),
wi AS (SELECT doc_id, CAST(w AS INTEGER) AS window, regexp_replace(arg_max(cur, k), '^\s+|\s+$', '', 'g') AS text FROM ww GROUP BY doc_id, w)"""


def layout(spark, sf_dir):
    """Layout lines made from documents by rule; whole texts are dealt by document once, and lines stay where theirs is."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    x = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "raw"))
    i = F.col("idx")
    page = F.floor(i / 10).cast("long")
    text = (
        F.when(i % 10 == 9, F.concat(F.lit("Page "), (page + 1).cast("string"), F.lit(" of "), F.col("doc_id").cast("string")))
        .when((i % 7).isin(1, 2, 3), F.concat((i % 7).cast("string"), F.lit(". Item "), F.col("raw")))
        .otherwise(F.col("raw"))
    )
    return x.select("doc_id", i.cast("long").alias("idx"), page.alias("page"), text.alias("text"), F.when(i % 11 == 0, 14.0).otherwise(10.0).alias("size"), (i % 5 == 0).alias("bold"))


def _claims(spark, sf_dir):
    ls = layout(spark, sf_dir)
    cands = C.heading_candidates(C.drop_running_headers(C.with_next(ls)), C.median_sizes(ls))
    return C.run_ons(C.duplicate_numbers(C.inline_lists(cands)))


@query(f"WITH {HEADERS_SQL} SELECT doc_id, key, n_pages, pages FROM hd")
def running_headers(spark, sf_dir):
    return C.running_headers(layout(spark, sf_dir)).select("doc_id", "key", "n_pages", "pages")


@query(f"WITH {CANDS_SQL} SELECT doc_id, idx, detector, number, plain FROM c")
def heading_candidates(spark, sf_dir):
    ls = layout(spark, sf_dir)
    return C.heading_candidates(C.drop_running_headers(ls), C.median_sizes(ls)).select("doc_id", "idx", "detector", "number", "plain")


@query(f"WITH {ISLANDS_SQL} SELECT doc_id, idx, island, in_list FROM h")
def inline_list_islands(spark, sf_dir):
    ls = layout(spark, sf_dir)
    return C.inline_lists(C.heading_candidates(C.drop_running_headers(ls), C.median_sizes(ls))).select("doc_id", "idx", "island", "in_list")


@query(f"WITH {CLAIMS_SQL} SELECT doc_id, idx, number, duplicate FROM k WHERE number IS NOT NULL")
def duplicate_number_claims(spark, sf_dir):
    return _claims(spark, sf_dir).where("number is not null").select("doc_id", "idx", "number", "duplicate")


@query(f"WITH {RUNON_SQL} SELECT doc_id, idx, run_on FROM ro")
def runon_lead(spark, sf_dir):
    return _claims(spark, sf_dir).select("doc_id", "idx", "run_on")


@query(f"""WITH {RUNON_SQL}, hh AS (SELECT doc_id, idx AS hat FROM ro WHERE NOT in_list AND NOT duplicate AND NOT run_on)
SELECT n.doc_id, n.idx, last_value(hat IGNORE NULLS) OVER (PARTITION BY n.doc_id ORDER BY n.idx) AS heading_idx
FROM n LEFT JOIN hh ON hh.doc_id = n.doc_id AND hh.hat = n.idx""")
def section_forward_fill(spark, sf_dir):
    ls = layout(spark, sf_dir)
    return C.assign_sections(ls, C.stitch(_claims(spark, sf_dir))).select("doc_id", "idx", "heading_idx")


@query(f"""WITH {RUNON_SQL}
SELECT detector, count(*) AS n, count(*) FILTER (in_list) AS demoted_list, count(*) FILTER (duplicate) AS demoted_duplicate, count(*) FILTER (run_on) AS demoted_runon FROM ro GROUP BY detector""")
def heading_stats(spark, sf_dir):
    n = lambda c: F.count_if(c).alias(f"demoted_{c.replace('in_', '').replace('run_on', 'runon')}")
    return _claims(spark, sf_dir).groupBy("detector").agg(F.count(F.lit(1)).alias("n"), n("in_list"), n("duplicate"), n("run_on"))


@query(f"""WITH {RUNON_SQL}, hh AS (SELECT doc_id, idx AS hat, text AS raw_heading FROM ro WHERE NOT in_list AND NOT duplicate AND NOT run_on),
z AS (SELECT n.*, last_value(hat IGNORE NULLS) OVER (PARTITION BY n.doc_id ORDER BY n.idx) AS heading_idx FROM n LEFT JOIN hh ON hh.doc_id = n.doc_id AND hh.hat = n.idx),
s AS (SELECT doc_id, heading_idx, coalesce(string_agg(text, chr(10) ORDER BY idx) FILTER (idx <> coalesce(heading_idx, -1)), '') AS body, count(*) FILTER (idx <> coalesce(heading_idx, -1)) AS n_lines FROM z GROUP BY ALL)
SELECT s.doc_id, heading_idx, raw_heading, md5(body) AS body_md5, n_lines FROM s LEFT JOIN hh ON hh.doc_id = s.doc_id AND hh.hat = s.heading_idx WHERE length(body) >= 30""")
def section_chunks(spark, sf_dir):
    ls = layout(spark, sf_dir)
    return C.sections(ls, C.stitch(_claims(spark, sf_dir))).select("doc_id", "heading_idx", "raw_heading", F.md5("body").alias("body_md5"), "n_lines")


@query()
def fuzzy_section_labels(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select((F.col("doc_id") % 13).cast("int").alias("k"), "doc_id")
    dim = spark.createDataFrame([(i, s) for i, s in enumerate(C.SECTIONS)], "k int, s string")
    cut = F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit(". "), F.expr("overlay(s placing '' from cast(1 + doc_id % length(s) as int) for cast(doc_id % 4 as int))"))
    return C.label_sections(names.join(broadcast_if_small(dim), "k").select(cut.alias("raw_heading")))


@query(f"WITH RECURSIVE {WINDOW_SQL} SELECT * FROM wi WHERE length(text) >= 30")
def window_chunks(spark, sf_dir):
    return C.window_chunks(table(spark, sf_dir, "documents"))


@query(f"WITH RECURSIVE {WINDOW_SQL} SELECT doc_id, \"window\", md5(text) AS text_md5 FROM wi WHERE length(text) >= 30")
def window_table_function(spark, sf_dir):
    """The same windows from SQL: a table function with a lateral join."""
    register(spark)
    return spark.sql("SELECT d.doc_id, w.window, md5(w.text) AS text_md5 FROM {docs} d, LATERAL text_windows(d.text) w", docs=table(spark, sf_dir, "documents"))


SECTIONS_SQL = f"""{RUNON_SQL}, hh AS (SELECT doc_id, idx AS hat, text AS raw_heading FROM ro WHERE NOT in_list AND NOT duplicate AND NOT run_on),
z AS (SELECT n.*, last_value(hat IGNORE NULLS) OVER (PARTITION BY n.doc_id ORDER BY n.idx) AS heading_idx FROM n LEFT JOIN hh ON hh.doc_id = n.doc_id AND hh.hat = n.idx),
s AS (SELECT doc_id, heading_idx, coalesce(string_agg(text, chr(10) ORDER BY idx) FILTER (idx <> coalesce(heading_idx, -1)), '') AS body FROM z GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {SECTIONS_SQL}, {WINDOW_SQL}, few AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hh GROUP BY doc_id HAVING count(*) >= 3)),
cs AS (SELECT s.doc_id, 'section' AS made_by, heading_idx AS place, raw_heading, md5(body) AS text_md5 FROM s LEFT JOIN hh ON hh.doc_id = s.doc_id AND hh.hat = s.heading_idx WHERE length(body) >= 30 AND s.doc_id NOT IN (SELECT doc_id FROM few))
SELECT * FROM cs UNION ALL SELECT doc_id, 'window', "window", NULL, md5(text) FROM wi WHERE length(text) >= 30 AND doc_id IN (SELECT doc_id FROM few)""")
def chunk_documents(spark, sf_dir):
    out = C.chunk_documents(layout(spark, sf_dir), table(spark, sf_dir, "documents"), detect=lambda ls: C.stitch(C.run_ons(C.duplicate_numbers(C.inline_lists(C.heading_candidates(C.drop_running_headers(C.with_next(ls)), C.median_sizes(ls)))))))
    return out.select("doc_id", "made_by", "place", "raw_heading", F.md5("text").alias("text_md5"))


@query("""WITH w AS (SELECT doc_id, idx // 10 AS page, idx AS line, unnest(x) AS text, generate_subscripts(x, 1) AS span FROM (SELECT doc_id, idx, string_split(raw, ' ') AS x FROM (SELECT doc_id, generate_subscripts(y, 1) - 1 AS idx, unnest(y) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS y FROM documents))))
SELECT doc_id, page, line AS idx, md5(string_agg(text, '' ORDER BY span)) AS text_md5, max(CAST(8 + length(text) % 5 AS DOUBLE)) AS size, bool_or(length(text) % 16 = 9) AS bold FROM w GROUP BY doc_id, page, line HAVING string_agg(text, '') <> ''""")
def layout_lines(spark, sf_dir):
    # texts are dealt by document while they are whole: lines of spans are then put together where they lie
    d = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    x = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    w = x.select("doc_id", F.floor(F.col("line") / 10).cast("long").alias("page"), "line", F.posexplode(F.split("raw", " ")).alias("span", "text"))
    n = F.char_length("text")
    # a span's flags have bit 4 set if it is bold
    spans = w.withColumn("size", (8 + n % 5).cast("double")).withColumn("flags", F.when(n % 16 == 9, 16).otherwise(n % 16))
    return layout_of(spans).select("doc_id", "page", "idx", F.md5("text").alias("text_md5"), "size", "bold")


@query("""SELECT lang, source AS section, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (length(text) < 30) AS n_short, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang, source""")
def audit_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang", F.col("source").alias("section")).agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.count_if(F.char_length("text") < 30).alias("n_short"), F.sum(F.char_length("text")).alias("chars"))


@query("""WITH c AS (SELECT user_id AS doc_id, event_type AS section FROM events),
n AS (SELECT count(DISTINCT doc_id) AS docs FROM c), m AS (SELECT section FROM c, n GROUP BY section, docs HAVING count(*) >= 0.6 * docs)
SELECT DISTINCT d.doc_id, m.section FROM (SELECT DISTINCT doc_id FROM c) d, m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = d.doc_id AND c.section = m.section)""")
def missing_common_sections(spark, sf_dir):
    return C.missing_sections(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("section")))


@query("""WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, role FROM conversations), s AS (SELECT doc_id, max(page) AS pages, list(DISTINCT page) FILTER (role <> 'user') AS has FROM p GROUP BY doc_id)
SELECT doc_id, array_to_string(list_sort(list_filter(range(1, pages + 1), lambda x: NOT list_contains(coalesce(has, []), x))), ',') AS empty FROM s""")
def empty_pages(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "role")
    whole = p.groupBy("doc_id").agg(F.max("page").alias("pages"))
    seen = p.withColumn("page", F.when(F.col("role") != "user", F.col("page"))).join(whole, "doc_id")
    return C.empty_pages(seen).select("doc_id", F.array_join("empty", ",").alias("empty"))


_ROUTE_SQL = """p AS (SELECT conv_id AS doc_id, turn AS page, text FROM conversations),
b AS (SELECT doc_id, upper(string_agg(text, chr(10) ORDER BY page)) AS full_text, count(*) AS pages, max(length(trim(text))) < 20 AS scanned FROM p GROUP BY doc_id),
i AS (SELECT *, CAST(contains(full_text, 'TION') AS INTEGER) + CAST(contains(full_text, 'YOU') AS INTEGER) + CAST(contains(full_text, 'PLEASE') AS INTEGER) AS iso FROM b),
r AS (SELECT doc_id, CASE WHEN scanned THEN 'workflow' WHEN iso >= 2 OR pages >= 4 THEN 'process' ELSE 'workflow' END AS kind,
  CASE WHEN scanned THEN 'no extractable text on any page' WHEN iso >= 2 AND pages >= 4 THEN iso || ' ISO sections and ' || pages || ' pages' WHEN iso >= 2 THEN iso || ' ISO sections' WHEN pages >= 4 THEN pages || ' pages' ELSE iso || ' ISO sections, ' || pages || ' page(s)' END AS why, pages, iso AS iso_sections, scanned, ((iso >= 2) <> (pages >= 4)) AND NOT scanned AS signals_disagree FROM i)"""


def _routed(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    marks = sum((F.contains("full", F.lit(m)).cast("int") for m in ("TION", "YOU", "PLEASE")), F.lit(0))
    return C.routing(p, marks)


@query(f"WITH {_ROUTE_SQL} SELECT * FROM r")
def doc_routing(spark, sf_dir):
    return _routed(spark, sf_dir)


@query(f"WITH {_ROUTE_SQL} SELECT kind, count(*) AS n, count(*) FILTER (scanned) AS n_scanned, count(*) FILTER (signals_disagree) AS n_disagree FROM r GROUP BY kind")
def routing_report(spark, sf_dir):
    return _routed(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("scanned").alias("n_scanned"), F.count_if("signals_disagree").alias("n_disagree"))


_MIXED = "text || CASE doc_id % 4 WHEN 0 THEN repeat(' ؟؟ ٣', 50) WHEN 1 THEN repeat(' نموذج العقد', CAST(doc_id % 30 AS INTEGER)) WHEN 2 THEN ' ' || repeat('نعم ', length(text) // 12) ELSE '' END"
_LETTERS = f"regexp_replace({_MIXED}, '[^\\p{{L}}]', '', 'g')".replace("\\\\", "\\")


@query(f"""WITH a AS (SELECT doc_id, length({_LETTERS}) AS n, length(regexp_replace({_LETTERS}, '[^؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]', '', 'g')) AS ar FROM documents)
SELECT doc_id, round(ar / n, 6) AS share, coalesce(ar / n >= 0.2, false) AS arabic FROM a""")
def arabic_texts(spark, sf_dir):
    """Texts with Arabic signs, which count for nothing, or words, which do."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    tail = F.when(k % 4 == 0, F.repeat(F.lit(" ؟؟ ٣"), 50)).when(k % 4 == 1, F.repeat(F.lit(" نموذج العقد"), (k % 30).cast("int"))).when(k % 4 == 2, F.concat(F.lit(" "), F.repeat(F.lit("نعم "), F.floor(F.char_length("text") / 12).cast("int")))).otherwise("")
    text = F.concat("text", tail)
    return d.select("doc_id", F.round(arabic_share(text), 6).alias("share"), is_arabic(text).alias("arabic"))


@query("""SELECT doc_id, coalesce(round(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / nullif(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 0), 6), 0) AS latin_share FROM documents""")
def language_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.round(share_of(F.col("text"), "a-zA-Z"), 6), F.lit(0.0)).alias("latin_share"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1) > 0.4 AS ok FROM documents""")
def text_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text_quality_ok(F.col("text")).alias("ok"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '\.[^.]*$', ''), '[-()]', '', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_') || '.pdf' AS filename FROM pages""")
def normal_filenames(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", normal_filename(F.regexp_replace("url", r"^.*/", "")).alias("filename"))


@query(r"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text FROM pages)
SELECT page_id, length(text) AS n_chars, md5(text) AS text_md5, CASE WHEN length(text) >= 20 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1) > 0.4 THEN 'native_text' ELSE 'native_text_low_quality' END AS source FROM p""")
def page_text(spark, sf_dir):
    from lodestone.sources.pages import page_text as read

    return read(table(spark, sf_dir, "pages")).select("page_id", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5"), "source")
