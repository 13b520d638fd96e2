"""Folders, merges, fallbacks, fingerprints, prompts and gates: what surrounds the searches."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import answering as A
from lodestone.operators import evaluation as E
from lodestone.operators import graph as G
from lodestone.plans.scratch import folder
from lodestone.queries import graphs
from lodestone.queries.registry import query
from lodestone.queries.retrieval import WORKFLOW_SQL
from lodestone.sources import files
from lodestone.sources.pages import with_fallback
from lodestone.sources.tables import table


@query("""SELECT 'lang=' || lang AS folder, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND lang <> 'fr' GROUP BY lang""")
def scanned_folders(spark, sf_dir):
    """Texts as files by language, found again by a scan of the whole tree that leaves out one folder, and sizes from their bytes."""
    home = folder(spark, "tree")
    d = table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    d.select("lang", "text").write.partitionBy("lang").text(home)
    found = files.scan_folder(spark, home, ".TXT", recursive=True, exclude=("lang=fr",))
    return found.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.sum(F.length("content")).cast("long").alias("bytes"))


@query("""WITH a AS (SELECT source AS filename, count(*) AS n, 'first' AS of_ FROM documents WHERE doc_id % 3 = 0 GROUP BY source),
b AS (SELECT source AS filename, count(*) AS n, 'second' AS of_ FROM documents GROUP BY source)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE filename NOT IN (SELECT filename FROM a)""")
def merged_sources(spark, sf_dir):
    """A second set adds only what the first does not have."""
    d = table(spark, sf_dir, "documents")
    by = lambda rows, name: rows.groupBy(F.col("source").alias("filename")).agg(F.count(F.lit(1)).alias("n")).withColumn("of_", F.lit(name))
    return files.merge_append(by(d.where("doc_id % 3 = 0"), "first"), by(d, "second"))


@query(r"""WITH p AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text FROM pages),
q AS (SELECT *, NOT (length(text) >= 20 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1) > 0.4) AS bad FROM p)
SELECT page_id, CASE WHEN NOT bad THEN 'native_text' WHEN contains(html, '<script') THEN 'ocr_failed' ELSE 'ocr_fallback' END AS source, md5(CASE WHEN bad AND NOT contains(html, '<script') THEN md5(html) ELSE text END) AS text_md5 FROM q""")
def fallback_pages(spark, sf_dir):
    """Pages of little text go through a reader, which stands in for one of images and fails on pages with scripts."""

    def read(html: str) -> str:
        if "<script" in html:
            raise ValueError("scripts")
        return hashlib.md5(html.encode()).hexdigest()

    return with_fallback(table(spark, sf_dir, "pages"), read).select("page_id", "source", F.md5("text").alias("text_md5"))


@query("""WITH h AS (SELECT sha256(concat_ws(chr(0), 'model', CAST(doc_id AS VARCHAR), coalesce(text, ''))) AS h FROM documents),
s AS (SELECT sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)::HUGEINT) AS a, sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)::HUGEINT) AS b, count(*) AS n FROM h)
SELECT n, substr(sha256('model|' || a || '|' || b || '|' || n), 1, 16) AS name FROM s""")
def corpus_fingerprint(spark, sf_dir):
    """The name that a corpus and a model have together, whatever the order of rows."""
    d = table(spark, sf_dir, "documents")
    name = files.fingerprint(d, "model", "text", "doc_id")
    return d.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))


def _said(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_JOIN = "concat_ws(chr(10) || chr(10), "


@query(f"""WITH c AS (SELECT conv_id, turn, text AS query, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, turn % 3 = 1 AS several FROM conversations)
SELECT conv_id, turn, md5({_JOIN}{_said("Answer from the context only. " + A.SOURCE_RULE)}, CASE WHEN {WORKFLOW_SQL} THEN {_said(A.WORKFLOW_FORMAT)} END, CASE WHEN several THEN {_said(A.VARIANT_RULE)} END, CASE WHEN regexp_matches(query, '[\\x{{0600}}-\\x{{06FF}}]') THEN {_said(A.ARABIC_RULE)} END, 'Context:' || chr(10) || coalesce(before, ''), 'Question: ' || query)) AS prompt,
       md5({_JOIN}{_said("Go on with the answer; repeat nothing, and say so if nothing is left. " + A.SOURCE_RULE)}, CASE WHEN several THEN {_said(A.VARIANT_RULE)} END, CASE WHEN regexp_matches(query, '[\\x{{0600}}-\\x{{06FF}}]') THEN {_said(A.ARABIC_RULE)} END, 'Context:' || chr(10) || coalesce(before, ''), 'Answer so far:' || chr(10) || 'none', 'Request: ' || query)) AS continued FROM c WHERE query IS NOT NULL""")
def prompt_texts(spark, sf_dir):
    """Prompts of questions and continuations, as text: rules that apply, context, question."""
    c = table(spark, sf_dir, "conversations").withColumn("before", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    q, several = F.col("text"), F.col("turn") % 3 == 1
    return c.where("text is not null").select("conv_id", "turn", F.md5(A.build_prompt(q, F.col("before"), several)).alias("prompt"), F.md5(A.continuation_prompt(q, F.col("before"), F.lit("none"), several)).alias("continued"))


@query(f"""WITH RECURSIVE {graphs.GRAPH_SQL}, {graphs.PROSE_SQL}, ct AS (SELECT *, strpos(text, chr(10) || 'Approval thresholds') AS i FROM pr)
SELECT graph, md5(CASE WHEN i > 0 THEN left(text, i) ELSE text END) AS head, md5(CASE WHEN i > 0 THEN substr(text, i + 1) ELSE '' END) AS tail FROM ct""")
def spliced_texts(spark, sf_dir):
    """Texts cut before their thresholds; the gate lets them pass only if all parts make the stored texts again."""
    prose = G.render_prose(*graphs.both(spark, sf_dir)).withColumn("p", E.split_tail(F.col("text"), "Approval thresholds"))
    return E.splice_gate(prose, F.concat("p.head", "p.tail"), F.col("text")).select("graph", F.md5("p.head").alias("head"), F.md5("p.tail").alias("tail"))
