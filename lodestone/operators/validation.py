"""Citations, whitelists, and what an answer's sources leave open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.sayings import REFUSAL, VARIANT
from lodestone.functions.text import display_name, form_codes, normal_code, uncited_doc_codes
from lodestone.plans.sizes import broadcast_if_small



def code_whitelist(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(code): every form number of the corpus, once."""
    return texts.select(F.explode(form_codes(F.col(text_col))).alias("code")).distinct()


def doc_code_whitelist(docs: DataFrame, code_col: str = "doc_code") -> DataFrame:
    return docs.where(F.coalesce(code_col, F.lit("")) != "").select(normal_code(F.col(code_col)).alias("code")).distinct()


def validate(answers: DataFrame, whitelist: DataFrame, context: DataFrame | None = None, doc_whitelist: DataFrame | None = None, policy: str = "flag", context_key: str = "answer_id") -> DataFrame:
    """Verdicts on answers (answer_id, answer): cited, unknown, ungrounded, unknown_doc_codes, ok, verdict, display_answer.

    ``context`` is (answer_id, text) of what each answer was built from; null means not checked. Where
    answers share what they were built from, ``context_key`` names a column of theirs that ``context`` has
    in place of answer_id, so that no shared text is repeated by answer. Cited codes meet the whitelist in
    a join, so the whitelist may be of any size.
    """
    rows = answers.withColumn("cited", form_codes(F.col("answer")))
    keys = list(dict.fromkeys(["answer_id", context_key]))
    each = rows.select(*keys, F.posexplode("cited").alias("pos", "code"))
    each = each.join(broadcast_if_small(whitelist.select("code", F.lit(True).alias("known"))), "code", "left")
    if context is not None:
        seen = context.select(context_key, F.explode(form_codes(F.col("text"))).alias("code")).distinct().withColumn("seen", F.lit(True))
        each = each.join(seen, [context_key, "code"], "left")
    else:
        each = each.withColumn("seen", F.lit(True))
    known, seen = F.coalesce("known", F.lit(False)), F.coalesce("seen", F.lit(False))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "code")))), lambda x: x["code"])
    found = each.groupBy("answer_id").agg(listed(~known).alias("unknown"), listed(known & ~seen).alias("ungrounded"))
    none = F.array().cast("array<string>")
    out = rows.join(found, "answer_id", "left").withColumn("unknown", F.coalesce("unknown", none)).withColumn("ungrounded", F.coalesce("ungrounded", none))
    if doc_whitelist is not None:
        codes = out.select("answer_id", F.explode(uncited_doc_codes(F.col("answer"), F.col("cited"))).alias("code")).distinct()
        bad = codes.join(broadcast_if_small(doc_whitelist), "code", "left_anti").groupBy("answer_id").agg(F.array_sort(F.collect_set("code")).alias("unknown_doc_codes"))
        out = out.join(bad, "answer_id", "left").withColumn("unknown_doc_codes", F.coalesce("unknown_doc_codes", none))
    else:
        out = out.withColumn("unknown_doc_codes", none)
    wrong, loose = F.size("unknown") > 0, F.size("ungrounded") > 0
    verdict = F.when(wrong, "blocked" if policy == "block" else "flagged").when(loose, "ungrounded").otherwise("clean")
    head, tail = REFUSAL.split("{}")
    shown = F.when(F.lit(policy == "block") & wrong, F.concat(F.lit(head), F.array_join("unknown", ", "), F.lit(tail))).otherwise(F.col("answer"))
    return out.withColumn("ok", ~wrong).withColumn("verdict", verdict).withColumn("display_answer", shown)


def validator_report(checked: DataFrame) -> DataFrame:
    """One row over validated answers with a column ``type``."""
    n = F.count(F.lit(1))
    unknown = F.array_sort(F.array_distinct(F.flatten(F.collect_set("unknown"))))
    return checked.agg(
        n.alias("n"),
        F.count_if(F.size("cited") > 0).alias("answers_citing_a_form"),
        F.count_if(~F.col("ok")).alias("answers_with_unknown_form"),
        F.coalesce(F.count_if(~F.col("ok")) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("caught_rate"),
        unknown.alias("unknown_forms"),
        F.count_if((F.col("type") == "unanswerable") & (F.size("cited") > 0)).alias("fabricated_on_unanswerable"),
    )


# --- diagrams --------------------------------------------------------------------------------


def readable(graph_nodes: Column) -> Column:
    """Not a graph whose every node has a blank label; no graph is readable."""
    blank = F.forall(graph_nodes, lambda n: F.trim(F.coalesce(n["label"], F.lit(""))) == "")
    return ~F.coalesce((F.size(graph_nodes) > 0) & blank, F.lit(False))


def workflow_gaps(nodes: Column, edges: Column, coverage: Column, warnings: Column) -> Column:
    """What a diagram's own record says is missing: nodes without a route, and text without a place.

    ``coverage`` of zero is incomplete here; the source's truth test would read it as complete.
    """
    ends = F.array_union(F.transform(edges, lambda e: e["from"]), F.transform(edges, lambda e: e["to"]))
    lone = F.transform(F.filter(nodes, lambda n: ~F.array_contains(ends, n["id"])), lambda n: F.coalesce(F.nullif(n["label"], F.lit("")), n["id"]))
    named = F.array_join(F.transform(F.slice(lone, 1, 4), lambda x: F.concat(F.lit("“"), x, F.lit("”"))), ", ")
    more = F.when(F.size(lone) > 4, F.concat(F.lit(" and "), (F.size(lone) - 4).cast("string"), F.lit(" more"))).otherwise("")
    orphans = F.when(F.size(lone) > 0, F.concat(F.size(lone).cast("string"), F.lit(" step(s) with no route in or out: "), named, more))
    said = F.try_element_at(F.filter(F.transform(warnings, lambda w: F.regexp_extract(w, r"^(\d+) of (\d+) text spans unclassified", 0)), lambda w: w != ""), F.lit(1))
    text = F.when(coverage < 1.0, F.coalesce(F.concat(said, F.lit(" on this page")), F.concat(F.lit("only "), F.round(100 * coverage).cast("int").cast("string"), F.lit("% of the page's text could be placed"))))
    return F.array_compact(F.array(orphans, text))


def incomplete_workflows(hits: DataFrame) -> DataFrame:
    """(answer_id, filename, page, section, gaps): hits (answer_id, rank, filename, page, section, gaps) by page.

    ``section`` is null if the page's hits name several.
    """
    by = hits.where(F.size("gaps") > 0).groupBy("answer_id", "filename", "page")
    every = F.transform(F.array_sort(F.collect_list(F.struct("rank", "gaps"))), lambda x: x["gaps"])
    one = F.when(F.countDistinct(F.coalesce("section", F.lit(""))) == 1, F.first("section"))
    return by.agg(one.alias("section"), F.array_distinct(F.flatten(every)).alias("gaps"), F.min("rank").alias("rank"))


def variant_conflicts(hits: DataFrame) -> DataFrame:
    """(answer_id, family, filename, variant, place): documents of families with several among an answer's hits.

    Place 1 is the best ranked. Hits are (answer_id, rank, family, filename, variant).
    """
    named = hits.where(F.coalesce("family", F.lit("")) != "")
    docs = named.groupBy("answer_id", "family", "filename").agg(F.min("rank").alias("rank"), F.min_by("variant", "rank").alias("variant"))
    family = Window.partitionBy("answer_id", "family")
    out = docs.withColumn("n", F.count(F.lit(1)).over(family)).withColumn("place", F.row_number().over(family.orderBy("rank")))
    return out.where("n > 1").select("answer_id", "family", "filename", F.coalesce("variant", "filename").alias("variant"), "place", "n")


def variant_label(variant: Column, family: Column, n: Column) -> Column:
    version, of, count, rest = (F.lit(x) for x in VARIANT)
    return F.concat(version, variant, of, family, count, n.cast("string"), rest)


def source_cards(hits: DataFrame) -> DataFrame:
    """(answer_id, place, filename, shown, sections): a card per document of an answer's hits, in order of its best hit."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", "section"))), lambda x: x["section"])
    by = hits.groupBy("answer_id", "filename").agg(F.min("rank").alias("rank"), F.array_distinct(F.array_compact(rows)).alias("sections"))
    order = Window.partitionBy("answer_id").orderBy("rank", "filename")
    return by.select("answer_id", F.row_number().over(order).alias("place"), "filename", display_name(F.col("filename")).alias("shown"), "sections")


def format_context(hits: DataFrame) -> DataFrame:
    """(answer_id, context): hits (answer_id, rank, filename, section, label, text) in order, with blank lines between."""
    head = F.concat(F.lit("["), F.col("filename"), F.lit(" | "), F.coalesce("section", F.lit("None")), F.lit("]"))
    block = F.concat_ws("\n", head, F.col("label"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("answer_id").agg(F.array_join(F.transform(rows, lambda x: x["block"]), "\n\n").alias("context"))


def family_codes(mentions: DataFrame) -> DataFrame:
    """(doc, code, source): a document's own code, else the most frequent of its text; no F- codes if others, ties by name.

    ``mentions`` is (doc, code, n, from_name).
    """
    order = Window.partitionBy("doc").orderBy(F.desc("from_name"), F.col("code").startswith("F-"), F.desc("n"), "code")
    best = mentions.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.select("doc", "code", F.when(F.col("from_name"), "filename").otherwise("text").alias("source"))
