"""Scores of retrieval and of answers against gold."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lodestone.functions.text import refused, refused_with, target_tokens, tokenize
from lodestone.plans.scratch import materialize
from lodestone.plans.sizes import spread


#: Passages that go to all tasks at once.
PASSAGES = 5_000


def gold_pairs(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, id): documents that hold the whole passage, character by character.

    The passages, a stated set, are an automaton (Aho-Corasick) that reads each text once, whatever
    their number. Items without a passage have no gold. Documents stay where they are.
    """
    import ahocorasick

    spark = docs.sparkSession
    held = materialize(items.where("passage <> ''").select("question_id", "passage"), "passages")
    turns = max(1, -(-held.count() // PASSAGES))
    kind, qkind = docs.schema["id"].dataType.simpleString(), items.schema["question_id"].dataType.simpleString()
    out = None
    for turn in range(turns):
        by_text: dict[str, list] = {}
        for r in held.where(F.pmod(F.xxhash64("question_id"), F.lit(turns)) == turn).collect():
            by_text.setdefault(r["passage"], []).append(r["question_id"])
        sent = spark.sparkContext.broadcast(by_text)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for text, ids in sent.value.items():
                machine.add_word(text, (text, ids))
            if not len(machine):
                return
            machine.make_automaton()
            for batch in batches:
                rows, found = [], []
                for i, text in enumerate(batch.column(1)):
                    seen = {t: ids for _, (t, ids) in machine.iter(text.as_py())} if text.is_valid else {}
                    for ids in seen.values():
                        rows += [i] * len(ids)
                        found += ids
                yield pa.RecordBatch.from_arrays([pa.array(found, qtype), batch.column(0).take(pa.array(rows, pa.int64()))], ["question_id", "id"])

        qtype = to_arrow_type(items.schema["question_id"].dataType)
        part = spread(docs.select("id", "text")).mapInArrow(run, f"question_id {qkind}, id {kind}")
        out = part if out is None else out.unionByName(part)
    return out


def answerable(items: DataFrame, doc: str = "doc") -> DataFrame:
    """Items that some document answers."""
    return items.where(~F.col(doc).eqNullSafe("none"))


def paired(first: DataFrame, second: DataFrame, key: str = "id", order: str = "place") -> DataFrame:
    """(key, place, question, question_other): items of both sets, numbered from 1 in the order of the first."""
    other = second.select(key, F.col("question").alias("question_other"))
    both = first.join(other, key).select(key, "question", "question_other", F.col(order).alias("_o"))
    # an evaluation set is a stated set, so one ordered window is small
    return both.withColumn("place", F.row_number().over(Window.orderBy("_o", key))).select(key, "place", "question", "question_other")


def hits(ranked: DataFrame, gold: DataFrame, at: list[int]) -> DataFrame:
    """(question_id, hit_k for each k): is a gold document among the first k? Only questions with gold count."""
    found = ranked.join(gold, ["question_id", "id"], "left_semi").groupBy("question_id").agg(F.min("rank").alias("best"))
    out = gold.select("question_id").distinct().join(found, "question_id", "left")
    return out.select("question_id", *[F.coalesce(F.col("best") <= k, F.lit(False)).alias(f"hit_{k}") for k in at])


def accuracy(hit: DataFrame, at: list[int], *by: str) -> DataFrame:
    cols = [F.count_if(F.col(f"hit_{k}")).alias(f"hits_{k}") for k in at]
    return hit.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *cols)


def verify_items(targets: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc, target, problem): gold documents that are missing, and targets that they do not contain.

    A document's texts are put together in the order of ``page`` and ``place``, if ``docs`` has these, then of the texts.
    """
    text = docs.select(F.col("filename").alias("doc"), F.lower("text").alias("body"), *[c for c in ("page", "place") if c in docs.columns])
    rows = F.array_sort(F.collect_list(F.struct(*[c for c in ("page", "place") if c in text.columns], "body")))  # a document's chunks, in order
    whole = text.groupBy("doc").agg(F.array_join(F.transform(rows, lambda r: r["body"]), "\n").alias("body"))
    out = targets.join(whole, "doc", "left")
    problem = F.when(F.col("body").isNull(), "no such document").when(~F.contains("body", F.lower("target")), "target not in document")
    return out.withColumn("problem", problem).where("problem is not null").select("item_id", "doc", "target", "problem")


# --- outcomes --------------------------------------------------------------------------------


def outcomes(rows: DataFrame) -> DataFrame:
    """``rows`` (id, lang, doc, scoring, targets, answer, docs, reused) with outcome, doc_hit and missed.

    Without a document the right answer is a refusal ('ok', else 'INVENTED'). 'manual' items are not
    scored. Other answers must hold every target; of Arabic ones only what survives translation is
    demanded (codes and figures), and 'n/a' is the outcome if that is nothing. ``doc_hit`` is null
    where nothing was retrieved for the question itself.
    """
    answer = F.lower(F.coalesce("answer", F.lit("")))
    arabic = F.col("lang") == "ar"
    want = F.transform("targets", lambda t: F.struct(t.alias("t"), F.when(arabic, target_tokens(t)).otherwise(F.array(t)).alias("w")))
    want = F.filter(want, lambda x: F.size(x["w"]) > 0)
    missed = F.transform(F.filter(want, lambda x: F.exists(x["w"], lambda w: ~F.contains(answer, F.lower(w)))), lambda x: x["t"])
    none, manual = F.col("doc").eqNullSafe("none"), F.col("scoring").eqNullSafe("manual")
    scored = F.when(F.size(want) == 0, "n/a").when(F.size(missed) == 0, "ok").otherwise("WRONG")
    outcome = F.when(none, F.when(refused(F.col("answer")), "ok").otherwise("INVENTED")).when(manual, "manual").otherwise(scored)
    hit = F.array_contains("docs", F.col("doc"))
    doc_hit = F.when(none, F.lit(None)).when(manual, hit).when(~F.coalesce("reused", F.lit(False)), hit)
    return rows.withColumn("outcome", outcome).withColumn("doc_hit", doc_hit.cast("boolean")).withColumn("missed", F.when(none | manual, F.array().cast("array<string>")).otherwise(missed))


def outcome_rates(rows: DataFrame, *by: str) -> DataFrame:
    """Of :func:`outcomes`: n, ok, scored (no 'manual', no 'n/a'), rate, doc_hits, docs, manual, not_scoreable."""
    scored = F.col("outcome").isin("ok", "WRONG", "INVENTED")
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(scored).alias("scored"), F.count_if("doc_hit").alias("doc_hits"),
        F.count("doc_hit").alias("docs"), F.count_if(F.col("outcome") == "manual").alias("manual"), F.count_if(F.col("outcome") == "n/a").alias("not_scoreable"),
    )
    return out.withColumn("rate", F.round(F.col("ok") / F.nullif(F.col("scored"), F.lit(0)), 4))


def generation_report(rows: DataFrame, refusal: str, *by: str) -> DataFrame:
    """One row (by ``by``) over answers (doc, targets, answer, docs, verdict, cited, seconds).

    Answerable items: retrieved, answered, lucky (answered without the document), blocked (retrieved but
    not answered). Others: refused, and leaked (a form was cited all the same). All: flagged verdicts,
    the slowest answer, and the upper median of seconds.
    """
    none = F.col("doc").eqNullSafe("none")
    answer = F.lower(F.coalesce("answer", F.lit("")))
    retrieved, right = F.array_contains("docs", F.col("doc")), ~F.exists("targets", lambda t: ~F.contains(answer, F.lower(t)))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), n(~none).alias("answerable"), n(~none & retrieved).alias("retrieved"), n(~none & right).alias("answered"), n(~none & right & ~retrieved).alias("lucky"), n(~none & retrieved & ~right).alias("blocked"),
        n(none & refused_with(F.col("answer"), refusal)).alias("refused"), n(none & (F.size("cited") > 0)).alias("leaked"), n(F.col("verdict") != "clean").alias("flagged"), F.max("seconds").alias("slowest"), upper_median("seconds").alias("median"),
    )


def term_overlap(pairs: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
    """``pairs`` with ``shared``, the terms of the query that the text has, sorted, and ``missing``, those it lacks."""
    q, t = F.array_distinct(tokenize(F.col(query))), tokenize(F.col(text))
    return pairs.withColumn("shared", F.array_sort(F.array_intersect(q, t))).withColumn("missing", F.array_sort(F.array_except(q, t)))


def sweep(kept: DataFrame, gold: DataFrame, n: int, settings: list[str], sets: list[list[str]]) -> DataFrame:
    """(*settings, hits, returned, mean_returned, mean_workflow, mean_prose): what the rows of each setting of ``kept`` hit and return.

    ``kept`` is (*settings, question_id, id, is_workflow), ``n`` the number of questions. One pass
    gives all ``sets`` of settings, as grouping sets: what a set leaves out is null, and its means are
    over all the settings that it sums up.
    """
    right = gold.select("question_id", "id").distinct().withColumn("_gold", F.lit(True))
    each = kept.join(right, ["question_id", "id"], "left").groupBy(*settings, "question_id").agg(F.max(F.col("_gold").isNotNull()).alias("hit"), F.count(F.lit(1)).alias("rows"), F.count_if("is_workflow").alias("wf"))
    by = each.groupBy(*settings).agg(F.count_if("hit").alias("hits"), F.sum("rows").alias("rows"), F.sum("wf").alias("wf"))
    sums = by.groupingSets([[F.col(c) for c in s] for s in sets], *settings).agg(F.sum("hits").alias("hits"), F.sum("rows").alias("returned"), F.sum("wf").alias("wf"), F.count(F.lit(1)).alias("of"))
    mean = lambda c: F.round(c / (n * F.col("of")), 4)
    return sums.select(*settings, "hits", "returned", mean(F.col("returned")).alias("mean_returned"), mean(F.col("wf")).alias("mean_workflow"), mean(F.col("returned") - F.col("wf")).alias("mean_prose"))


def confusion(rows: DataFrame, retrieved: Column, right: Column) -> DataFrame:
    """(cell, n): right or wrong answers by whether the gold was retrieved; 'lucky' answers had none."""
    cell = F.when(retrieved & right, "ok").when(~retrieved & right, "lucky").when(retrieved & ~right, "wrong").otherwise("blocked")
    return rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def upper_median(name: str) -> Column:
    """The middle value of a column; of an even number, the upper one. Tasks count different values; no group is gathered row by row."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def coverage(gold: DataFrame, implied: DataFrame, key: list[str]) -> DataFrame:
    """By graph: how many gold edges are covered and missing, and how many implied ones nobody asked for."""
    g, i = gold.select(*key).distinct().withColumn("g", F.lit(1)), implied.select(*key).distinct().withColumn("i", F.lit(1))
    both = g.join(i, key, "full")
    return both.groupBy(key[0]).agg(F.count("g").alias("gold"), F.count_if(F.col("g").isNotNull() & F.col("i").isNotNull()).alias("covered"), F.count_if(F.col("i").isNull()).alias("missing"), F.count_if(F.col("g").isNull()).alias("asserted"))


def hit_flips(before: DataFrame, after: DataFrame, hit: str) -> DataFrame:
    """(question_id, change): questions that one setting answers and the other does not."""
    both = before.select("question_id", F.col(hit).alias("_b")).join(after.select("question_id", F.col(hit).alias("_a")), "question_id")
    return both.where("_a <> _b").select("question_id", F.when(F.col("_a"), "gained").otherwise("lost").alias("change"))


def split_tail(text: Column, heading: str) -> Column:
    """struct(head, tail): a text cut before the first line that is ``heading``; the tail keeps it."""
    at = F.regexp_instr(text, F.lit(rf"(?m)^{heading}"))
    head = F.when(at > 0, F.left(text, at - 1)).otherwise(text)
    return F.struct(head.alias("head"), F.when(at > 0, F.substring(text, at, F.char_length(text))).otherwise(F.lit("")).alias("tail"))


def splice_gate(rows: DataFrame, rebuilt: Column, stored: Column) -> DataFrame:
    """``rows``, if every rebuilt text equals the stored one; else an error before anything is written."""
    wrong = rows.where(~rebuilt.eqNullSafe(stored)).limit(1_000).count()
    if wrong:
        raise ValueError(f"{wrong} or more rebuilt texts differ from what is stored")
    return rows


def worst(rows: DataFrame, key: str, score: Column, n: int) -> DataFrame:
    """(key, least): the n keys with the lowest minimum, ties by key."""
    return rows.groupBy(key).agg(F.min(score).alias("least")).orderBy("least", key).limit(n)


def most_common(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, n): the n most frequent values, ties by value."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)
