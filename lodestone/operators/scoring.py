"""Answers against the diagrams that they retell: lines as a table, anchors as windows over it, faults as joins.

Answers are (answer_id, answer, and perhaps text, the diagram's); routes are (answer_id, src, dst, condition) by label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

# What tells the kinds of lines apart, what a quotation is, and conditions that every step may have.
LEAD = r"(?i)\bbegins with\b"
STEP = r"^\s*\d+[.)]"
BULLET = r"^\s*[-*•]"
RETURNS = r"(?i)^\s*(returns and loops|send-backs)"
DECISION = r"(?i)a decision is made"
QUOTED = r'"([^"]{3,80})"'
IF = r"^\s*[-*•]\s*If\s+(.+?)\s*,"
COMMON = ("approved", "sent back", "further action is required")


def plain(text: Column) -> Column:
    """Lower-case words of letters and digits, one space between them."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0), " ")


def _plain(text: str | None) -> str:
    return " ".join(re.findall(r"[a-z0-9]+", (text or "").lower()))


def label_hits(line: str, labels: list[str]) -> list[str]:
    """Labels that a line names, in order; longer labels first claim their letters."""
    text, found = _plain(line), []
    free = [True] * len(text)
    for label in sorted({x for x in labels if _plain(x)}, key=lambda x: (-len(x), x)):
        for m in re.finditer(rf"\b{re.escape(_plain(label))}\b", text):
            if free[m.start()]:
                free[m.start() : m.end()] = [False] * (m.end() - m.start())
                found.append((m.start(), label))
    return [label for _, label in sorted(found)]


@F.pandas_udf(ArrayType(StringType()))
def _named(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for lines, labels in batches:
        yield pd.Series([label_hits(line, [] if known is None else list(known)) for line, known in zip(lines, labels, strict=True)], index=lines.index)


def answer_lines(answers: DataFrame, routes: DataFrame) -> DataFrame:
    """(answer_id, line_no, line, named, head, bullet, returns, decides, walk, step): the lines that say something.

    ``named`` are the labels of the answer's routes that a line names. Two anchors are where an answer
    stands before a line. ``walk`` moves with every line that names a label but bullets (a bullet that
    is also a lead moves it), and ends at the heading of a list of returns. ``step`` is the last label of
    the last lead or numbered line that names one. Null answers have no lines.
    """
    labels = routes.select("answer_id", F.explode(F.array("src", "dst")).alias("label")).where("label is not null").groupBy("answer_id").agg(F.collect_set("label").alias("labels"))
    rows = answers.select("answer_id", F.posexplode(F.split("answer", "\n")).alias("line_no", "line")).where(F.col("line").rlike(r"\S"))
    rows = rows.join(labels, "answer_id", "left").withColumn("named", _named("line", "labels")).drop("labels")
    line, names = F.col("line"), F.size("named") > 0
    rows = rows.select("*", line.rlike(LEAD).alias("lead"), line.rlike(STEP).alias("numbered"), line.rlike(BULLET).alias("bullet"), line.rlike(RETURNS).alias("returns"), line.rlike(DECISION).alias("decides"))
    rows = rows.withColumn("head", F.col("lead") | F.col("numbered"))
    at = lambda label: F.struct(label.alias("at"))
    last = F.element_at("named", -1)
    walks = F.when(F.col("returns"), at(F.lit(None).cast("string"))).when(names & (F.col("head") | ~F.col("bullet")), at(last))
    steps = F.when(names & F.col("head"), last)
    before = Window.partitionBy("answer_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "answer_id", "line_no", "line", "named", "lead", "head", "bullet", "returns", "decides",
        F.last(walks, ignorenulls=True).over(before)["at"].alias("walk"),
        F.last(steps, ignorenulls=True).over(before).alias("step"),
        F.coalesce(F.last(F.when(F.col("head"), F.col("decides")), ignorenulls=True).over(before), F.lit(False)).alias("deciding"),
    )


def stated_routes(lines: DataFrame) -> DataFrame:
    """(answer_id, src, dst): labels that follow one another in a line, and the walk and the first label of a line."""
    rows = lines.where(~F.col("returns") & (F.size("named") > 0))
    pair = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    named = F.col("named")
    inside = F.zip_with(F.slice(named, 1, F.size(named) - 1), F.slice(named, 2, F.size(named)), pair)
    onto = F.when(~F.col("lead") & F.col("walk").isNotNull(), F.array(pair(F.col("walk"), named[0]))).otherwise(F.array())
    return rows.select("answer_id", F.explode(F.concat(inside, onto)).alias("p")).select("answer_id", "p.*").where("src <> dst").distinct()


def unsupported_quotes(answers: DataFrame) -> DataFrame:
    """(answer_id, quote): what an answer puts in quotation marks that the diagram's text does not say, as often as it does."""
    quotes = answers.select("answer_id", plain(F.col("text")).alias("body"), F.explode(F.regexp_extract_all("answer", F.lit(QUOTED), 1)).alias("quote"))
    return quotes.where((plain(F.col("quote")) != "") & ~F.contains("body", plain(F.col("quote")))).select("answer_id", "quote")


def false_decisions(lines: DataFrame, routes: DataFrame) -> DataFrame:
    """(answer_id, line_no, label): decisions on a step that fewer than two routes leave."""
    made = lines.where("decides").select("answer_id", "line_no", F.coalesce(F.when(F.size("named") > 0, F.element_at("named", -1)), "step").alias("label")).where("label is not null")
    leaving = routes.groupBy("answer_id", F.col("src").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return made.join(leaving, ["answer_id", "label"], "left").where(F.coalesce("n", F.lit(0)) < 2).select("answer_id", "line_no", "label")


def _branches(lines: DataFrame) -> DataFrame:
    return lines.where("bullet and not head and deciding and step is not null")


def wrong_branches(lines: DataFrame, routes: DataFrame) -> DataFrame:
    """(answer_id, line_no, src, dst): bullets of a decision that lead where its step has no route."""
    said = _branches(lines).where(F.size("named") > 0).select("answer_id", "line_no", F.col("step").alias("src"), F.col("named")[0].alias("dst"))
    return said.join(routes.select("answer_id", "src", "dst").distinct(), ["answer_id", "src", "dst"], "left_anti").select("answer_id", "line_no", "src", "dst")


def borrowed_conditions(lines: DataFrame, routes: DataFrame) -> DataFrame:
    """(answer_id, line_no, src, condition): the first condition of a decision's bullet that only other steps' routes have.

    Conditions are what a bullet quotes, or else what stands between If and a comma. They match if one
    holds the other; those that any step may have (COMMON) are passed over.
    """
    quoted = F.regexp_extract_all("line", F.lit(QUOTED), 1)
    said = F.when(F.size(quoted) > 0, quoted).otherwise(F.regexp_extract_all("line", F.lit(IF), 1))
    each = _branches(lines).select("answer_id", "line_no", "step", F.posexplode(said).alias("place", "condition")).withColumn("said", plain(F.col("condition")))
    each = each.where((F.col("said") != "") & ~F.col("said").isin(*COMMON))
    known = routes.where(F.coalesce("condition", F.lit("")) != "").select("answer_id", "src", plain(F.col("condition")).alias("known")).distinct()
    fits = F.contains("known", F.col("said")) | F.contains("said", F.col("known"))
    met = each.join(known, "answer_id").where(fits).groupBy("answer_id", "line_no", "place", "step").agg(F.max(F.col("src") == F.col("step")).alias("own"), F.first("condition").alias("condition"))
    return met.where("not own").groupBy("answer_id", "line_no").agg(F.min_by(F.struct(F.col("step").alias("src"), F.trim("condition").alias("condition")), "place").alias("b")).select("answer_id", "line_no", "b.*")


COUNTS = ("gold", "covered", "asserted", "quotes", "decisions", "borrowed", "wrong")


def score_answers(answers: DataFrame, routes: DataFrame) -> DataFrame:
    """(answer_id, gold, covered, pct, asserted, quotes, decisions, borrowed, wrong): one row per answer or diagram.

    ``gold`` counts the diagram's different routes, ``covered`` those that the answer states, ``asserted``
    routes that only it states. The last four count quotations that the diagram does not have, decisions
    on steps that do not branch, conditions of other steps and targets without a route. A diagram
    without an answer scores as an empty one; an answer without routes has no ``pct``.
    """
    have = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    answers = answers.select("answer_id", "answer", have(answers, "text"))
    routes = routes.select("answer_id", "src", "dst", have(routes, "condition"))
    lines = answer_lines(answers, routes)
    gold = routes.select("answer_id", "src", "dst").distinct().withColumn("_gold", F.lit(True))
    said = stated_routes(lines).withColumn("_said", F.lit(True))
    met = gold.join(said, ["answer_id", "src", "dst"], "full").select("answer_id", F.explode(F.array_compact(F.array(
        F.when(F.col("_gold"), F.lit("gold")),
        F.when(F.col("_gold") & F.col("_said"), F.lit("covered")),
        F.when(F.col("_gold").isNull(), F.lit("asserted")),
    ))).alias("what"))
    faults = {"quotes": unsupported_quotes(answers), "decisions": false_decisions(lines, routes), "borrowed": borrowed_conditions(lines, routes), "wrong": wrong_branches(lines, routes)}
    found = met
    for name, rows in faults.items():
        found = found.unionByName(rows.select("answer_id", F.lit(name).alias("what")))
    found = found.unionByName(answers.select("answer_id", F.lit("").alias("what")))
    out = found.groupBy("answer_id").agg(*[F.count_if(F.col("what") == c).cast("int").alias(c) for c in COUNTS])
    pct = F.when(F.col("gold") > 0, F.bround(100 * F.col("covered") / F.col("gold"), 1))
    return out.select("answer_id", "gold", "covered", pct.alias("pct"), *COUNTS[2:])
