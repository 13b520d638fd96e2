"""What is done with the best chunks of each question; scoring itself is in :mod:`lodestone.operators.search`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from lodestone.functions.text import hinted_families, route_families, singular, workflow_intent
from lodestone.plans.sizes import broadcast_if_small

K1, B, FLOOR_SHARE, RRF_K, DENSE_WEIGHT = 1.5, 0.75, 0.25, 60, 0.4


# --- corpus statistics -----------------------------------------------------------------------


def terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term) with repeats: words are put in the singular after they are rows, inside generated code."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.explode(words).alias("word")).select("id", singular(F.col("word")).alias("term"))


def vocabulary(docs: DataFrame, **kw) -> DataFrame:
    return terms(docs, **kw).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def best(scored: DataFrame, score: str, k: int, *ties: Column | str) -> DataFrame:
    """The k best rows of each question, with ``rank`` from 1."""
    order = Window.partitionBy("question_id").orderBy(F.desc(score), *(ties or ("id",)))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def global_rank(rows: DataFrame, score: str, buckets: int = 10_000) -> DataFrame:
    """``rows`` with ``rank``, 1 for the highest score; scores are from -1 to 1.

    A rank is the number of rows in higher buckets and the rank in the own bucket, so that no task
    puts all rows in order.
    """
    keyed = rows.withColumn("_b", F.floor(F.col(score) * buckets).cast("long"))
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    base = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_base"))
    own = F.rank().over(Window.partitionBy("_b").orderBy(F.desc(score)))
    return keyed.join(base, "_b").withColumn("rank", (F.col("_base") + own).cast("int")).drop("_b", "_base")


# --- cutoffs and seats -----------------------------------------------------------------------

def _q() -> WindowSpec:
    return Window.partitionBy("question_id")


def route(candidates: DataFrame, present: DataFrame, family: str = "family", routes: str = "routes") -> DataFrame:
    """Candidates of the routed families, and those without a family; all of them if no routed family is ``present``."""
    known = broadcast_if_small(present.agg(F.collect_set(family).alias("_known")))
    named = candidates.crossJoin(known).withColumn("_named", F.array_intersect(routes, "_known"))
    keep = (F.size("_named") == 0) | F.col(family).isNull() | F.array_contains("_named", F.col(family))
    return named.where(keep).drop("_known", "_named")


def cutoff(ranked: DataFrame, share: float | Column = 0.55, least: int = 3, by: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Rows of at least ``share`` of the first score if ``least`` of them are; else the first ``least``; of each ``by``."""
    every = Window.partitionBy(*by)
    bar = F.first("fused").over(every.orderBy("rank")) * share
    strong = ranked.withColumn("_bar", bar).withColumn("_n", F.count_if(F.col("fused") >= F.col("_bar")).over(every))
    return strong.where(F.when(F.col("_n") >= least, F.col("fused") >= F.col("_bar")).otherwise(F.col("rank") <= least)).drop("_bar", "_n")


def context_budget(ranked: DataFrame, size: Column, budget: int) -> DataFrame:
    """The first rows whose sizes together fit; the first always stays."""
    upto = F.sum(size).over(_q().orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", upto).where((F.col("used") <= budget) | (F.col("rank") == 1))


def mix_floor(scored: DataFrame, k: int, floor: int = 2, rel_floor: float = 0.55, intent: str = "intent") -> DataFrame:
    """The k best of each question; where ``intent`` holds, diagrams and prose keep seats.

    Every population is a list in order of score, of which a first part is seated. Diagrams lack
    ``floor`` seats (a third of k at most), then prose a third of k: who lacks seats moves up its own
    list as far as scores reach ``rel_floor`` of the best, and the other list ends that much earlier.
    So the seats of both lists are two numbers per question, and rows are kept by their place.
    """
    order = [F.desc("fused"), F.desc("bm25"), F.col("id")]
    side = Window.partitionBy("question_id", "is_workflow")
    rows = scored.withColumn("_all", F.row_number().over(_q().orderBy(*order))).withColumn("_own", F.row_number().over(side.orderBy(*order)))
    rows = rows.where((F.col("_all") <= k) | (F.col("_own") <= k))
    best = F.max("fused").over(_q())
    bar = F.when(best > 0, best * rel_floor)
    rows = rows.withColumn("_fits", bar.isNull() | (F.col("fused") >= bar))
    of = lambda when, wf: F.count_if(when & (F.col("is_workflow") == wf)).over(_q())
    first = F.col("_all") <= k
    rows = rows.withColumn("_w", of(first, True)).withColumn("_p", of(first, False)).withColumn("_w_fit", of(F.col("_fits"), True)).withColumn("_p_fit", of(F.col("_fits"), False))
    third = max(1, k // 3)
    up = lambda have, want, fit: F.greatest(F.least(F.lit(want), F.col(fit)) - have, F.lit(0))
    w, p = F.col("_w"), F.col("_p")
    gain = up(w, min(floor, third), "_w_fit")
    w, p = w + gain, F.greatest(p - gain, F.lit(0))
    gain = up(p, third, "_p_fit")
    w, p = F.greatest(w - gain, F.lit(0)), p + gain
    mixed = F.col(intent) & F.lit(floor > 0)
    seated = F.when(mixed, F.col("_own") <= F.when(F.col("is_workflow"), w).otherwise(p)).otherwise(first)
    out = rows.where(seated).withColumn("rank", F.row_number().over(_q().orderBy("_all")))
    return out.select(*scored.columns, "rank")


def hybrid_search(seats: DataFrame, *, k: int = 6, floor: int = 2, min_rel: float = 0.55, min_hits: int = 3) -> DataFrame:
    """Seats and cutoff over the k best of each population (see ``Search.top`` with ``sides``)."""
    return cutoff(mix_floor(seats, k, floor), min_rel, min_hits)


def ask_index(chunks: DataFrame, questions: DataFrame, vectors: DataFrame | None = None, *, fusion: str = "weighted", k: int = 6, route: bool = True, boost: float = 0.15, workflow_boost: float = 0.06, floor: int = 2, min_rel: float = 0.55, min_hits: int = 3) -> DataFrame:
    """The whole search: (question_id, repaired, rank, id, fused, bm25, dense, is_workflow).

    Questions are (question_id, query, and perhaps vector, intent, boost_families). Misspelt words are
    repaired against the words of all chunks; what is asked for is then read from the repaired text:
    families that it spells out narrow the search (``route``), and words for routes and approvals
    (unless ``intent`` says) give diagrams a boost and seats. Families that the question, as it came,
    names or hints at are boosted, all of them; ``boost_families`` takes their place. Channels are
    fused by ``weighted`` scores or by reciprocal ranks (``rrf``), which take no boosts here; seats and
    the cutoff follow.
    """
    from lodestone.operators.search import Search, term_counts
    from lodestone.operators.spelling import repair_queries
    from lodestone.plans.scratch import materialize

    if fusion not in ("weighted", "rrf"):
        raise ValueError(f"unknown fusion: {fusion!r}")
    tokens = materialize(term_counts(chunks, "id", "text"), "terms")  # texts are read once
    counts = tokens.select(F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    words = materialize(counts.groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.tfs").alias("freq"), F.count(F.lit(1)).alias("df")), "vocabulary")
    fixed = repair_queries(questions.select(F.col("question_id").alias("query_id"), "query"), words.select("term", "freq"))
    fixed = fixed.select(F.col("query_id").alias("question_id"), "repaired")
    given = lambda c, otherwise: F.coalesce(F.col(c), otherwise) if c in questions.columns else otherwise
    asked = questions.join(fixed, "question_id").withColumn("boost_families", given("boost_families", hinted_families(F.col("query"))))
    asked = asked.withColumn("intent", given("intent", workflow_intent(F.col("repaired")))).withColumn("routes", route_families(F.col("repaired")))
    asked = materialize(asked.withColumn("query", F.col("repaired")), "asked")
    search = Search(chunks, asked, vectors, tokens=tokens, df=words.select("term", "df"))
    if fusion == "rrf":
        seats = search.rrf(k, sides=True, routed=route)
    else:
        seats = search.top("weighted", k, boosts=[b for b in (("family", boost), ("workflow", workflow_boost)) if b[1]], sides=True, routed=route)
    found = hybrid_search(seats.drop("rank"), k=k, floor=floor, min_rel=min_rel, min_hits=min_hits)
    return found.join(asked.select("question_id", "repaired"), "question_id").select("question_id", "repaired", "rank", "id", "fused", "bm25", "dense", "is_workflow")
