"""Exact dedup by a heavy-hitter split of digests; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.text import fresh, no_white
from lodestone.plans.scratch import materialize

#: Counters of the frequent-item summary of a partition, and winners that may be broadcast (about 100 bytes each).
COUNTERS = 8192
WINNERS = 2048
#: Groups below this size stay with the ordinary shuffle.
HEAVY_ROWS = 8


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_cp, digest, row) of every row; the only pass over the texts. ``row`` is a number of the row's own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("n_cp"), F.unhex(F.sha2(no_white(text), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))


def _first() -> Column:
    """Of a group: the row with most code points, then the smallest id, then some row of these."""
    return F.min(F.struct((-F.col("n_cp")).alias("neg"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")))


def heavy_groups(rows: DataFrame) -> DataFrame:
    """At most WINNERS rows (digest, best, group_size), each counted exactly.

    The candidates come from Misra-Gries counters that every task keeps over its own rows and
    that are merged (``approx_top_k`` is the engine's form of the summary: a full table of counters
    is decremented and purged). A 64-bit hash names a candidate; the exact count is by whole digest.
    """
    top = rows.select(F.xxhash64("digest").alias("h")).agg(F.expr(f"approx_top_k(h, {WINNERS}, {COUNTERS})").alias("top"))
    names = top.select(F.explode("top").alias("t")).where(F.col("t.count") >= HEAVY_ROWS).select(F.col("t.item").alias("h"))
    counted = rows.join(F.broadcast(names), F.xxhash64("digest") == F.col("h"), "left_semi").groupBy("digest").agg(_first().alias("best"), F.count(F.lit(1)).alias("group_size"))
    return counted.where(F.col("group_size") >= HEAVY_ROWS)


def resolve(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_cp, digest, row, best, group_size) of every row; ``best`` names the row of the group that stays."""
    rows = materialize(digests(docs, id_col, text_col), "digests")
    winners = materialize(heavy_groups(rows), "winners")
    group = Window.partitionBy("digest")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = light.withColumn("best", _first().over(group)).withColumn("group_size", F.count(F.lit(1)).over(group))
    heavy = rows.join(F.broadcast(winners), "digest")
    columns = ["doc_id", "n_cp", "digest", "row", "best", "group_size"]
    return heavy.select(*columns).unionByName(light.select(*columns))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null is empty, so all empty texts
    are one group. The longest original text stays, then the smallest doc_id (a null id comes
    first). Rows that repeat an id and text are members like others, and one of them stays. Other
    columns of ``docs`` are not read. An empty table gives an empty result.

    Frequent digests (see :func:`heavy_groups`) are resolved map-side against a broadcast of at
    most WINNERS rows; what is left holds no group above about 3.5 / COUNTERS of the rows, and is
    shuffled by digest.
    """
    out = resolve(docs, id_col, text_col)
    return out.select("doc_id", F.col("best.keep_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_unique(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are found again by id. Where an id stands for several rows they are held against length and
    digest too; what then is alike is thinned in two steps, so that not even an id of very many rows
    meets in one task whole.
    """
    found = materialize(resolve(docs, id_col, text_col), "resolved")
    named, held, size, digest, salt, place = fresh(docs.columns, "_id", "_digest", "_size", "_digest_of_text", "_salt", "_n")
    kept = found.where(F.col("row") == F.col("best.keep_row")).select(F.col("doc_id").alias(named), F.col("digest").alias(held), F.col("n_cp").alias(size))
    same = F.col(id_col).eqNullSafe(F.col(named))
    repeated = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return docs.join(kept, same, "left_semi")
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn(digest, F.unhex(F.sha2(no_white(text), 256)))
    out = out.join(kept, same & (F.col(digest) == F.col(held)) & (F.char_length(text) == F.col(size)), "left_semi")
    out = out.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(256)))
    for group in ([digest, salt], [digest]):
        out = out.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(salt))).where(F.col(place) == 1).drop(place)
    return out.select(*docs.columns)
