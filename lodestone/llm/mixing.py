"""Mixing sources to target weights by hierarchical budgets; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.text import WORD, fresh
from lodestone.plans.scratch import materialize

LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of the seeded order by which a leaf is cut to buckets (256), and how often the one
#: bucket where the budget ends is cut again.
DIGITS = 2
ROUNDS = 2


def domain_of(source: Column) -> Column:
    """The domain of a source: by the last character of its name, one of four."""
    return F.concat(F.lit("domain"), (F.ascii(F.right(F.coalesce(source, F.lit("")), F.lit(1))) % 4).cast("string"))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    given = weights.get(level, {})
    out = F.lit(1)
    for value, w in given.items():
        out = F.when(F.col(level) == value, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``share``: the parent's ``budget`` by weight, none above ``cap``; what is cut goes to the siblings.

    In order of cap by weight, the first nodes are those that end full: a node is full if its cap is
    at most what a weight is worth after all before it are full.
    """
    family = Window.partitionBy(*parent)
    order = family.orderBy("ratio", name)
    nodes = nodes.where("weight > 0").withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    nodes = nodes.withColumn("caps", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nodes = nodes.withColumn("weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    nodes = nodes.withColumn("full", F.col("ratio") <= (F.col("budget") - F.col("caps")) / F.col("weights"))
    full_caps = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0))
    open_weights = F.sum(F.when(~F.col("full"), F.col("weight"))).over(family)
    nodes = nodes.withColumn("worth", (F.col("budget") - full_caps) / open_weights)
    return nodes.withColumn("share", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("worth") * F.col("weight")))


def budgets(leaves: DataFrame, *, weights: dict[str, dict[str, int]], budget_share: float, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget): how many tokens each leaf gives.

    The root has ``budget_share`` of all tokens. From there down, a node's budget goes to its children
    by weight (1 where none is given), none above ``max_epochs`` times its tokens. A shortage goes to
    siblings first; as a node's own cap is the sum below it, only what no sibling can take has
    gone to the siblings of an ancestor. What lies below a weight of 0 gives nothing and adds to no
    cap, so that its part goes to others as well.
    """
    alive = F.lit(True)
    for level in LEVELS:
        alive = alive & (_weight(level, weights) > 0)
    leaves = leaves.withColumn("usable", F.when(alive, F.col("tokens")).otherwise(F.lit(0)))
    total = leaves.agg(F.sum("tokens").alias("all"))
    above = total.select(F.floor(F.coalesce("all", F.lit(0)) * F.lit(float(budget_share))).cast("double").alias("budget"))
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        nodes = leaves.groupBy(*parent, level).agg((F.sum("usable") * F.lit(int(max_epochs))).alias("cap")).withColumn("weight", _weight(level, weights))
        nodes = nodes.join(above, parent) if parent else nodes.join(F.broadcast(above), F.lit(True))  # one row
        above = _fill(nodes, parent or ["one"], level) if parent else _fill(nodes.withColumn("one", F.lit(1)), ["one"], level)
        above = above.select(*parent, level, F.col("share").alias("budget"))
    return leaves.join(above, list(LEVELS), "left").select(*LEVELS, "tokens", F.floor(F.coalesce("budget", F.lit(0.0)) + F.lit(1e-6)).cast("long").alias("budget"))


def mix(docs: DataFrame, *, weights: dict[str, dict[str, int]], budget_share: float = 0.5, max_epochs: int = 4, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, domain, lang, source, n_tokens, repeats.

    Tokens are words between ASCII white space. A leaf whose budget is e times its tokens and r more
    gives every document e times, and in epoch e the documents that its seeded order puts first,
    while their tokens sum to r or less. The order of an epoch is by MD5 of seed, epoch and doc_id.
    Rows that repeat an id in a leaf come together in the order, and are taken all or none; so are
    rows without an id. Null languages and sources are the leaf of empty text; null texts have no
    tokens; other columns are ignored; an empty table gives an empty result. ``weights`` are whole
    numbers from 0 by level and value; 0 takes nothing.

    A leaf may hold any share of the rows: its tokens are summed by bucket of the order (combined
    map-side), the bucket where the sum passes r is cut to buckets once more, and only what then is
    in such a bucket, about one id in 65 536, is put in order, an id's rows as one.
    """
    empty = F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(lang_col, empty).alias("lang"), F.coalesce(source_col, empty).alias("source"), F.regexp_count(F.coalesce(text_col, empty), F.lit(WORD)).cast("long").alias("n_tokens"))
    rows = materialize(rows.withColumn("domain", domain_of(F.col("source"))), "tokens")
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    given = budgets(leaves, weights=weights, budget_share=budget_share, max_epochs=max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    given = given.withColumn("epoch", epochs).select(*LEVELS, "epoch", (F.col("budget") - F.col("epoch") * F.col("tokens")).alias("rest"))
    given = materialize(given, "budgets")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), empty)).cast("binary"))
    live = materialize(rows.join(given, list(LEVELS)).withColumn("key", key).withColumn("before", F.lit(0).cast("long")), "keyed")
    done: list[DataFrame] = []
    for number in range(ROUNDS):
        cut = live.withColumn("bucket", F.substring("key", number * DIGITS + 1, DIGITS))
        bucket = cut.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("base"))
        above = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        bucket = bucket.withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(above), F.lit(0)))
        bucket = bucket.select(*LEVELS, "bucket", "before", (F.col("before") + F.col("n") <= F.col("rest")).alias("whole"), (F.col("before") <= F.col("rest")).alias("begun"))
        placed = cut.drop("before").join(bucket, [*LEVELS, "bucket"])
        done.append(placed.where(F.col("whole") | ~F.col("begun")).withColumn("taken", F.col("whole")).drop("bucket", "begun", "whole"))
        live = materialize(placed.where(~F.col("whole") & F.col("begun")).drop("bucket", "begun", "whole"), "split")
    by_id = live.groupBy(*LEVELS, "key", F.col("doc_id").alias("_id")).agg(F.sum("n_tokens").alias("n"), F.first("before").alias("_before"), F.first("rest").alias("_rest"))
    order = Window.partitionBy(*LEVELS).orderBy("key", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_id = by_id.withColumn("taken", F.col("_before") + F.sum("n").over(order) <= F.col("_rest")).select(*LEVELS, "key", "_id", "taken")
    by_id = by_id.select(*[F.col(c).alias(f"_{c}") for c in (*LEVELS, "key")], "_id", "taken")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    for c in (*LEVELS, "key"):
        same = same & (F.col(c) == F.col(f"_{c}"))
    out = live.join(by_id, same).select(*live.columns, "taken")
    for part in done:
        out = out.unionByName(part)
    return out.select("doc_id", *LEVELS, "n_tokens", (F.col("epoch") + F.col("taken").cast("long")).alias("repeats"))


def apply_mix(docs: DataFrame, chosen: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as ``chosen`` (a result of :func:`mix` over them) repeats it."""
    doc, lang, source, repeats, epoch = fresh(docs.columns, "_id", "_lang", "_source", "_repeats", "_epoch")
    keys = chosen.where("repeats > 0").groupBy(F.col("doc_id").alias(doc), F.col("lang").alias(lang), F.col("source").alias(source)).agg(F.max("repeats").alias(repeats))
    same = F.col(id_col).eqNullSafe(F.col(doc)) & (F.coalesce(lang_col, F.lit("")) == F.col(lang)) & (F.coalesce(source_col, F.lit("")) == F.col(source))
    joined = docs.join(keys, same).withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(repeats).cast("int"))))
    return joined.select(*docs.columns)
