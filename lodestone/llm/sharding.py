"""Sharding by extendible hashing under a byte limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.plans.scratch import materialize
from lodestone.plans.sizes import broadcast_if_small

BITS = 60
#: Bits by which a round looks deeper into oversized buckets.
STEP = 10
SHARD_BYTES = 256 << 20


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key's text; a null key is empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(doc_id, h, bytes, row, depth, prefix, shard_bytes) for rows (doc_id, h, bytes, row).

    A bucket is the rows whose hash begins with the ``depth`` bits of ``prefix``. Starting from one
    bucket of all rows, only buckets above ``limit`` bytes are split on their next bit; those whose
    rows have one hash cannot be. A round sums bytes by hash prefix STEP bits below the oversized
    buckets (combined map-side), derives the sums of the levels between from these, and settles
    every row whose bucket fits. No bucket's rows meet in a task, and the driver sees only whether
    any bucket is left.
    """
    done: DataFrame | None = None
    pending = rows
    for base in range(0, BITS, STEP):
        low = BITS - base - STEP
        fine = pending.groupBy(F.shiftright("h", low).alias("fine")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("first"), F.max("h").alias("last"))
        fine = materialize(fine, "prefixes")
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(base + STEP))))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(fine, {base + STEP} - depth)"))
        node = Window.partitionBy("depth", "prefix")  # 2 ** STEP rows at most
        levels = levels.withColumn("shard_bytes", F.sum("bytes").over(node)).withColumn("single", F.min("first").over(node) == F.max("last").over(node))
        leaf = levels.where((F.col("shard_bytes") <= limit) | F.col("single"))
        leaf = leaf.groupBy("fine").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
        joined = materialize(pending.withColumn("fine", F.shiftright("h", low)).join(broadcast_if_small(leaf), "fine", "left").select("doc_id", "h", "bytes", "row", "leaf.depth", "leaf.prefix", "leaf.shard_bytes"), "shards")
        settled = joined.where("depth is not null")
        done = settled if done is None else done.unionByName(settled)
        pending = joined.where("depth is null").select("doc_id", "h", "bytes", "row")
        if pending.isEmpty():
            break
    return done


def shard(docs: DataFrame, *, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, bytes (of the text in UTF-8), shard, depth, shard_bytes.

    Every shard holds ``limit`` bytes at most, but for a single document that is larger. ``shard`` is
    the bucket's hash prefix in binary, a colon and a page. The page is 0 unless rows of one hash
    (repeats of an id) together exceed the limit; these are dealt to parts of about the limit, so
    that no task has all of them, and fill the pages (part.page) of a part in order. Null texts have no
    bytes; a null id hashes like empty text; other columns are ignored; an empty table gives an empty
    result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), hash_bits(F.col(id_col)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    out = directory(materialize(rows, "keys"), limit)
    name = F.lpad(F.bin("prefix"), F.col("depth"), "0")
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(name)
    fits = out.where(F.col("shard_bytes") <= limit).select("doc_id", "bytes", F.concat(name, F.lit(":0")).alias("shard"), "depth", "shard_bytes")
    # rows of one hash are dealt to parts of about the limit, and each part is cut to pages on its own
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("shard_bytes") / F.lit(limit)).cast("long"))
    paged = out.where(F.col("shard_bytes") > limit).withColumn("part", part)
    same = Window.partitionBy("h", "part")
    order = same.orderBy("bytes", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    paged = paged.withColumn("most", F.max("bytes").over(same)).withColumn("before", F.coalesce(F.sum("bytes").over(order), F.lit(0))).withColumn("n", F.row_number().over(same.orderBy("bytes", "doc_id", "row")) - 1)
    page = F.when(2 * F.col("most") > limit, F.col("n").cast("long")).otherwise(F.floor(F.col("before") / (F.lit(limit) - F.col("most"))))
    paged = paged.withColumn("page", page).withColumn("shard_bytes", F.sum("bytes").over(Window.partitionBy("h", "part", "page")))
    paged = paged.select("doc_id", "bytes", F.concat(name, F.lit(":"), F.col("part").cast("string"), F.lit("."), F.col("page").cast("string")).alias("shard"), "depth", "shard_bytes")
    return fits.unionByName(paged)
