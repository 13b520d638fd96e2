"""A streaming sink that holds every key once, however often a batch is tried, behind a gate that is checked as rows are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources.files import exists

COMMIT = "batch long, rows long"


def _batches(spark: SparkSession, path: str) -> list[int]:
    if not exists(spark, f"{path}/commits"):
        return []
    done = spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{path}/commits")
    return sorted(r.batch for r in done.select("batch").distinct().collect())


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the sink's finished batches, with ``batch``; files of others are not opened."""
    done = _batches(spark, path)
    if not done:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(f"{path}/rows").where(F.col("batch").isin(done))


def put_once(df: DataFrame, batch: int, path: str, key: str, gate: Column | None = None) -> int:
    """Write a batch's rows whose key the sink has not yet; how many.

    Rows go to the batch's own partition, which another try overwrites, and count when the batch's
    commit is there. The gate is counted by an observation of the same pass: if it does not hold for
    every row (null is no), there is an error and no commit. Rows that share a key within a batch are
    one, those with a null key are passed over.
    """
    spark = df.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    before = committed(spark, path, schema).where(F.col("batch") != batch).select(key)
    new = df.where(F.col(key).isNotNull()).dropDuplicates([key]).join(before, key, "left_anti")
    seen = Observation()
    wrong = F.lit(False) if gate is None else ~F.coalesce(gate, F.lit(False))
    new = new.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(wrong).alias("wrong"))
    writer = new.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch").parquet(f"{path}/rows")
    found = seen.get
    if found["wrong"]:
        raise ValueError(f"{found['wrong']} of {found['rows']} rows do not pass the gate")
    spark.createDataFrame([(batch, found["rows"])], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{batch}")
    return found["rows"]


def sink_once(stream: DataFrame, path: str, checkpoint: str, key: str, gate: Column | None = None) -> StreamingQuery:
    """Start a stream that puts what is available into the sink, batch by batch (see :func:`put_once`), and ends."""
    put = lambda df, batch: put_once(df, batch, path, key, gate)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
