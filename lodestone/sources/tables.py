"""The library's tables over Parquet folders: chunks, lines, questions, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document; every eighth counts as a diagram."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename"), F.col("source").alias("title"), F.col("lang").alias("section"), F.col("source").alias("family"), (F.col("doc_id") % 8 == 0).alias("is_workflow"), "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, text): the lines of every document, from 0."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, query): the benchmark passages, whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"), F.col("text").alias("passage"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
