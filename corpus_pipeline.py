"""A training corpus from ``documents``: five stages, each on all that the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.exact_dedup import keep_unique
from lodestone.llm.langid import keep_identified
from lodestone.llm.mixing import apply_mix, mix
from lodestone.llm.packing import pack
from lodestone.llm.queries import MIX, tokenizer_path
from lodestone.llm.simhash import keep_representatives
from lodestone.plans.scratch import mark, materialize, release


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_unique(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return keep_representatives(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, perhaps not at all."""
    return apply_mix(docs, mix(docs, **MIX))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences; a document that the mix repeats is packed as often."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: A trained network and a tokenizer's ids are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written besides its result goes when that is written."""
    docs, keep = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        made, held = stage(spark, docs, sf_dir), mark()
        docs = materialize(made, name)
        release(keep | (mark() - held))
    return STAGES[-1][1](spark, docs, sf_dir)
