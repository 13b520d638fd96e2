"""Command line: chunk documents, list their headings, search them, and check answers.

    python -m lodestone chunk     --documents D --out O
    python -m lodestone headings  --documents D --out O
    python -m lodestone search    --documents D --questions Q --out O [--vectors V] [--top 6] [--fusion weighted|rrf]
    python -m lodestone validate  --documents D --answers A --out O [--policy flag|block]

Tables are Parquet: documents (doc_id, text), questions (question_id, query), vectors (id, vector), answers (answer_id, answer).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunking, validation
from lodestone.operators.search import Search
from lodestone.sources.files import write_json


def lines_of(docs: DataFrame) -> DataFrame:
    """Layout lines of plain text: ten to a page, one size, none bold."""
    x = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return x.select("doc_id", F.col("idx").cast("long").alias("idx"), F.floor(F.col("idx") / 10).cast("long").alias("page"), "text", F.lit(10.0).alias("size"), F.lit(False).alias("bold"))


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    docs = spark.read.parquet(args.documents)
    if args.command == "chunk":
        return chunking.chunk_documents(lines_of(docs), docs)
    if args.command == "headings":
        return chunking.detect_headings(lines_of(docs)).select("doc_id", "idx", "text", "detector", "number")
    if args.command == "search":
        vectors = spark.read.parquet(args.vectors) if args.vectors else None
        found = Search(docs.withColumnRenamed("doc_id", "id"), spark.read.parquet(args.questions), vectors)
        return found.rrf(args.top) if args.fusion == "rrf" else found.top("weighted", args.top)
    return validation.validate(spark.read.parquet(args.answers), validation.code_whitelist(docs), policy=args.policy)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodestone", description=__doc__.splitlines()[0])
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("chunk", "headings", "search", "validate"):
        one = sub.add_parser(name)
        one.add_argument("--documents", required=True)
        one.add_argument("--out", required=True)
        if name == "search":
            one.add_argument("--questions", required=True)
            one.add_argument("--vectors")
            one.add_argument("--top", type=int, default=6)
            one.add_argument("--fusion", choices=["weighted", "rrf"], default="weighted")
        if name == "validate":
            one.add_argument("--answers", required=True)
            one.add_argument("--policy", choices=["flag", "block"], default="flag")
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    write_json(run(SparkSession.builder.appName("lodestone").getOrCreate(), args), args.out)


if __name__ == "__main__":
    main()
