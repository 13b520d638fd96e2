"""Raw pages as a text source, with a fallback for pages that have no usable text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import text_quality_ok


def strip_tags(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f\x0B]+", " "))


def page_text(pages: DataFrame) -> DataFrame:
    """``pages`` with text and source (native_text or native_text_low_quality)."""
    out = pages.withColumn("text", strip_tags(F.coalesce("html", F.lit(""))))
    return out.withColumn("source", F.when(text_quality_ok(F.col("text")), "native_text").otherwise("native_text_low_quality"))


def layout_lines(spans: DataFrame) -> DataFrame:
    """(doc_id, page, idx, text, size, bold): lines of spans (doc_id, page, line, span, text, size, flags).

    A line's text is that of its spans in a row, its size their largest, and it is bold if one is (bit 4
    of the flags); lines without any character go.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), "")
    bold = F.max(F.col("flags").bitwiseAND(F.lit(16)) != 0)
    out = spans.groupBy("doc_id", "page", F.col("line").alias("idx")).agg(text.alias("text"), F.max("size").alias("size"), bold.alias("bold"))
    return out.where("text <> ''")


def fallback_rates(pages: DataFrame, doc: str = "filename") -> DataFrame:
    """(doc, pages, native, flagged, rate) of pages with ``source``, and the same over all in the row of a null document."""
    flagged = F.col("source") != "native_text"
    by = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), F.count_if(~flagged).alias("native"), F.count_if(flagged).alias("flagged"))
    whole = by.agg(*[F.sum(c).alias(c) for c in ("pages", "native", "flagged")]).select(F.lit(None).cast(by.schema[doc].dataType).alias(doc), "pages", "native", "flagged")
    return by.unionByName(whole).withColumn("rate", F.round(F.col("flagged") / F.col("pages"), 4))


def with_fallback(pages: DataFrame, read: Callable[[str], str], content: str = "html") -> DataFrame:
    """Low-quality pages go through ``read``; a failure leaves the native text and names the error.

    Only these pages reach Python: a UDF inside a condition would run on all of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, sources, errors = [], [], []
            for text, raw in zip(batch["text"], batch[content], strict=True):
                try:
                    texts.append(read(raw))
                    sources.append("ocr_fallback")
                    errors.append(None)
                except Exception as e:  # one page must not end the run
                    texts.append(text)
                    sources.append("ocr_failed")
                    errors.append(str(e))
            yield batch.assign(text=texts, source=sources, ocr_error=errors)

    out = page_text(pages).withColumn("ocr_error", F.lit(None).cast("string"))
    low = out.where(F.col("source") == "native_text_low_quality")
    return out.where(F.col("source") == "native_text").unionByName(low.mapInPandas(run, out.schema))
