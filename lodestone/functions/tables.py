"""Table functions for SQL: a text's windows, and a page's clusters of spans, from ``register``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from lodestone.operators.chunking import MIN_CHARS, WINDOW_CHARS, WINDOW_OVERLAP, windows_of
from lodestone.operators.geometry import LINE_PITCH


class TextWindows:
    """text_windows(text [, size [, overlap]]): (window, text) of a text, as :func:`lodestone.operators.chunking.window_chunks`."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.isTable or not isinstance(text.dataType, StringType):
            raise ValueError("text_windows takes a text")
        for name, arg in (("size", size), ("overlap", overlap)):
            if arg is not None and (not arg.isConstantExpression or not isinstance(arg.value, int) or arg.value < 0):
                raise ValueError(f"{name} of text_windows must be a constant whole number")
        size_of = WINDOW_CHARS if size is None else size.value
        if (WINDOW_OVERLAP if overlap is None else overlap.value) >= size_of:
            raise ValueError("the overlap of text_windows must be smaller than the size")
        return AnalyzeResult(StructType([StructField("window", IntegerType()), StructField("text", StringType())]))

    def eval(self, text: str | None, size: int = WINDOW_CHARS, overlap: int = WINDOW_OVERLAP) -> Iterator[tuple]:
        for i, window in enumerate(windows_of(text or "", size, overlap)):
            if len(window) >= MIN_CHARS:
                yield i, window


class SpanClusters:
    """span_clusters(TABLE(spans)): the clusters of each page's spans (page, text, x0, y0, x1, y1), as ``cluster_spans``.

    The function asks for its rows by page, in reading order, itself.
    """

    BOX = ("x0", "y0", "x1", "y1")

    def __init__(self):
        self.page, self.texts = None, []
        self.ends = np.zeros((0, 4))  # the last span of each cluster
        self.boxes = np.zeros((0, 4))

    @staticmethod
    def analyze(spans: AnalyzeArgument) -> AnalyzeResult:
        if not spans.isTable:
            raise ValueError("span_clusters takes a table")
        missing = {"page", "text", *SpanClusters.BOX} - set(spans.dataType.fieldNames())
        if missing:
            raise ValueError(f"span_clusters lacks {', '.join(sorted(missing))}")
        page = StructField("page", spans.dataType["page"].dataType)
        out = StructType([page, StructField("cluster", IntegerType()), StructField("text", StringType()), *[StructField(c, DoubleType()) for c in SpanClusters.BOX]])
        return AnalyzeResult(out, partitionBy=[PartitioningColumn("page")], orderBy=[OrderingColumn("bround(y0, 1)"), OrderingColumn("x0")])

    def eval(self, row: Row) -> None:
        self.page, box = row["page"], np.array([float(row[c]) for c in self.BOX])
        gap, height = box[1] - self.ends[:, 3], self.ends[:, 3] - self.ends[:, 1]
        follows = (gap >= -height) & (gap <= LINE_PITCH * height) & (self.ends[:, 0] < box[2]) & (box[0] < self.ends[:, 2])
        if follows.any():
            at = int(follows.argmax())
            self.texts[at].append(row["text"])
            self.ends[at] = box
            self.boxes[at] = [*np.minimum(self.boxes[at, :2], box[:2]), *np.maximum(self.boxes[at, 2:], box[2:])]
        else:
            self.texts.append([row["text"]])
            self.ends, self.boxes = np.vstack([self.ends, box]), np.vstack([self.boxes, box])

    def terminate(self) -> Iterator[tuple]:
        for i, (texts, box) in enumerate(zip(self.texts, self.boxes.tolist(), strict=True)):
            yield self.page, i, " ".join(t for t in texts if t is not None).strip(), *box


def register(spark: SparkSession) -> None:
    """From now on SQL of this session knows ``text_windows`` and ``span_clusters``."""
    spark.udtf.register("text_windows", udtf(TextWindows))
    spark.udtf.register("span_clusters", udtf(SpanClusters))
