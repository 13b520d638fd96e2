"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.plans.scratch import materialize

SCALE = 256
#: Queries and candidates of a tile, about, and rows of a block: a dense score array has a block's rows.
QUERIES = 4096
CANDIDATES = 16_384
BLOCK = 4096
#: Scores are 64-bit; one beyond counts as the largest or smallest of these.
LARGEST = (1 << 63) - 1
#: Sums of products up to this size are exact in doubles.
EXACT = float(1 << 53)


def valid(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinity."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(fine, F.lit(False))


def quantized(x: float) -> int:
    """floor(256 * x), whatever the size of x."""
    return int(x) * SCALE if abs(x) >= EXACT else math.floor(SCALE * x)


class Postings:
    """Of a block of candidates, by term (dimension): who has a weight other than zero, and the weight."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.ids, self.vectors = np.asarray(ids, np.int64), vectors
        width = max((len(v) for v in vectors), default=0)
        dense = np.zeros((width, len(vectors)))
        for i, v in enumerate(vectors):
            dense[: len(v), i] = v
        self.heavy = np.abs(dense).max(axis=1, initial=0.0) * SCALE + 1  # by term: no weight is larger
        self.terms: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
        for t in range(width):
            weights = np.floor(dense[t] * SCALE) if self.heavy[t] < EXACT else dense[t]
            rows = np.flatnonzero(weights)
            if len(rows):
                self.terms[t] = (None if len(rows) == len(vectors) else rows, weights[rows])
        self.room = np.empty(len(vectors))

    def scores(self, vector: np.ndarray) -> np.ndarray:
        """One query's scores of all rows: a term's postings, times its weight, are added term by term."""
        width = min(len(vector), len(self.heavy))
        size = np.abs(vector[:width]) * SCALE + 1
        with np.errstate(over="ignore"):
            bound = float(size @ self.heavy[:width]) if width else 0.0
        if not bound < EXACT:
            return self._large(vector)
        out, weights = np.zeros(len(self.ids)), np.floor(vector[:width] * SCALE)
        for t in np.flatnonzero(weights).tolist():
            posting = self.terms.get(t)
            if posting is not None:
                rows, held = posting
                if rows is None:
                    out += np.multiply(held, weights[t], out=self.room)
                else:
                    out[rows] += held * weights[t]
        return out.astype(np.int64)

    def _large(self, vector: np.ndarray) -> np.ndarray:
        """The same in whole numbers of any size, for weights whose sums of products leave doubles."""
        mine = [quantized(x) for x in vector.tolist()]
        sums = (sum(a * quantized(b) for a, b in zip(mine, v.tolist(), strict=False)) for v in self.vectors)
        return np.array([max(-LARGEST, min(LARGEST, s)) for s in sums], np.int64)


class Tile:
    """A group of queries, and of each the k best of the candidates seen so far."""

    def __init__(self, k: int):
        self.k = k
        self.queries: list[tuple[int, int, np.ndarray]] = []
        self.best: list[tuple[np.ndarray, np.ndarray]] = []

    def ask(self, ids: np.ndarray, marks: np.ndarray, vectors: list[np.ndarray]) -> None:
        self.queries += zip(ids.tolist(), marks.tolist(), vectors, strict=True)
        self.best += [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def scan(self, ids: np.ndarray, vectors: list[np.ndarray]) -> None:
        postings, k = Postings(ids, vectors), self.k
        for i, (own, _, vector) in enumerate(self.queries):
            scores, (held, held_scores) = postings.scores(vector), self.best[i]
            here = postings.ids != own
            if len(held) == k:
                here &= scores >= held_scores[-1]
            here = np.flatnonzero(here)
            if not len(here):
                continue
            found = scores[here]
            if len(here) > k:
                bar = np.partition(found, len(found) - k)[len(found) - k]
                here = here[found >= bar]  # with all ties at the bar
            both, both_scores = np.concatenate([held, postings.ids[here]]), np.concatenate([held_scores, scores[here]])
            order = np.lexsort((both, -both_scores))[:k]
            self.best[i] = both[order], both_scores[order]

    def rows(self) -> pa.RecordBatch:
        sizes = [len(ids) for ids, _ in self.best]
        of = lambda c: np.repeat(np.array([q[c] for q in self.queries], np.int64), sizes)
        flat = [np.concatenate(x) for x in zip(*self.best, strict=True)] if self.best else [np.zeros(0, np.int64)] * 2
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (of(0), of(1), *flat)], ["query_id", "mark", "vec_id", "score"])


def top_k(vectors: DataFrame, *, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", queries: int = QUERIES, candidates: int = CANDIDATES, block: int = BLOCK) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows for which ``is_query`` holds; candidates are all rows but those of the query's
    own id. The score is the integer inner product of the components floor(256 * x); a component that
    one vector lacks counts as zero; a score beyond 64 bits counts as the largest or smallest such
    number. Ties go to the smaller vec_id. Vectors that are null, or hold a null, NaN or infinity, take
    no part, nor do rows with a null id. Rows that repeat an id are candidates like others and may all
    be returned; as queries, equal rows ask once and different ones each on their own, with ranks from
    1. All candidates are returned if fewer than k; an empty table gives an empty result; other columns
    are ignored.

    Queries and candidates are dealt to tiles of about ``queries`` times ``candidates``. A tile is
    some rows in a row of one task: its queries, then its candidates, which are read in blocks. What
    leaves a tile is k rows per query; these are merged by query. The driver sees two counts.
    """
    named = vectors.where(F.col(id_col).isNotNull() & valid(F.col(vector_col)))
    kind = vectors.schema[vector_col].dataType.elementType.typeName()
    v = F.col(vector_col) if kind == "float" else F.transform(vector_col, lambda x: x.cast("double"))
    rows = named.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("asks"))
    rows = materialize(rows, "vectors")
    mark = F.xxhash64("v")
    asked = rows.where("asks").select("id", "v").distinct()
    n_queries, n_rows = rows.where("asks").count(), rows.count()
    groups, shares = max(1, -(-n_queries // queries)), max(1, -(-n_rows // candidates))
    spread = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    left = asked.select(F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias("g"), F.explode(spread(shares)).alias("c"), F.lit(0).alias("side"), "id", mark.alias("mark"), "v")
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shares)).cast("int")  # rows of one id are dealt too
    right = rows.select(place.alias("c"), "id", "v").select(F.explode(spread(groups)).alias("g"), "c", F.lit(1).alias("side"), "id", F.lit(0).cast("long").alias("mark"), "v")
    dealt = left.unionByName(right).repartition(groups * shares, "g", "c").sortWithinPartitions("g", "c", "side")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, now = None, None
        for batch in batches:
            g, c, side, ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            column = batch.column(5)
            flat, ends = np.asarray(column.flatten()).astype(np.float64), np.asarray(column.offsets)
            split = np.split(flat, ends[1:-1] - ends[0]) if len(ids) else []
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(c) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if now != (g[a], c[a]):
                    if tile is not None:
                        yield tile.rows()
                    tile, now = Tile(k), (g[a], c[a])
                if side[a] == 0:
                    tile.ask(ids[a:b], marks[a:b], split[a:b])
                else:
                    for at in range(a, b, block):
                        tile.scan(ids[at : min(b, at + block)], split[at : min(b, at + block)])
        if tile is not None:
            yield tile.rows()

    found = dealt.mapInArrow(run, "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
