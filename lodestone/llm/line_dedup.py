"""Line dedup on exact reference counts, gated by sharded cuckoo filters, and reversible."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.cuckoo import CuckooFilter, Full
from lodestone.llm.text import WHITE, parts
from lodestone.plans.scratch import folder, materialize
from lodestone.plans.sizes import broadcast_if_small, spread

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys of a shard, about; a filter of it takes some 200 kB.
SHARD_KEYS = 65_536
#: Pairs of a document and a key that it loses which may be sent to every task; by default they are joined whatever their number.
BROADCAST_KEYS = 0
#: Tables of changes that an index reads before it writes them as one.
CHANGES = 32
#: Filters that are sent to every task at once, some 34 MB; more go in turns.
FILTERS_SENT = 128


def keys_of(lines: list[str], least: int) -> tuple[list[int], list[bytes]]:
    """Which lines have a key of ``least`` code points or more, and the 128-bit hashes of those keys."""
    from xxhash import xxh3_128_digest

    at, keys = [], []
    for i, line in enumerate(lines):
        if len(line) >= least:
            line = line.strip(WHITE)
            if len(line) >= least:
                at.append(i)
                keys.append(xxh3_128_digest(line.encode().lower()))
    return at, keys


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hi, lo): every key of a row once; rows without an id are no document and have none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            rows, keys = [], []
            for k, text in enumerate(batch.column(1)):
                found = set(keys_of(text.as_py().split("\n"), min_chars)[1])
                rows += [k] * len(found)
                keys += found
            hi, lo = _halves(keys)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hi), pa.array(lo)], ["doc_id", "hi", "lo"])

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return spread(rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, f"doc_id {kind}, hi long, lo long")


# --- filters ---------------------------------------------------------------------------------


def shard_of(shards: int) -> Column:
    return F.pmod("hi", F.lit(shards)).cast("int")


def build_filters(repeated: DataFrame, shards: int) -> DataFrame:
    """(shard, filter): a cuckoo filter of the keys of each shard."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.of(rows["hi"].to_numpy(np.int64), rows["lo"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "filter": [made.to_bytes()]})

    return repeated.select(shard_of(shards).alias("shard"), "hi", "lo").groupBy("shard").applyInPandas(build, "shard int, filter binary")


class Gate:
    """Some of the filters, for whole arrays of keys."""

    def __init__(self, filters: dict[int, bytes], shards: int):
        self.shards, self.filters = shards, filters
        self.loaded: dict[int, CuckooFilter] = {}

    def __getstate__(self):
        return self.__dict__ | {"loaded": {}}

    def maybe(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(hi), bool), np.mod(hi, self.shards)
        for s in np.unique(shard).tolist():
            if s in self.filters:
                if s not in self.loaded:
                    self.loaded[s] = CuckooFilter.from_bytes(self.filters[s])
                here = np.flatnonzero(shard == s)
                out[here] = self.loaded[s].contains(hi[here], lo[here])
        return out


def pass_filters(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Those of ``keys`` that the filter of their shard says yes to: all that are repeated, and few others.

    At most FILTERS_SENT filters are on the driver and go to every task; with more shards, each turn
    looks at the keys of its own and is written before the next one begins. Keys are asked about
    where they lie, so one that occurs very often is no burden.
    """
    in_turns = shards > FILTERS_SENT
    if in_turns:
        keys = materialize(keys, "keys")
    out = None
    for first in range(0, shards, FILTERS_SENT):
        mine = lambda c: c.between(first, first + FILTERS_SENT - 1)  # noqa: B023, E731
        held = {r["shard"]: bytes(r["filter"]) for r in filters.where(mine(F.col("shard"))).collect()}
        sent = keys.sparkSession.sparkContext.broadcast(Gate(held, shards))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hi, lo = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                yield batch.filter(pa.array(sent.value.maybe(hi, lo)))

        passed = (keys.where(mine(shard_of(shards))) if in_turns else keys).mapInArrow(run, keys.schema)
        if in_turns:
            passed = materialize(passed, "passed")
            sent.destroy()
        out = passed if out is None else out.unionByName(passed)
    return out


# --- the index -------------------------------------------------------------------------------


class LineIndex:
    """Line keys of a growing corpus: documents come and go, and what went leaves no trace.

    ``folder`` (shared storage) holds one table per change: (hi, lo, doc_id, sign). The reference
    count of a key is the number of different documents that hold it; a document is its id, and ids
    of rows that repeat are one document. Filters follow the counts: a key enters its shard's
    cuckoo filter when ``min_docs`` documents hold it, and is deleted from it when fewer do. Shards
    grow in number with the keys, so that a filter and the keys that it is made of stay small.
    """

    def __init__(self, spark: SparkSession, folder: str, *, shards: int = 1, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.spark, self.folder, self.shards = spark, folder.rstrip("/"), shards
        self.min_chars, self.min_docs = min_chars, min_docs
        self.changes: list[str] = []
        self.written = 0
        self.kind = "long"
        self.once = True  # no document is in the changes twice, and none was taken back
        self.filter_path: str | None = None
        self.held: DataFrame | None = None
        self.fresh = False

    def _write(self, rows: DataFrame, name: str = "change") -> str:
        path = f"{self.folder}/{name}-{self.written:06d}"
        rows.write.parquet(path)
        self.written += 1
        self.fresh = False
        return path

    def insert(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.kind = docs.schema[id_col].dataType.simpleString()
        self.once = not self.changes
        self.changes.append(self._write(line_keys(docs, self.min_chars, id_col, text_col).withColumn("sign", F.lit(1))))
        if len(self.changes) > CHANGES:
            self.compact()

    def delete(self, ids: DataFrame) -> None:
        """Take back every line of the documents named by ``doc_id``; unknown ids change nothing."""
        gone = self._live().join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        self.changes.append(self._write(gone.select("doc_id", "hi", "lo", (-F.col("n")).cast("int").alias("sign"))))
        self.once = False

    def compact(self) -> None:
        """Write the changes as one table; counts stay as they are."""
        self.changes = [self._write(self._live().select("doc_id", "hi", "lo", F.col("n").cast("int").alias("sign")), "whole")]
        self.once = False

    def _log(self) -> DataFrame:
        if not self.changes:
            return self.spark.createDataFrame([], f"doc_id {self.kind}, hi long, lo long, sign int")
        return self.spark.read.schema(f"doc_id {self.kind}, hi long, lo long, sign int").parquet(*self.changes)

    def _live(self) -> DataFrame:
        return self._log().groupBy("doc_id", "hi", "lo").agg(F.sum("sign").alias("n")).where("n > 0")

    def keys(self) -> DataFrame:
        """(doc_id, hi, lo) of the documents that are held; a row may repeat."""
        return (self._log() if self.once else self._live()).select("doc_id", "hi", "lo")

    def counts(self) -> DataFrame:
        """(hi, lo, n_docs, last_doc) of every key that some document holds."""
        return self._live().groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))

    def repeated(self) -> DataFrame:
        """:func:`counts` of the keys that ``min_docs`` documents hold.

        First rows are counted by key, combined map-side, so a line of very many documents is a row
        per task; only keys with enough rows are then counted by document.
        """
        often = self._log().groupBy("hi", "lo").agg(F.sum("sign").alias("n")).where(F.col("n") >= self.min_docs)
        often = materialize(often.select("hi", "lo"), "often")
        mine = self._log().join(broadcast_if_small(often), ["hi", "lo"], "left_semi")
        live = mine.groupBy("doc_id", "hi", "lo").agg(F.sum("sign").alias("n")).where("n > 0")
        out = live.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        return out.where(F.col("n_docs") >= self.min_docs)

    def refresh(self) -> None:
        """Bring the filters up to the counts by inserting and deleting what changed.

        A filter that is full is built anew, larger, and so are all if there are more keys than the
        shards are meant for.
        """
        now = materialize(self.repeated(), "held")
        shards = max(self.shards, -(-now.count() // SHARD_KEYS))
        if self.filter_path is None or shards > self.shards:
            out = build_filters(now, shards)
        else:
            out = self._changed(now)
        path = self._write(out, "filters")
        self.filter_path, self.held, self.shards, self.fresh = path, now, shards, True

    def _changed(self, now: DataFrame) -> DataFrame:
        came = now.join(self.held, ["hi", "lo"], "left_anti").select("hi", "lo", F.lit(1).alias("sign"))
        went = self.held.join(now, ["hi", "lo"], "left_anti").select("hi", "lo", F.lit(-1).alias("sign"))

        def change(key, rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter.from_bytes(filters["filter"].iloc[0]) if len(filters) else CuckooFilter(len(rows))
            gone, come = rows[rows["sign"] < 0], rows[rows["sign"] > 0]
            made.delete(gone["hi"].to_numpy(np.int64), gone["lo"].to_numpy(np.int64))
            try:
                made.insert(come["hi"].to_numpy(np.int64), come["lo"].to_numpy(np.int64))
            except Full:
                return pd.DataFrame({"shard": [key[0]], "filter": pd.Series([None], dtype=object)})
            return pd.DataFrame({"shard": [key[0]], "filter": [made.to_bytes()]})

        changes = came.unionByName(went).withColumn("shard", shard_of(self.shards))
        out = materialize(changes.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(change, "shard int, filter binary"), "filters")
        full = broadcast_if_small(out.where("filter is null").select("shard"))
        again = now.withColumn("shard", shard_of(self.shards)).join(full, "shard", "left_semi")
        return out.where("filter is not null").unionByName(build_filters(again, self.shards))

    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard int, filter binary").parquet(self.filter_path)

    def _ready(self) -> None:
        if not self.fresh:
            self.refresh()

    def maybe_repeated(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, hi, lo): keys of any documents that a filter holds; all others are certainly not repeated."""
        self._ready()
        return pass_filters(line_keys(docs, self.min_chars, id_col, text_col), self.filters(), self.shards)

    def dedup(self, docs: DataFrame, *, inserted: bool = False, broadcast_keys: int = BROADCAST_KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_lines, n_dropped, text) of ``docs`` against the lines of the whole index.

        Of keys that ``min_docs`` documents hold, all lines go but those of the largest id. Whatever
        the number of keys: the filters come first, what passes them meets the exact counts in a join,
        and the keys that a document loses come to its text by id; they are broadcast if there are
        ``broadcast_keys`` at most. ``inserted``: all of ``docs`` are in the index, so that their keys
        need not be made again.
        """
        self._ready()
        keys = self.keys() if inserted else line_keys(docs, self.min_chars, id_col, text_col)
        passed = pass_filters(keys, self.filters(), self.shards)
        gone = passed.join(self.held.select("hi", "lo", "last_doc"), ["hi", "lo"]).where("doc_id <> last_doc")
        gone = materialize(gone.select("doc_id", "hi", "lo"), "gone")
        few = gone.limit(broadcast_keys + 1).count() <= broadcast_keys
        gone = gone.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("hi", "lo")).alias("_gone"))
        rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        joined = rows.join(F.broadcast(gone) if few else gone.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
        return cut_lines(joined.select("doc_id", "text", "_gone.hi", "_gone.lo"), self.min_chars)


def cut_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of rows (doc_id, text, hi, lo): lines go whose keys the arrays name."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            n_lines, n_dropped, kept = [], [], []
            for text, hi, lo in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                text = text.as_py()
                if not hi.is_valid:
                    n_lines.append(text.count("\n") + 1)
                    n_dropped.append(0)
                    kept.append(text)
                    continue
                gone = {(a << 64 | b & (1 << 64) - 1).to_bytes(16, "big", signed=True) for a, b in zip(hi.as_py(), lo.as_py(), strict=True)}
                lines = text.split("\n")
                at, keys = keys_of(lines, min_chars)
                drop = {i for i, key in zip(at, keys, strict=True) if key in gone}
                n_lines.append(len(lines))
                n_dropped.append(len(drop))
                kept.append("\n".join([x for i, x in enumerate(lines) if i not in drop]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, text string")


def line_dedup(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_keys: int = BROADCAST_KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines (before), n_dropped, text (after).

    A line's key is the line stripped of ASCII white space, A-Z in lower case. Keys of ``min_chars``
    code points or more that ``min_docs`` documents hold lose all their lines except in the largest
    doc_id that holds them. Null and empty texts are one empty line. Rows that repeat an id are one
    document: they count once, and where they are the largest all of them keep the line. Rows
    without an id count for no key and keep all their lines. Other columns are ignored; an empty
    table gives an empty result. Keys are told apart by 128-bit hashes.

    The documents are inserted in a :class:`LineIndex` of their own and held against it.
    """
    index = LineIndex(docs.sparkSession, folder(docs.sparkSession, "lines"), min_chars=min_chars, min_docs=min_docs)
    index.insert(docs, id_col=id_col, text_col=text_col)
    return index.dedup(docs, inserted=True, broadcast_keys=broadcast_keys, id_col=id_col, text_col=text_col)
