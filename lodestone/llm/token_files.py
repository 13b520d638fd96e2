"""Token ids in files of independently coded, checksummed blocks.

A file is a series of segments, each ended by a line feed. A segment holds whole documents in order, and in a row:

* the header: HEADER, then the crc32 of it;
* the index: zlib of the documents' numbers of ids (8 bytes each), the lengths of their names (4 bytes, -1 for none) and
  the names, in UTF-8; a document's last id is its end id;
* the table: for each block the bytes of its payload, the crc32 of the payload and the crc32 of its ids (4 bytes each);
* the payloads of :mod:`lodestone.llm.range_coder`. All blocks have ``block`` ids but the last.

Numbers are little-endian. Segments have the number of their shard (a range of document ids) and their own number in it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.range_coder import MOST_IDS, decode, encode
from lodestone.llm.text import fresh, parts
from lodestone.llm.tokens import WordBpe
from lodestone.plans.scratch import materialize
from lodestone.plans.sizes import broadcast_if_small

#: magic, version, ids of a block, documents, ids, ids are below, blocks, shard, number in the shard, bytes of the index
HEADER = struct.Struct("<4sIIQQIQIIQ")
MAGIC, VERSION = b"LTOK", 2
#: Ids of a block; blocks that are coded in step; a segment ends with the first document that reaches so many ids.
BLOCK = 2048
STEP = 4096
SEGMENT = BLOCK * STEP


def pack_segment(ids: np.ndarray, names: list[str | None], counts: list[int], shard: int, number: int, block: int = BLOCK) -> bytes:
    """A segment of the documents' ids in a row."""
    limit = int(ids.max(initial=0)) + 1
    if limit > MOST_IDS or ids.min(initial=0) < 0:
        raise ValueError(f"ids must be from 0 to {MOST_IDS - 1}")
    said = [b"" if n is None else n.encode() for n in names]
    lengths = np.array([-1 if n is None else len(s) for n, s in zip(names, said, strict=True)], "<i4")
    index = zlib.compress(np.array(counts, "<i8").tobytes() + lengths.tobytes() + b"".join(said), 1)
    payloads: list[bytes] = []
    for at in range(0, len(ids), block * STEP):
        payloads += encode(ids[at : at + block * STEP], block, limit)
    packed = ids.astype("<u4").tobytes()
    table = np.array([(len(p), zlib.crc32(p), zlib.crc32(packed[4 * i * block : 4 * (i + 1) * block])) for i, p in enumerate(payloads)], "<u4")
    header = HEADER.pack(MAGIC, VERSION, block, len(names), len(ids), limit, len(payloads), shard, number, len(index))
    return b"".join([header, struct.pack("<I", zlib.crc32(header)), index, table.tobytes(), *payloads])


class Segment:
    """A segment at ``at`` in the bytes of a file; ``end`` is where the next one begins."""

    def __init__(self, data: memoryview, at: int = 0):
        header = data[at : at + HEADER.size]
        body = at + HEADER.size + 4
        if len(header) < HEADER.size or header[:4] != MAGIC or data[body - 4 : body] != struct.pack("<I", zlib.crc32(header)):
            raise ValueError("damaged header of a segment")
        _, version, self.block, n, self.size, self.limit, blocks, self.shard, self.number, index = HEADER.unpack(header)
        if version != VERSION:
            raise ValueError(f"version {version} of segments is not known")
        try:
            said = zlib.decompress(data[body : body + index])
        except zlib.error as e:
            raise ValueError("damaged index of a segment") from e
        self.counts = np.frombuffer(said, "<i8", n)
        lengths = np.frombuffer(said, "<i4", n, 8 * n)
        ends = 12 * n + np.cumsum(np.maximum(lengths, 0))
        self.names = [None if k < 0 else said[e - k : e].decode() for k, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
        body += index
        self.table = np.frombuffer(data[body : body + 12 * blocks], "<u4").reshape(-1, 3)
        body += 12 * blocks
        self.places = body + np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        self.data, self.end = data, int(self.places[-1]) + 1
        if len(data) < self.end - 1:
            raise ValueError("a segment is cut off")

    def ids(self) -> Iterator[np.ndarray]:
        """The ids, STEP blocks at a time, when all checksums are right."""
        for first in range(0, len(self.table), STEP):
            rows = range(first, min(first + STEP, len(self.table)))
            payloads = [bytes(self.data[self.places[i] : self.places[i + 1]]) for i in rows]
            for i, p in zip(rows, payloads, strict=True):
                if zlib.crc32(p) != self.table[i, 1]:
                    raise ValueError(f"block {i} of segment {self.shard}:{self.number} is damaged")
            ids = decode(payloads, min(self.size - first * self.block, len(rows) * self.block), self.block, self.limit).view("<u4")
            for i in rows:
                at = (i - first) * self.block
                if zlib.crc32(ids[at : at + self.block].data) != self.table[i, 2]:
                    raise ValueError(f"block {i} of segment {self.shard}:{self.number} has other ids")
            yield ids

    def documents(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(place, the parts of the ids) of every document."""
        held: list[np.ndarray] = []
        place, want = 0, int(self.counts[0]) if len(self.counts) else 0
        for ids in self.ids():
            while len(ids) >= want and place < len(self.counts):
                yield place, [*held, ids[:want]]
                ids, held, place = ids[want:], [], place + 1
                want = int(self.counts[place]) if place < len(self.counts) else 0
            if len(ids):
                held.append(ids)
                want -= len(ids)


def tokenized(path: str, end_id: int) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Texts in UTF-8 to the ids of a public word-BPE vocabulary, with the end id after each, and their numbers."""
    end = end_id.to_bytes(4, "little")
    return lambda texts: WordBpe.load(path).packed_all(texts, end)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, segment: int = SEGMENT, segments_per_file: int = 8) -> None:
    """Write every document's ids, and ``end_id`` after them, to files below ``path``, in ascending order of ids.

    Null texts are empty: the end id alone. Null ids come first; rows that repeat an id are documents
    each, in the order of a hash of their texts. Texts of any length are written whole: a document lies
    in one segment, which is coded in steps. Other columns are ignored; an empty table gives no segment.

    Rows are dealt by ranges of ids (rows of one id may be parted too), sorted, tokenised and coded by
    the task that writes them. Files go through the engine's own writer and commit, to any store.
    """
    name, hashed, n = fresh([id_col, text_col], "_name", "_hash", "_n")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col), F.col(id_col).cast("string").alias(name), F.xxhash64(text).alias(hashed), F.monotonically_increasing_id().alias(n), text.alias(text_col))
    order = [id_col, hashed, n]
    ids_of = tokenized(tokenizer_path, end_id)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        names, counts, held, size = [], [], [], 0
        for batch in _with_end(parts(batches, 1, 8 << 20)):
            if batch is not None:
                docs = batch.column(0).to_pylist()
                ids, sizes = ids_of(batch.column(1))
                at, upto = 0, np.cumsum(sizes)
                while at < len(docs):
                    before = int(upto[at - 1]) if at else 0
                    end = min(int(np.searchsorted(upto, before + segment - size)) + 1, len(docs))
                    names += docs[at:end]
                    counts += sizes[at:end].tolist()
                    held.append(ids[before : upto[end - 1]])
                    size, at = size + len(held[-1]), end
                    if size >= segment:
                        yield made(names, counts, held, shard, number)
                        names, counts, held, size, number = [], [], [], 0, number + 1
            elif names:
                yield made(names, counts, held, shard, number)

    def made(names: list, counts: list[int], held: list[np.ndarray], shard: int, number: int) -> pa.RecordBatch:
        ids = np.concatenate(held).astype(np.int32)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([pack_segment(ids, names, counts, shard, number, block)], pa.binary())], ["segment"])

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    segments = ordered.select(name, text_col).mapInArrow(run, "segment binary")
    # the text writer puts the bytes of a string as they are, and a line feed
    segments.select(F.col("segment").cast("string")).write.option("maxRecordsPerFile", segments_per_file).option("lineSep", "\n").text(path)


def _with_end(batches: Iterable) -> Iterator:
    yield from batches
    yield None


def read_tokens(spark: SparkSession, path: str, *, id_type: str = "long", with_ids: bool = False) -> DataFrame:
    """The documents of files of :func:`write_tokens`: doc_id, start (ids of all before it), n_tokens, ids_crc32 and perhaps ids.

    Counts include the end id; the crc32 is of all ids as little-endian 32-bit numbers. Every checksum
    is checked; a file that is damaged or cut off is an error.
    """
    schema = "shard long, number long, place long, name string, inside long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at = memoryview(content.as_buffer()).cast("B"), 0
                while at < len(data):
                    s = Segment(data, at)
                    at = s.end
                    starts = np.cumsum(s.counts) - s.counts
                    out: list[tuple] = []
                    for place, ids in s.documents():
                        crc = 0
                        for part in ids:
                            crc = zlib.crc32(part.data, crc)
                        out.append((place, crc, np.concatenate(ids) if with_ids else None))
                        if len(out) == 4096:
                            yield rows(s, starts, out)
                            out = []
                    yield rows(s, starts, out)

    def rows(s: Segment, starts: np.ndarray, out: list[tuple]) -> pa.RecordBatch:
        at = np.array([o[0] for o in out], np.int64)
        full = lambda x: pa.array(np.full(len(at), x), pa.int64())
        columns = [full(s.shard), full(s.number), pa.array(at), pa.array([s.names[i] for i in at], pa.string()), pa.array(starts[at]), pa.array(s.counts[at]), pa.array([o[1] for o in out], pa.int64())]
        names = ["shard", "number", "place", "name", "inside", "n_tokens", "ids_crc32"]
        if with_ids:
            columns.append(pa.array([o[2].astype(np.int64) for o in out], pa.list_(pa.int64())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    docs = materialize(files.mapInArrow(run, schema), "documents")
    sizes = docs.groupBy("shard", "number").agg(F.sum("n_tokens").alias("n"))
    before = lambda *by: Window.partitionBy(*by).orderBy("number" if by else "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before()), F.lit(0)))  # a row per task that wrote
    sizes = sizes.withColumn("in_shard", F.coalesce(F.sum("n").over(before("shard")), F.lit(0)))
    base = sizes.join(F.broadcast(shards.select("shard", "base")), "shard").select("shard", "number", (F.col("base") + F.col("in_shard")).alias("base"))
    placed = docs.join(broadcast_if_small(base), ["shard", "number"])
    return placed.select(F.col("name").cast(id_type).alias("doc_id"), (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
