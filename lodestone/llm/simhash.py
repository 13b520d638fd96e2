"""SimHash near-dedup: a grid over per-segment bit counts, then exact checks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.text import fresh, parts
from lodestone.operators.graph import connected_components
from lodestone.plans.scratch import materialize
from lodestone.plans.sizes import broadcast_if_small, spread

SHINGLE = 4
SEED = 42
#: Fingerprints link at this many differing bits or fewer.
DISTANCE = 4
#: Bands of segments that make a grid.
BANDS = 3
#: A cell with more rows than this is cut by further segments, or compared in pieces of half as many.
CELL = 4096
#: Further segments cut a cell if that leaves no part with more than one in so many of its rows.
SPREAD = 4


#: Bytes of text whose words are made at once.
PIECE = 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that begin and end with whole words."""
    at = 0
    while at < len(text):
        white = _WHITE.search(text, at + size) if at + size < len(text) else None
        end = white.start() if white else len(text)
        yield text[at:end]
        at = end


def fingerprint(text: bytes, size: int = PIECE) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as a signed number. Words and hashes are made ``size`` bytes of text at a time."""
    from xxhash import xxh64_intdigest

    counts, n, last = np.zeros(64, np.int64), 0, []
    for piece in pieces(text, size):
        words = last + piece.lower().split()  # of bytes: A-Z only, and ASCII white space only
        shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(SHINGLE)), strict=False)]
        last = words[1 - SHINGLE :]
        n += len(shingles)
        _count(counts, np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)))
    if not n and last:  # fewer words than a shingle has
        n = 1
        _count(counts, np.array([xxh64_intdigest(b" ".join(last), SEED)], np.uint64))
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _count(counts: np.ndarray, hashes: np.ndarray) -> None:
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; the only pass over the texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            found = [fingerprint(x.as_buffer().to_pybytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return spread(rows).mapInArrow(run, f"doc_id {kind}, fp long")


# --- the embedding ---------------------------------------------------------------------------

# The lower bit of every two-bit segment, and both halves as signed numbers.
LOW_BITS = 0x5555555555555555


def embedding_of(fp: np.ndarray) -> np.ndarray:
    """The bit counts (0, 1, 2) of the 32 two-bit segments, each written as that many ones.

    So written, the Manhattan distance of two count vectors is the number of bits in which the
    words differ. It never exceeds the distance of the fingerprints themselves.
    """
    fp = fp.view(np.uint64)
    low = np.uint64(LOW_BITS)
    high, low = (fp >> np.uint64(1)) & low, fp & low
    return ((high & low) << np.uint64(1)) | high | low


def deal(segments: list[int], distance: int = DISTANCE) -> list[list[int]]:
    """The segments in BANDS bands. Vectors at Manhattan distance d have d // BANDS or less in some band."""
    cuts = [round(i * len(segments) / BANDS) for i in range(BANDS + 1)]
    return [segments[cuts[i] : cuts[i + 1]] for i in range(BANDS)]


def mask_of(segments: list[int]) -> np.uint64:
    return np.uint64(sum(3 << (2 * s) for s in segments))


def neighbours(counts: np.ndarray, segments: list[int], reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which rows, cells): grid cells over ``segments`` that a row visits, with ``reach`` or less in between.

    A cell is one choice of counts. Of two cells within reach the rows of one visit the other: they
    go up in the first segment that differs, and anywhere in later ones.
    """
    own = counts & mask_of(segments)
    level = [(np.arange(len(counts)), own, 0, reach)]
    while level:
        rows, cells, start, left = level.pop()
        for at in range(start, len(segments)):
            shift = np.uint64(2 * segments[at])
            held = (cells >> shift) & np.uint64(3)  # 0, 1, 3: that many ones
            for step in range(-left, left + 1):
                if step == 0 or (step < 0 and left == reach):
                    continue
                to = np.bitwise_count(held).astype(np.int64) + step
                fits = np.flatnonzero((to >= 0) & (to <= 2))
                if len(fits):
                    ones = ((np.uint64(1) << to[fits].astype(np.uint64)) - np.uint64(1)) << shift
                    moved = (cells[fits] & ~(np.uint64(3) << shift)) | ones
                    yield rows[fits], moved
                    if left > abs(step):
                        level.append((rows[fits], moved, at + 1, left - abs(step)))


#: The grid of the first look, and for each of its bands the grid of a second look into crowded cells.
FIRST = deal(list(range(32)))
SECOND = [deal([s for s in range(32) if s not in band]) for band in FIRST]
VISITS, VISITS_AGAIN = 1, 2
CELLS = "t int, cell long, role int, fp long"


def _cells(counts: np.ndarray, segments: list[int], distance: int, visits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cells, roles): every row at home, and where it visits."""
    out = [(np.arange(len(counts)), counts & mask_of(segments), np.zeros(len(counts), np.int32))]
    for rows, cells in neighbours(counts, segments, distance // BANDS):
        out.append((rows, cells, np.full(len(rows), visits, np.int32)))
    return out


def _batch(t: list, cell: list, role: list, fp: list) -> pa.RecordBatch:
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (t, cell, role, fp)]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, k) for c, k in zip(columns, kinds, strict=True)], ["t", "cell", "role", "fp"])


def first_look(unique: DataFrame, distance: int) -> DataFrame:
    """Every fingerprint in its cell of every band, and in the cells it visits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            counts = embedding_of(fp)
            for t, band in enumerate(FIRST):
                for rows, cells, roles in _cells(counts, band, distance, VISITS):
                    yield _batch([np.full(len(rows), t, np.int32)], [cells], [roles], [fp[rows]])

    return unique.select("fp").mapInArrow(run, CELLS)


def second_look(crowded: DataFrame, distance: int) -> DataFrame:
    """The rows of crowded cells by cells that further segments cut these into: a grid of the segments of all other bands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, cell, role, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k in np.unique(t).tolist():
                here = np.flatnonzero(t == k)
                counts, outer = embedding_of(fp[here]), cell[here].view(np.uint64)
                for u, band in enumerate(SECOND[k]):
                    for rows, cells, roles in _cells(counts, band, distance, VISITS_AGAIN):
                        yield _batch([np.full(len(rows), BANDS + BANDS * k + u, np.int32)], [cells | outer[rows]], [roles | role[here][rows]], [fp[here][rows]])

    return crowded.select("t", "cell", "role", "fp").mapInArrow(run, CELLS)


# --- cells -----------------------------------------------------------------------------------


def forest(run_of: np.ndarray, role: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs within ``distance`` connect, fewer than rows.

    Rows of a cell are adjacent and have one number in ``run_of``. Two visitors of one look need not
    be compared: they meet where one of them is at home. Pairs are first held against the lower bound
    of the embedding, then against the fingerprints.
    """
    n = len(fp)
    bits, counts = fp.view(np.uint64), embedding_of(fp)
    label = np.arange(n)
    at, step, pairs = np.arange(n), 1, []
    while True:
        at = at[at + step < n]
        at = at[run_of[at] == run_of[at + step]]
        if not len(at):
            break
        near = at[role[at] & role[at + step] == 0]
        near = near[np.bitwise_count(counts[near] ^ counts[near + step]) <= distance]
        near = near[np.bitwise_count(bits[near] ^ bits[near + step]) <= distance]
        if len(near):
            pairs.append((near, near + step))
        step += 1
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while True:
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            label = label[label]
            if (label[a] == label[b]).all():
                break
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def _crowded(cells: DataFrame) -> DataFrame:
    """(t, cell, n) of cells with more than CELL rows of which one is at home."""
    by = cells.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("role").alias("_least"))
    return materialize(by.where((F.col("n") > CELL) & (F.col("_least") == 0)).select("t", "cell", "n"), "crowded")


def _in_pieces(cells: DataFrame, crowded: DataFrame) -> DataFrame:
    """(t, cell, i, j, role, fp): a crowded cell's rows are dealt to pieces; every two pieces meet in a group of their own."""
    parts = crowded.select("t", "cell", F.ceil(F.col("n") / (CELL // 2)).cast("int").alias("parts"))
    out = cells.join(broadcast_if_small(parts), ["t", "cell"])
    out = out.withColumn("own", F.pmod(F.xxhash64("fp"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.select("t", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "role", "fp")


def _whole(cells: DataFrame) -> DataFrame:
    return cells.select("t", "cell", F.lit(0).alias("i"), F.lit(0).alias("j"), "role", "fp")


def links(unique: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): fingerprints whose links connect all that are within ``distance``, never all pairs of a cell.

    A range join over a grid. The 32 counts are dealt to three bands; two vectors within Manhattan
    distance 4 are within 1 of one another in some band, so each row has a cell per band and visits
    the cells one step up. Cells of more than CELL rows are cut by a second such grid over the other
    bands, if that spreads their rows; rows that stay together there, as large groups of near copies
    do, are compared in pieces by many tasks.
    """
    cells = first_look(unique, distance)
    crowded = _crowded(cells)
    key = ["t", "cell"]
    if crowded.isEmpty():
        return _compared(_whole(cells), distance)
    few = broadcast_if_small(crowded)
    out = _whole(cells.join(few.select(*key), key, "left_anti"))
    hot = materialize(cells.join(few.select(*key), key, "left_semi"), "hot")
    again = second_look(hot, distance)
    outer = [int(mask_of(band).view(np.int64)) for band in FIRST]
    first = F.floor((F.col("t") - BANDS) / BANDS).cast("int")
    base = F.when(first == 0, F.lit(outer[0])).when(first == 1, F.lit(outer[1])).otherwise(F.lit(outer[2]))
    most = again.where(F.col("role") < VISITS_AGAIN).groupBy("t", "cell").agg(F.count(F.lit(1)).alias("m"))
    most = most.groupBy(first.alias("t"), F.col("cell").bitwiseAND(base).alias("cell")).agg(F.max("m").alias("m"))
    spread = materialize(crowded.join(most, key).where(F.col("m") * SPREAD <= F.col("n")).select(*key), "spread")
    dense = crowded.join(broadcast_if_small(spread), key, "left_anti")
    out = out.unionByName(_in_pieces(hot, dense))
    if not spread.isEmpty():
        deep = second_look(hot.join(broadcast_if_small(spread), key, "left_semi"), distance)
        still = _crowded(deep)
        out = out.unionByName(_whole(deep.join(broadcast_if_small(still.select(*key)), key, "left_anti"))).unionByName(_in_pieces(deep, still))
    return _compared(out, distance)


def _compared(cells: DataFrame, distance: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in [*batches_of(batches), None]:
            if batch is not None:
                columns = batch if kept is None else [np.concatenate(x) for x in zip(kept, batch, strict=True)]
            elif kept is None:
                return
            else:
                columns = kept
            starts = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in columns[:4]])) + 1
            cut = len(columns[5]) if batch is None else int(starts[-1]) if len(starts) else 0
            kept = [c[cut:] for c in columns]
            run_of = np.zeros(cut, np.int64)
            run_of[starts[starts < cut]] = 1
            a, b = forest(np.cumsum(run_of), columns[4][:cut], columns[5][:cut], distance)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def batches_of(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            yield [c.to_numpy(zero_copy_only=False) for c in batch.columns]

    key = ["t", "cell", "i", "j"]
    return cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, *, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    A text is lower-cased in A-Z and cut at ASCII white space; each run of four words, or all words
    of a shorter text, is hashed (XXH64, seed 42), repeats counted; a bit of the fingerprint is one
    where over half the hashes have it. No word, or null: fingerprint zero. Fingerprints within
    ``distance`` bits are linked, and component_id is the smallest doc_id that links reach. Rows that
    repeat an id or text are rows like others; null ids count in no minimum; other columns are
    ignored; an empty table gives an empty result. Texts of any length are read whole, a piece at a time.

    Equal fingerprints are one node. Candidates come from the range join of :func:`links`; what a
    cell yields is a forest, so large groups of near copies never become all their pairs.
    """
    made = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    out = made.join(components(made, distance), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def components(made: DataFrame, distance: int) -> DataFrame:
    """(fp, root, component_id) of every fingerprint of (doc_id, fp); ``root`` is some fingerprint of the component."""
    unique = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "unique")
    found = materialize(links(unique.select("fp"), distance).distinct(), "links")
    root = connected_components(found)
    nodes = unique.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return nodes.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def keep_representatives(docs: DataFrame, *, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have the smallest doc_id of their component, with all their columns.

    Where ids repeat or are null, one row of each component stays: of those with its smallest id (a
    null id if all are), one with the smallest fingerprint. Rows of that id and fingerprint are
    thinned in two steps, so that even an id of very many rows does not meet in one task whole.
    """
    made = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    found = materialize(made.join(components(made, distance), "fp"), "components")
    odd = made.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    named, fp, key, salt, place = fresh(docs.columns, "_id", "_fp", "_key", "_salt", "_n")
    if not odd:
        kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(named))
        return docs.join(kept, F.col(id_col) == F.col(named), "left_semi")
    at, schema = docs.columns.index(text_col), docs.withColumn(fp, F.lit(0).cast("long")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, at):
            found = [fingerprint((x.as_py() or "").encode()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, fp])

    # the component's smallest id may stand for several rows, or be null for all of them
    winners = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("component_id").alias(named), F.min("fp").alias(key)).drop("root")
    rows = docs.mapInArrow(run, schema).join(winners, F.col(id_col).eqNullSafe(F.col(named)) & (F.col(fp) == F.col(key)), "left_semi")
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(256)))
    for group in ([id_col, fp, salt], [id_col, fp]):
        one = Window.partitionBy(*group).orderBy(salt)
        rows = rows.withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).drop(place)
    return rows.select(*docs.columns)
