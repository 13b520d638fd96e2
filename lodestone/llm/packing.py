"""Packing of token sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.text import parts
from lodestone.llm.tokens import WordBpe
from lodestone.plans.scratch import materialize
from lodestone.plans.sizes import broadcast_if_small, spread

CAPACITY = 2048


def fullest(available: dict[int, int], room: int) -> list[int]:
    """The lengths, each used at most as often as available, that fill ``room`` best.

    A bitset holds the sums that can be reached; bit n of it stands for sum n. Long lengths come
    first, so short ones are spent only where they are needed.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, copies, sums reached before
    for length in sorted((n for n in available if n <= room), reverse=True):
        left, copies = min(available[length], room // length), 1
        while left:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            copies *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins) for all items; ``counts``: items by length.

    Every bin starts with the longest item left and is filled by :func:`fullest`. Items of a length
    are alike, so a combination is repeated while it lasts: the number of searches depends on the
    capacity, not on the number of items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    plan = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        combination = [longest, *fullest(rest, capacity - longest)]
        used = Counter(combination)
        times = min(left[n] // c for n, c in used.items())
        plan.append((combination, times))
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return plan


class Slots:
    """Where the r-th item of a length goes; some thousand rows whatever the input."""

    def __init__(self, plan: list[tuple[list[int], int]], capacity: int):
        rows: dict[int, list] = {}
        filled: Counter = Counter()
        base = 0
        for lengths, times in plan:
            places: dict[int, list[int]] = {}
            at = 0
            for n in lengths:
                places.setdefault(n, []).append(at)
                at += n
            for n, offsets in places.items():
                rows.setdefault(n, []).append((filled[n], base, offsets))
                filled[n] += len(offsets) * times
            base += times
        self.by_length = {}
        for n, slots in rows.items():
            flat = np.concatenate([np.asarray(o, np.int64) for _, _, o in slots])
            width = np.array([len(o) for _, _, o in slots], np.int64)
            self.by_length[n] = (np.array([s for s, _, _ in slots], np.int64), np.array([b for _, b, _ in slots], np.int64), width, np.cumsum(width) - width, flat)
        self.bins = base

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the items with these ranks among those of the length."""
        starts, bases, width, first, flat = self.by_length[length]
        slot = np.searchsorted(starts, rank, "right") - 1
        inside = rank - starts[slot]
        return bases[slot] + inside // width[slot], flat[first[slot] + inside % width[slot]]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and where the piece was made: block and its rank there among its length."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, block = WordBpe.load(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in parts(batches, 1):
            row, number, start, length, crc, rank = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                packed = bpe.packed(text.as_buffer().to_pybytes()) + b"\0\0\0\0"
                for i, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    n = len(part) // 4
                    row.append(k)
                    number.append(i)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    rank.append(seen[n])
                    seen[n] += 1
            numbers = [pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([block] * len(row), pa.int32()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *numbers], ["doc_id", "piece", "start", "length", "ids_crc32", "block", "rank"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return spread(rows).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, block int, rank long")


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece.

    A document is its ids and an id 0; null and empty texts are that id alone. Longer documents are
    cut into pieces of ``capacity``; nothing else is cut. Rows that repeat an id are packed each on
    their own; other columns are ignored; an empty table gives an empty result.

    The pieces are written once. The search for bins sees only how many pieces have each length
    (``capacity`` numbers at most, gathered on the driver), and its plan of some thousand rows says
    where the r-th piece of a length goes. r is a piece's rank in its block plus a running sum over
    blocks, so no task holds all pieces of a length.
    """
    made = materialize(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    per_block = materialize(made.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Slots(minimum_bin_slack(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = per_block.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = made.join(broadcast_if_small(base), ["block", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    kind = made.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    sequence[part], offset[part] = slots.place(int(length[part[0]]), rank[part])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
