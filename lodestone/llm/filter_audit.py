"""Audit of how text filters interact: what every order of five filters keeps, removes and loses."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import WHITE, parts
from lodestone.plans.scratch import materialize
from lodestone.plans.sizes import spread

LETTERS = "ABCDE"
#: Bytes that are scanned at once; what a scan holds besides the text is some twenty times as much.
BLOCK = 1 << 20
#: Words up to this many bytes are hashed and compared eight bytes at a time, longer ones one by one.
SHORT = 64
#: Different words of a document that is longer than a block are merged when so many have come together.
MERGE = 500_000


@dataclass(frozen=True)
class Limits:
    """When filters A to D fail a text."""

    least_words: int = 100
    least_distinct_percent: int = 80
    most_capital_percent: int = 10
    symbols: str = "#$%&*|"

    def mask(self, words: np.ndarray, distinct: np.ndarray, capitals: np.ndarray, symbols: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Bit i: the text fails filter i of A to D."""
        fails = [words < self.least_words, 100 * distinct < self.least_distinct_percent * words, 100 * capitals > self.most_capital_percent * points, symbols > 0]
        return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


class Scan:
    """Counts of the texts of one Arrow buffer: a byte has a class, prefix sums of classes give each text's counts.

    The buffer is read in blocks, wherever its texts begin; a text that goes on in the next block
    keeps its counts, a word that does so its start, and its different words so far.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, symbols: str, block: int = BLOCK):
        self.data, self.offsets, self.block = data, offsets.astype(np.int64), block
        n = len(offsets) - 1
        self.words, self.distinct, self.capitals, self.symbols, self.points = (np.zeros(n, np.int64) for _ in range(5))
        byte = np.arange(256)
        self.white = np.isin(byte, [ord(c) for c in WHITE])
        self.classes = ((self.capitals, (byte >= 65) & (byte <= 90)), (self.symbols, np.isin(byte, [ord(c) for c in symbols])), (self.points, (byte & 0xC0) != 0x80))
        self.open: tuple[int, int] | None = None  # (start, text) of a word that goes on
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of a text that goes on: keys, starts, lengths
        self.held_of = -1
        for a in range(int(self.offsets[0]), int(self.offsets[-1]), block):
            self._scan(a, min(a + block, int(self.offsets[-1])))
        self._settle()

    def _scan(self, a: int, b: int) -> None:
        codes = self.data[a:b]
        first = int(np.searchsorted(self.offsets, a, "right")) - 1
        last = int(np.searchsorted(self.offsets, b, "left"))
        edges = np.clip(self.offsets[first : last + 1], a, b) - a
        texts = slice(first, last)
        before = np.zeros(b - a + 1, np.int32)
        for out, table in self.classes:
            np.cumsum(table[codes], out=before[1:])
            out[texts] += before[edges[1:]] - before[edges[:-1]]
        # a word begins where the byte before is white or another text's, and likewise ends
        inside = ~self.white[codes]
        joined = np.empty(b - a + 1, bool)  # is a byte in one word with the byte before it?
        joined[1:-1] = inside[1:] & inside[:-1]
        joined[0] = self.open is not None and inside[0]
        joined[-1] = inside[-1] and b < self.offsets[-1] and not self.white[self.data[b]]
        here = self.offsets[np.searchsorted(self.offsets, a) : np.searchsorted(self.offsets, b, "right")] - a
        joined[here] = False
        starts = np.flatnonzero(inside & ~joined[:-1]) + a
        ends = np.flatnonzero(inside & ~joined[1:]) + a + 1
        if self.open is not None:
            starts = np.concatenate([[self.open[0]], starts])
        self.open = (int(starts[-1]), 0) if len(starts) > len(ends) else None
        starts = starts[: len(ends)]
        if not len(starts):
            return
        of = np.searchsorted(self.offsets, starts, "right") - 1
        self.words[:] += np.bincount(of, minlength=len(self.words))
        newest = int(of[-1])
        keys, starts, lengths, of = self._different(starts, ends - starts, of, a)
        going_on = of == newest if self.offsets[newest + 1] > b or self.held_of == newest else np.zeros(len(of), bool)
        if self.held_of >= 0 and self.held_of != newest:
            also = of == self.held_of
            self._hold(self.held_of, keys[also], starts[also], lengths[also])
            self._settle()
            keys, starts, lengths, of, going_on = (x[~also] for x in (keys, starts, lengths, of, going_on))
        self.distinct[:] += np.bincount(of[~going_on], minlength=len(self.distinct))
        if going_on.any():
            self._hold(newest, keys[going_on], starts[going_on], lengths[going_on])

    def _different(self, starts: np.ndarray, lengths: np.ndarray, of: np.ndarray, a: int) -> tuple[np.ndarray, ...]:
        """(keys, starts, lengths, of) of a block's words, each different one of a text once."""
        low = max(0, a - SHORT)
        end = int(starts[-1] + lengths[-1])
        near = np.concatenate([self.data[low:end], np.zeros(8, np.uint8)])
        eights = np.ndarray((len(near) - 7,), "<u8", near.data, strides=(1,))
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        cut = np.array([0, *((1 << (8 * i)) - 1 for i in range(1, 8)), int(full)], np.uint64)
        short = lengths <= SHORT
        at = np.where(short, starts - low, 0)

        def eight(rows: np.ndarray, k: int) -> np.ndarray:
            """Bytes 8k to 8k + 8 of words, zero beyond their ends."""
            return eights[at[rows] + 8 * k] & cut[np.minimum(lengths[rows] - 8 * k, 8)]

        keys = _stir(lengths.astype(np.uint64) + (of.astype(np.uint64) << np.uint64(32)))
        rows, k = np.flatnonzero(short), 0
        while len(rows):
            keys[rows] = _stir(keys[rows] ^ eight(rows, k))
            k += 1
            rows = rows[lengths[rows] > 8 * k]
        for i in np.flatnonzero(~short).tolist():
            said = blake2b(self.data[starts[i] : starts[i] + lengths[i]].data, digest_size=8).digest()
            keys[i] ^= np.frombuffer(said, "<u8")[0]
        order = np.argsort(keys)
        same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
        one, two = order[same], order[same + 1]
        equal = (lengths[one] == lengths[two]) & (of[one] == of[two])
        rows, k = np.flatnonzero(equal & short[one]), 0
        while len(rows):
            differ = eight(one[rows], k) != eight(two[rows], k)
            equal[rows[differ]] = False
            k += 1
            rows = rows[~differ & (lengths[one[rows]] > 8 * k)]
        for i in np.flatnonzero(equal & ~short[one]).tolist():
            equal[i] = self._word(starts[one[i]], lengths[one[i]]) == self._word(starts[two[i]], lengths[two[i]])
        if not equal.all():  # different words of one key: they are told apart by their bytes
            seen: dict[tuple, int] = {}
            for i in range(len(starts)):
                seen.setdefault((int(of[i]), self._word(starts[i], lengths[i])), i)
            keep = np.array(list(seen.values()))
        else:
            first = np.ones(len(order), bool)
            first[same + 1] = False
            keep = order[first]
        return keys[keep], starts[keep], lengths[keep], of[keep]

    def _word(self, start: int, length: int) -> bytes:
        return self.data[start : start + length].tobytes()

    def _hold(self, text: int, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.held_of = text
        self.held.append((keys, starts, lengths))
        if sum(len(k) for k, _, _ in self.held) > 2 * max(MERGE, len(self.held[0][0])):
            self.held = [self._merged()]

    def _merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, starts, lengths = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, starts, lengths = keys[order], starts[order], lengths[order]
        keep = np.ones(len(keys), bool)
        runs = np.flatnonzero(np.diff(np.concatenate([[False], keys[1:] == keys[:-1], [False]]).astype(np.int8)))
        for a, b in zip(runs[::2].tolist(), (runs[1::2] + 1).tolist(), strict=True):
            seen = set()
            for i in range(a, b):
                word = self._word(starts[i], lengths[i])
                keep[i] = word not in seen
                seen.add(word)
        return keys[keep], starts[keep], lengths[keep]

    def _settle(self) -> None:
        """The text that went on has ended."""
        if self.held:
            self.distinct[self.held_of] += len(self._merged()[0])
        self.held, self.held_of = [], -1


def _stir(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def scan(docs: DataFrame, limits: Limits, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, digest, mask) of every row; the only pass over the texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 3):
            texts = batch.column(3)
            data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            s = Scan(data, offsets, limits.symbols)
            mask = limits.mask(s.words, s.distinct, s.capitals, s.symbols, s.points)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(mask, pa.int32())], ["doc_id", "part", "digest", "mask"])

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return spread(rows).mapInArrow(run, f"doc_id {kind}, part string, digest binary, mask int")


def orders_of(letters: str = LETTERS) -> tuple[list[str], list[int], np.ndarray, np.ndarray]:
    """Of every order and step: the order, the step from 1, the bits of the filters before, the bit of its own."""
    orders, steps, before, own = [], [], [], []
    for order in permutations(range(len(letters))):
        gone = 0
        for step, i in enumerate(order, 1):
            orders.append("".join(letters[j] for j in order))
            steps.append(step)
            before.append(gone)
            own.append(1 << i)
            gone |= 1 << i
    return orders, steps, np.array(before), np.array(own)


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def tally(counts: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of every order and step, from how many documents (all, good, toxic) fail each set of filters."""
    _, _, before, own = orders_of()
    mask = np.arange(len(counts))
    passed = (mask[None, :] & before[:, None]) == 0
    fails = (mask[None, :] & own[:, None]) != 0
    removed = (passed & fails) @ counts
    by_filter = {int(bit): int(removed[own == bit].sum()) for bit in np.unique(own)}
    return {
        "kept": (passed & ~fails) @ counts,
        "removed": removed,
        "redundant": (~passed & fails) @ counts,
        "unique_fails": counts[own],
        "good_lost": (passed & fails) @ good,
        "toxic_lost": (passed & fails) @ toxic,
        "shapley": np.array([by_filter[int(bit)] for bit in own]),
    }


def filter_audit(docs: DataFrame, labels: DataFrame, *, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, order of the filters A to E and step: how many documents are kept, removed and lost there.

    A to D look at one text (:class:`Limits`; a word is a run of bytes other than ASCII white space).
    E fails a text that a row with a smaller id has too, in any part, removed or not. Columns: part (a
    value of ``part_col``; null: empty string), filter_order (such as 'ACBDE'), step (from 1; its filter
    is the letter there), kept, removed, redundant (fails here, removed before), unique_fails (fails
    this filter only), good_lost and toxic_lost (removed here, with quality or toxic 1 in ``labels``),
    shapley (removed by the filter over all orders).

    Null texts are empty: they fail A alone, and E if not the first. A row without an id fails E never
    and makes no other row fail it; rows that share the smallest id of a text all pass it. An id with
    several labels is good or toxic if one of them says so; labels may be missing. Texts of any length
    are read in blocks. An empty table gives an empty result; other columns are ignored.

    Texts are read once. What is shuffled is a digest and a mask a row: first to find the smallest id
    of each digest (summed in each task before), then by digest and id, so that large groups of copies
    do not meet, and by id to the labels. A part ends as 128 counts at most.
    """
    rows = materialize(scan(docs, limits, id_col, text_col, part_col), "masks")
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(said("quality"), said("toxic"))
    repeats: Column = F.col("first").isNull() & F.col("doc_id").isNotNull()
    masks = rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(repeats, F.lit(1 << LETTERS.index("E"))).otherwise(0)).alias("mask"))
    each = masks.join(known, "doc_id", "left").groupBy("part", "mask", F.coalesce("quality", F.lit(False)).alias("quality"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))
    by_part = each.groupBy("part").agg(F.collect_list(F.struct("mask", "quality", "toxic", "n")).alias("counts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps, _, _ = orders_of()
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, good, toxic = (np.zeros(1 << len(LETTERS), np.int64) for _ in range(3))
                for c in counts:
                    n[c["mask"]] += c["n"]
                    good[c["mask"]] += c["n"] * c["quality"]
                    toxic[c["mask"]] += c["n"] * c["toxic"]
                found = tally(n, good, toxic)
                columns = [pa.array([part] * len(orders)), pa.array(orders), pa.array(steps, pa.int32()), *(pa.array(found[c], pa.int64()) for c in COUNTS)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS])

    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
