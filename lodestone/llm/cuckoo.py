"""A cuckoo filter over 128-bit keys: insertion, deletion, and probes of whole arrays."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Full(Exception):
    """The filter has no room for a key; build a larger one from the exact table."""


class CuckooFilter:
    """16-bit marks in buckets of four; a key has two buckets, each found from the other and the mark.

    No false negatives for keys inserted and not deleted; a false positive needs an equal mark, about
    8 in 65536 for a full filter. A key may be inserted once; only inserted keys may be deleted.
    """

    def __init__(self, keys: int = 0, table: np.ndarray | None = None):
        if table is None:
            buckets = 1
            while buckets * SLOTS * 0.85 < keys:
                buckets *= 2
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    def _marks(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hi, lo = np.asarray(hi).view(np.uint64), np.asarray(lo).view(np.uint64)
        mark = (lo >> np.uint64(48)).astype(np.uint64)
        mark[mark == 0] = 1
        first = (hi >> np.uint64(8)) & self.mask
        return mark, first, first ^ self._jump(mark)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((mark * _MIX) >> np.uint64(32)) & self.mask

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, first, second = self._marks(hi, lo)
        mark = mark.astype(np.uint16)[:, None]
        return (self.table[first] == mark).any(1) | (self.table[second] == mark).any(1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        rest = np.arange(len(np.asarray(hi)))
        marks, firsts, seconds = self._marks(hi, lo)
        for i in rest:
            mark, at = int(marks[i]), int(firsts[i])
            if self._put(at, mark) or self._put(int(seconds[i]), mark):
                continue
            for kick in range(KICKS):
                slot = (mark + kick) % SLOTS
                mark, self.table[at, slot] = int(self.table[at, slot]), mark
                at = int(np.uint64(at) ^ self._jump(np.uint64(mark)))
                if self._put(at, mark):
                    break
            else:
                raise Full

    def _put(self, at: int, mark: int) -> bool:
        free = np.flatnonzero(self.table[at] == 0)
        if len(free):
            self.table[at, free[0]] = mark
        return bool(len(free))

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        for mark, *buckets in zip(*self._marks(hi, lo), strict=True):
            for at in buckets:
                held = np.flatnonzero(self.table[int(at)] == int(mark))
                if len(held):
                    self.table[int(at), held[0]] = 0
                    break
            else:
                raise KeyError("a key that was not inserted")

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        return cls(table=np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> "CuckooFilter":
        """A filter of these keys, as large as it must be."""
        room = max(1, len(hi))
        while True:
            made = cls(room)
            try:
                made.insert(hi, lo)
                return made
            except Full:
                room *= 2
