"""Text rules that several operators share, native and in Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The six ASCII white-space characters [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def no_white(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(batches: Iterable[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, a row at least.

    What a worker makes of a slice (words, lines) is many times larger than the text.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(size), 0
        while at < batch.num_rows:
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, "right"))
            end = max(end, at + 1)
            yield batch.slice(at, end - at)
            at = end


def fresh(columns: list[str], *names: str) -> list[str]:
    """Each name, with underscores before it until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out
