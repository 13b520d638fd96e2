"""Broadcasts that check the size of what they send."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 50_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Tables below this size, in bytes per core, are dealt anew where they lie in fewer files than there are cores.
SMALL_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it is a small table in few files, of which a file may be one piece; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_BYTES * cores and len(df.inputFiles()) < cores else df


#: What is made of so many bytes of text or list items is held by a worker at once.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts or lists in ``column`` have about ``most`` bytes or items together; a longer one is alone."""
    value = batch.column(column)
    is_text = pa.types.is_string(value.type) or pa.types.is_large_string(value.type)
    sizes = pc.fill_null(pc.binary_length(value) if is_text else pc.list_value_length(value), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.asarray(sizes, np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto
