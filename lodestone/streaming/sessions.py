"""Sessions over a stream of turns: each keeps its last four, with answers and hits, until it has been silent for long."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.functions.text import summarize

MAX_TURNS = 4
FIELDS = "turn long, query string, answer_summary string, answer string, hits array<long>"
TURN = f"struct<{FIELDS.replace(' ', ': ').replace(',:', ',')}>"
OUTPUT = f"session_id long, turn long, query string, history array<{TURN}>, is_followup_possible boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """Of each session: a list state of its last turns; with ``silence_ms`` also when it was last heard of, and a timer."""

    def __init__(self, silence_ms: int | None = None):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", FIELDS)
        self.heard = handle.getValueState("heard", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(t) for t in self.turns.get()]
        if self.silence_ms is not None:
            now = timerValues.getCurrentProcessingTimeInMs()
            last = self.heard.get()
            if last is not None and now - last[0] >= self.silence_ms:  # its timer comes after the rows
                kept = []
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.silence_ms)
            self.heard.update((now,))
        out = []
        for r in pd.concat(list(rows)).sort_values("turn", kind="stable").itertuples(index=False):
            if r.clear:
                kept = []
                continue
            out.append((key[0], r.turn, r.query, list(kept), bool(kept)))
            hits = [int(h) for h in (r.hits if r.hits is not None else ())]
            kept = [*kept, (int(r.turn), r.query, r.answer_summary, r.answer, hits)][-MAX_TURNS:]
        if kept:
            self.turns.put(kept)
        else:
            self.turns.clear()
        yield pd.DataFrame(out, columns=["session_id", "turn", "query", "history", "is_followup_possible"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        self.heard.clear()
        yield from ()

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state where list states and timers can be kept."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def session_history(turns: DataFrame, silence_ms: int | None = None) -> DataFrame:
    """Every turn of a stream (session_id, turn, query, and perhaps answer, hits, clear) with the four before it in its session.

    A turn is kept with its question as it was typed, the first sentence of its answer, the answer
    and its hits, so that it can be described or replayed. A row with ``clear`` forgets the session and
    is no turn; a session that has had no turn for ``silence_ms`` is forgotten too. The state of a session
    is four turns at most. A session's turns of a micro-batch are taken in order; batches are taken as
    they come. Start the stream inside :func:`state_store`. Timers make batches of their own, so with
    ``silence_ms`` a stream that takes what is available goes on; stop it, or take one batch at a time.
    """
    have = lambda c, kind: (F.col(c) if c in turns.columns else F.lit(None)).cast(kind).alias(c)
    rows = turns.select("session_id", "turn", "query", have("answer", "string"), have("hits", "array<long>"), have("clear", "boolean"))
    rows = rows.withColumn("answer", F.coalesce("answer", F.lit(""))).withColumn("clear", F.coalesce("clear", F.lit(False))).withColumn("answer_summary", summarize(F.col("answer")))
    return rows.groupBy("session_id").transformWithStateInPandas(Sessions(silence_ms), OUTPUT, "Append", "None" if silence_ms is None else "ProcessingTime")


def kept_turns(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session_id, turn, query, answer_summary, answer, hits): what a stream's last checkpoint holds of its sessions."""
    state = spark.read.format("statestore").option("stateVarName", "turns").option("flattenCollectionTypes", "true").load(checkpoint)
    key = state.schema["key"].dataType.fieldNames()[0]
    return state.select(F.col(f"key.{key}").alias("session_id"), "list_element.*")
