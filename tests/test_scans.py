"""How often searches go over all pairs, and what a task holds while it does."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import retrieval as R
from lodestone.operators import search as X
from test_search import frames, tables


@pytest.fixture
def scans(monkeypatch):
    seen, real = [], X.Search._reduce

    def counted(self, *args):
        seen.append(args[-1])
        return real(self, *args)

    monkeypatch.setattr(X.Search, "_reduce", counted)
    return seen


def test_reciprocal_ranks_take_two_scans(spark, scans):
    X.Search(*frames(spark, *tables())).rrf(2, 1).collect()
    assert len(scans) == 2  # the firsts of both channels, then their ranks


def test_boosts_take_two_scans_and_texts_are_read_once(spark, scans, monkeypatch):
    read, real = [], X.term_counts
    monkeypatch.setattr(X, "term_counts", lambda *a: read.append(1) or real(*a))
    chunks, questions, vectors = frames(spark, *tables())
    R.ask_index(chunks, questions.select("question_id", "query"), vectors).collect()
    assert len(scans) == 2 and len(read) == 1  # ranges of channels, then the best of each class of boosts with its range


def test_a_task_holds_runs_of_questions_and_not_all_of_a_turn():
    """2048 questions over a block of 1024 chunks: one array of all pairs alone would be 16 MB."""
    n, m, rng = 2048, 1024, np.random.default_rng(0)
    rows = [{"question_id": i, "query": f"w{i % 50} w{i % 7}", "vector": rng.normal(size=8).tolist(), "intent": False, "boost_families": [], "routes": []} for i in range(n)]
    known = {f"w{i}": i for i in range(50)}
    lists = lambda values: pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * m + 1, 4), pa.int32()), values)
    at = (np.arange(4 * m) * 7) % 50
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(m)), lists(pa.array(at, pa.int32())), lists(pa.array(rng.uniform(1, 2, 4 * m))), pa.array(rng.normal(size=(m, 8)).tolist(), pa.list_(pa.float32())), pa.nulls(m, pa.string()), pa.array(np.arange(m) % 8 == 0)], ["id", "at", "gain", "vector", "family", "is_workflow"])
    held = SimpleNamespace(spark=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))))
    table = SimpleNamespace(mapInArrow=lambda run, schema: run)
    asked = X.Asked(rows, known)
    run = X.Search._reduce(held, asked, table, lambda: [X._Best(X.Recipe("bm25"), 3, False, True), X._Best(X.Recipe("dense"), 3, False, False)], X.BEST)
    tracemalloc.start()
    out = pa.Table.from_batches(list(run([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6 and out.num_rows == 2 * 3 * n
