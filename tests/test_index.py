"""The kept index against the scan, after changes of all kinds; what is read of it."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import index as I
from lodestone.operators.index import POSTINGS, InvertedIndex
from lodestone.operators.search import Search


def texts(seed, ids):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["cards", "glass"]
    return {i: " ".join(w for w in rnd.choices(words, [1 / (k + 1) for k in range(62)], k=rnd.randint(0, 40))) if i % 17 else None for i in ids}


def frame(spark, held):
    return spark.createDataFrame(list(held.items()), "id long, text string").repartition(3)


def asked(spark, seed=9, n=12):
    rnd = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(f"w{min(59, int(rnd.expovariate(0.1)))}" for _ in range(5)) + (" w3 w3" if i % 2 else " nothing")) for i in range(n)] + [(99, None), (98, "unknown words")], "question_id long, query string")


def same_as_scan(spark, index, held, k):
    q = asked(spark)
    want = Search(frame(spark, held), q).top("bm25", k, only_shared=True).select("question_id", "rank", "id", "bm25")
    got = index.top(q, k).select("question_id", "rank", "id", "bm25")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    return got


def test_changes(spark, tmp_path):
    index, held = InvertedIndex(spark, str(tmp_path / "i"), buckets=8), texts(1, range(400))
    assert index.top(asked(spark), 3).collect() == []
    index.add(frame(spark, held))
    same_as_scan(spark, index, held, 5)
    more = texts(2, range(300, 700))
    index.add(frame(spark, more))  # a hundred take the place of others
    held |= more
    same_as_scan(spark, index, held, 5)
    index.remove(spark.createDataFrame([(i,) for i in range(0, 2000, 3)], "id long"))
    held = {i: t for i, t in held.items() if i % 3}
    s = index.state()
    assert (s.number, s.n, len(s.batches), len(s.broken)) == (3, len(held), 3, 2)
    same_as_scan(spark, index, held, 5)
    index.compact()
    assert InvertedIndex(spark, str(tmp_path / "i")).state().broken == []
    same_as_scan(spark, InvertedIndex(spark, str(tmp_path / "i")), held, 5)
    index.remove(spark.createDataFrame([(i,) for i in range(2000)], "id long"))
    assert index.top(asked(spark), 3).collect() == [] and index.frequencies().collect() == []


def test_a_tiny_collection_has_terms_of_negative_worth(spark, tmp_path):
    for n in (1, 2, 3, 5):
        held = {i: t for i, t in zip(range(n), ["w1 w2 w3", "w1 w2 w3 w3", "w1 w2", "w1", "w2 w1 w1 w1"], strict=False)}
        index = InvertedIndex(spark, str(tmp_path / f"i{n}"), buckets=2)
        index.add(frame(spark, held))
        same_as_scan(spark, index, held, 2)


def test_a_broken_off_change_and_a_second_writer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    index, held = InvertedIndex(spark, path), texts(3, range(100))
    index.add(frame(spark, held))
    with monkeypatch.context() as m:
        m.setattr(InvertedIndex, "_frequencies", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.add(frame(spark, texts(4, range(50, 200))))
    same_as_scan(spark, index, held, 4)  # postings without a commit are not read
    old = index.state()
    index.add(frame(spark, texts(5, [1000])))
    monkeypatch.setattr(index, "state", lambda: old)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        index.add(frame(spark, texts(6, [1001])))
    with pytest.raises(ValueError, match="repeat"):
        index.add(spark.createDataFrame([(1, "a"), (1, "b")], "id long, text string"))


def test_only_asked_buckets_and_blocks_that_matter_are_read(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=16)
    n = 40 * POSTINGS
    held = {i: "common " * (9 if i // POSTINGS == 7 else 1) + f"filler{i % 50} " * 3 + ("rare " if i % 1000 == 5 else "") for i in range(n)}
    index.add(spark.createDataFrame(list(held.items()), "id long, text string").coalesce(1))
    q = spark.createDataFrame([(1, "common")], "question_id long, query string")
    blocks, kept = index.candidate_blocks(q, 3)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket#" in plan.split("PartitionFilters:")[1].split("]")[0]
    buckets = {r.bucket for r in blocks.select("bucket").distinct().collect()}
    assert len(buckets) <= 2 < index._postings(index.state()).select("bucket").distinct().count()
    assert kept.count() < blocks.count() / 2
    want = Search(spark.createDataFrame(list(held.items()), "id long, text string"), q).top("bm25", 3, only_shared=True)
    assert [tuple(r) for r in index.top(q, 3).select("id", "bm25").orderBy("bm25", "id").collect()] == [tuple(r) for r in want.select("id", "bm25").orderBy("bm25", "id").collect()]


def test_pairs_of_questions_and_documents_are_not_shuffled(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(frame(spark, texts(7, range(300))))
    plan = index.top(asked(spark, n=70), 4)._jdf.queryExecution().executedPlan().toString()
    dealt = [row for row in plan.splitlines() if "Exchange hashpartitioning(" in row]
    assert len(dealt) == 2 and "question_id" in dealt[0] and "hashpartitioning(id#" in dealt[1]
    assert "Generate" in plan and "HashAggregate" not in plan  # postings are scored where they lie by document


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_best_of_a_task_whatever_its_batches(size, monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(I, "RUN", 3)
    worth = np.round(rng.normal(size=(8, 12)), 1) * (rng.random((8, 12)) < 0.4)
    q, place = np.nonzero(worth)
    ids = np.sort(rng.integers(0, 90, 500))
    terms, gain = rng.integers(0, 12, 500), np.round(rng.random(500), 1)
    scores = {}
    for i, t, g in zip(ids, terms, gain, strict=True):
        for x in np.flatnonzero(worth[:, t]):
            scores[100 + x, i] = scores.get((100 + x, i), 0.0) + worth[x, t] * g
    want = {}
    for (x, i), v in scores.items():
        want.setdefault(x, []).append((-round(v, 6), i))
    want = {(x, i, -v) for x, rows in want.items() for v, i in sorted(rows)[:4]}
    table = pa.table({"id": ids, "place": terms.astype(np.int32), "gain": gain})
    found = I._best(table.to_batches(size), I._Asked(100 + q, place, worth[q, place]), 4)
    got = [tuple(r.values()) for b in found for r in b.to_pylist()]
    assert {(x, i, round(v, 6) + 0.0) for x, i, v in got} == {(x, i, v + 0.0) for x, i, v in want}
