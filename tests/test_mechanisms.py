"""Table functions, grouping sets, walks by doubling, sessions that end, ordered texts."""

import random
import time

import pytest

from lodestone.functions.tables import register
from lodestone.operators import evaluation as E
from lodestone.operators import geometry as P
from lodestone.operators import graph as G
from lodestone.operators.chunking import window_chunks
from lodestone.streaming.sessions import kept_turns, session_history, state_store

SPANS = "page long, text string, x0 double, y0 double, x1 double, y1 double"


def test_windows_from_sql(spark):
    register(spark)
    docs = spark.createDataFrame([(1, "\n\n".join(f"paragraph {i} " * 20 for i in range(9))), (2, None), (3, ""), (4, "x" * 5000), (5, "short but long enough to be kept")], "doc_id long, text string")
    want = sorted(map(tuple, window_chunks(docs, 400, 50).collect()))
    got = spark.sql("SELECT d.doc_id, w.* FROM {d} d, LATERAL text_windows(d.text, 400, 50) w", d=docs)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    with pytest.raises(Exception, match="smaller than the size"):
        spark.sql("SELECT * FROM text_windows('a', 10, 10)")
    with pytest.raises(Exception, match="constant whole number"):
        spark.sql("SELECT w.* FROM {d} d, LATERAL text_windows(d.text, d.doc_id) w", d=docs)
    with pytest.raises(Exception, match="takes a text"):
        spark.sql("SELECT * FROM text_windows(5)")


def test_clusters_from_sql(spark):
    register(spark)
    rng = random.Random(4)
    rows = [(page, f"s{i}", x := rng.choice([0, 40, 80]) + rng.random(), y := rng.randrange(0, 200, 7) + rng.random(), x + 60, y + 10) for page in range(6) for i in range(40)]
    spans = spark.createDataFrame(rows, SPANS)
    want = P.cluster_spans(spans).drop("size", "spans")
    assert not any(n in want._jdf.queryExecution().executedPlan().toString() for n in ("Python", "Pandas", "Arrow"))
    got = spark.sql("SELECT * FROM span_clusters(TABLE({s}))", s=spans)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="lacks y1"):
        spark.sql("SELECT * FROM span_clusters(TABLE({s}))", s=spans.drop("y1"))


def test_margins_of_a_sweep_in_one_pass(spark):
    kept = spark.createDataFrame([(f, k, q, q * 10 + i, i == 0) for f in "ab" for k in (1, 2) for q in range(4) for i in range(k)], "f string, k int, question_id long, id long, is_workflow boolean")
    gold = spark.createDataFrame([(0, 0), (1, 11), (2, 20), (2, 21), (9, 90)], "question_id long, id long")
    out = E.sweep(kept, gold, 4, ["f", "k"], [["f", "k"], ["f"], ["k"], []])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and "Union" not in plan
    got = {(r.f, r.k): (r.hits, r.returned, r.mean_returned, r.mean_workflow) for r in out.collect()}
    assert got["a", 1] == (2, 4, 1.0, 1.0) and got["a", 2] == (3, 8, 2.0, 1.0)
    assert got["a", None] == (5, 12, 1.5, 1.0) and got[None, 2] == (6, 16, 2.0, 1.0) and got[None, None] == (10, 24, 1.5, 1.0) and len(got) == 9


def by_rings(edges, starts):
    depth = {}
    ring, d = set(starts), 0
    while ring:
        depth |= {n: d for n in ring}
        ring, d = {(g, b) for g, a, b in edges if (g, a) in ring} - set(depth), d + 1
    return {(g, i, d) for (g, i), d in depth.items()}


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_walks(spark, one_task):
    rng = random.Random(7)
    edges = [(g, rng.randrange(25), rng.randrange(25)) for g in range(6) for _ in range(g * 9)]
    edges += [(7, i, i + 1) for i in range(90)] + [(7, 40, 3), (7, 90, 95), (7, 20, 95), (8, 1, 1), (9, 0, 1), (9, 1, 2), (9, 2, 0)]  # a long way back, a loop, a ring
    starts = [(g, 0) for g in range(10)] + [(1, 7), (8, 1), (50, 3)]
    e = spark.createDataFrame(edges, "graph long, src long, dst long")
    got = G.reachable(e, spark.createDataFrame(starts, "graph long, id long"), one_task=one_task)
    assert {tuple(r) for r in got.collect()} == by_rings(edges, starts)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, written = 20_000, []
    real = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, name="cut": written.append(name) or real(df, name))
    e = spark.range(n).selectExpr("0L AS graph", "id AS src", "id + 1 AS dst")
    got = G.reachable(e, spark.range(1).selectExpr("0L AS graph", "id"), one_task=100)
    assert got.count() == n + 1 and got.where("depth <> id").count() == 0
    assert len(written) <= 2 * 15 + 4, written
    assert G.reachable(e, spark.range(1).selectExpr("0L AS graph", "id")).where("depth = id").count() == n + 1


def test_sessions_that_fall_silent(spark, tmp_path):
    def run(rows, silence, name):
        spark.createDataFrame(rows, "session_id long, turn long, query string").coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        turns = spark.readStream.schema("session_id long, turn long, query string").parquet(str(tmp_path / name / "in"))
        with state_store(spark):
            session_history(turns, silence).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / name / "state")).trigger(once=True).start(str(tmp_path / name / "out")).awaitTermination(120)
        return {(r.session_id, r.turn): [h.turn for h in r.history] for r in spark.read.parquet(str(tmp_path / name / "out")).collect()}

    first, then = [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], [(1, 2, "d"), (3, 0, "e")]
    run(first, 1, "short")
    time.sleep(0.1)
    assert run(then, 1, "short")[1, 2] == []
    assert {r.session_id for r in kept_turns(spark, str(tmp_path / "short" / "state")).collect()} <= {1, 3}
    run(first, 3_600_000, "long")
    assert run(then, 3_600_000, "long")[1, 2] == [0, 1]
    kept = kept_turns(spark, str(tmp_path / "long" / "state"))
    assert sorted((r.session_id, r.turn, r.query) for r in kept.collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "d"), (2, 0, "c"), (3, 0, "e")]


def test_targets_across_chunks_and_medians(spark):
    docs = spark.createDataFrame([("f", 2, "END of it"), ("f", 1, "the very"), ("g", 1, None)], "filename string, place int, text string").repartition(3)
    items = spark.createDataFrame([(1, "f", "very\nend"), (2, "f", "it\nthe"), (3, "g", "x"), (4, "h", "x")], "item_id int, doc string, target string")
    assert {r.item_id: r.problem for r in E.verify_items(items, docs).collect()} == {2: "target not in document", 3: "target not in document", 4: "no such document"}
    rows = spark.createDataFrame([(1, 5.0), (1, 1.0), (1, 3.0), (2, 1.0), (2, 4.0), (2, None), (3, None)], "k int, v double")
    assert {r.k: r.m for r in rows.groupBy("k").agg(E.upper_median("v").alias("m")).collect()} == {1: 3.0, 2: 4.0, 3: None}
