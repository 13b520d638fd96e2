"""What grows with the tables: results on odd inputs, and plans that keep to their input."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import diagrams as D
from lodestone.operators import geometry as P
from lodestone.operators import graph as G
from lodestone.operators import pages as A
from lodestone.operators import validation as V
from lodestone.plans import sizes


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def names_one_by_one(slugs):
    taken = []
    for s in slugs:
        name, n = s, 2
        while name in taken:
            name, n = f"{s}_{n}", n + 1
        taken.append(name)
    return taken


def test_ids_of_a_page_without_an_array(spark):
    pages = {1: ["a", "a", "a_2", "b", "a"], 2: ["a_2", "a", "a", "a_2", "a", "a_2_2", "a_2"], 3: ["a_1", "a_1", "a", "a_02", "a"], 4: ["x_3", "x_3", "x", "x", "x", "x_3_2"], None: ["k", "k_2", "k"], 5: [f"step_{i % 4}" for i in range(2000)]}
    given = [(p, i, s) for p, slugs in pages.items() for i, s in enumerate(slugs)]
    out = A.unique_ids(spark.createDataFrame(given, "page int, box int, slug string"), "page", "box")
    assert "collect_list" not in optimized(out)
    got = {(r.page, r.box): r.id for r in out.collect()}
    assert got == {(p, i): n for p, slugs in pages.items() for i, n in enumerate(names_one_by_one(slugs))}
    assert out.where(F.col("id").isNull()).isEmpty()


def test_labels_of_a_page_are_compared_once(spark):
    printed = [(1, i, f"Label  {i % 50}") for i in range(400)] + [(1, 900, "abel 4"), (1, 901, "ab\nc d"), (2, 1, "Only"), (3, 1, "7 of 9")]
    strings = [(1, f"label {i % 50}") for i in range(0, 400, 2)] + [(1, "x ab"), (1, "c d y"), (1, None)]
    out = D.missing_labels(spark.createDataFrame(printed, "page int, idx int, text string"), spark.createDataFrame(strings, "page int, text string"))
    assert "LeftAnti" in optimized(out)
    want = {(1, f"Label {i}") for i in range(1, 50, 2)} - {(1, f"Label {i}") for i in (1, 3)} | {(1, "ab c d"), (2, "Only")}
    want |= {(1, f"Label {i}") for i in (1, 3) if not any(f"label {i}" in (s or "") for _, s in strings)}
    assert {(r.page, r.line) for r in out.collect()} == want


def test_boxes_out_of_reach_are_not_sorted(spark):
    at = spark.createDataFrame([(1, 0, 0.0, 0.0, 200.0, 0.0), (1, 1, 0.0, 90.0, 200.0, 90.0)], "page int, conn int, ax double, ay double, bx double, by double")
    boxes = spark.createDataFrame([(1, 0, -50.0, -10.0, -5.0, 10.0), (1, 1, 210.0, -10.0, 250.0, 10.0), (1, 2, 900.0, 900.0, 950.0, 950.0), (1, 3, 205.0, 85.0, 240.0, 95.0)], "page int, box int, x0 double, y0 double, x1 double, y1 double")
    out = P.direct_edges(at, boxes, spark.createDataFrame([(1, 205.0, 0.0)], "page int, hx double, hy double"))
    assert any("Join" in x and "<= 30.0" in x for x in optimized(out).splitlines())
    assert [tuple(r) for r in out.collect()] == [(1, 0, 0, 1, 200.0)]


def test_many_small_graphs_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(G, "_jumps", lambda steps: (_ for _ in ()).throw(AssertionError("rounds over small graphs")))
    edges = spark.createDataFrame([(g, i, (i + 1) % 7) for g in range(60) for i in range(6)], "graph long, src long, dst long")
    starts = spark.createDataFrame([(g, g % 7) for g in range(60)], "graph long, id long")
    got = G.reachable(edges, starts, one_task=40)
    assert sorted(map(tuple, got.collect())) == sorted((g, i, i - g % 7) for g in range(60) for i in range(g % 7, 7))


def test_large_and_small_graphs_together_without_broadcasts(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(90)] + [(0, 5, 60)] + [(g, 0, 1) for g in range(1, 30)], "graph long, src long, dst long")
    got = G.reachable(edges, spark.createDataFrame([(g, 0) for g in range(30)], "graph long, id long"), one_task=20)
    assert sorted(map(tuple, got.collect())) == sorted([(0, i, i if i < 60 else i - 54) for i in range(91)] + [(g, i, i) for g in range(1, 30) for i in range(2)])


def test_a_context_that_answers_share_is_not_repeated(spark):
    answers = spark.createDataFrame([(1, 7, "see F-P-CM-01-02"), (2, 7, "see F-P-CM-03-04"), (3, 8, "see F-P-CM-01-02"), (4, None, "see F-P-CM-01-02"), (5, 7, "see F-P-CM-09-09")], "answer_id long, k long, answer string")
    texts = spark.createDataFrame([(7, "by F-P-CM-01-02"), (7, "again F-P-CM-01-02"), (8, "by F-P-CM-03-04")], "k long, text string")
    out = V.validate(answers, V.code_whitelist(texts), texts, context_key="k")
    alone = V.validate(answers, V.code_whitelist(texts), answers.join(texts, "k").select("answer_id", "text"))
    got = {r.answer_id: (r.verdict, r.unknown, r.ungrounded) for r in out.collect()}
    assert got == {r.answer_id: (r.verdict, r.unknown, r.ungrounded) for r in alone.collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "clean", 2: "ungrounded", 3: "ungrounded", 4: "ungrounded", 5: "flagged"}


@pytest.mark.parametrize("kind", [pa.string(), pa.list_(pa.string())])
def test_pieces_of_a_batch(kind):
    values = ["a" * n if kind == pa.string() else ["a"] * n for n in (3, 0, 50, 4, 4, 4, 0, 9)]
    values.insert(2, None)
    whole = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(values, kind)], ["id", "x"])
    for batch in (whole, whole.slice(2, 6), whole.slice(0, 0)):
        parts = list(sizes.pieces(batch, 1, 12))
        assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
        assert all(p.num_rows == 1 or sum(len(x or "") + 1 for x in p.column(1).to_pylist()) <= 12 for p in parts)


def test_rounds_of_components_send_nothing_through_the_driver(spark, monkeypatch):
    plans, keep = [], G.materialize

    def seen(df, name="cut"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(G, "materialize", seen)
    edges = spark.createDataFrame([(i, i + 1) for i in range(12) if i != 5], "a long, b long")
    roots = {r.node: r.root for r in G.connected_components(edges, one_task=3).collect()}
    assert len({roots[i] for i in range(6)}) == len({roots[i] for i in range(6, 13)}) == 1 and roots[0] != roots[6]
    assert any("Join" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)
