"""The blocked search against plain loops."""

import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from lodestone.operators import retrieval as R
from lodestone.operators import search as X


def six(x):
    return math.copysign(math.floor(abs(x) * 1e6 + 0.5), x) / 1e6 + 0.0


def tables(seed=1, n=90, q=9):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["cards", "bus", "glass"]
    chunks = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 25))), rnd.choice(["fa", "fb", None]), i % 4 == 0) for i in range(n)] + [(n, None, "fa", False)]
    vectors = [(i, [round(rnd.uniform(-1, 1), 2) for _ in range(5)]) for i in range(n) if i % 3]
    questions = [(i, " ".join(rnd.choices(words, k=4)), [round(rnd.uniform(-1, 1), 2) for _ in range(5)] if i % 4 else None, i % 2 == 0, rnd.choice(["fa", "fb", "fz"]), rnd.choice([["fa"], ["none"], []])) for i in range(q)]
    return chunks, vectors, questions


def frames(spark, chunks, vectors, questions):
    return (
        spark.createDataFrame(chunks, "id long, text string, family string, is_workflow boolean").repartition(3),
        spark.createDataFrame(questions, "question_id long, query string, vector array<double>, intent boolean, boost_family string, routes array<string>"),
        spark.createDataFrame(vectors, "id long, vector array<double>"),
    )


def tokens(text):
    return [w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")) else w for w in re.findall("[a-z0-9]+", (text or "").lower())]


def by_hand(chunks, vectors, questions):
    """question -> [(id, bm25, dense, family, is_workflow)]"""
    docs = {i: tokens(t) for i, t, *_ in chunks}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    vec, out = dict(vectors), {}
    for q, query, v, *_ in questions:
        rows = []
        for i, _, family, wf in chunks:
            tf = Counter(docs[i])
            b = sum(times * idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(docs[i]) / avg)) for w, times in Counter(tokens(query)).items() if tf[w])
            d = sum(x * y for x, y in zip(v or (), vec.get(i, ()), strict=False))
            rows.append((i, six(b), six(d), family, wf))
        out[q] = rows
    return out


def scaled(values):
    low, high = min(values), max(values)
    return [(x - low) / ((high - low) or 1.0) for x in values]


@pytest.mark.parametrize("block", [7, 1024])
def test_fusions_boosts_and_routes(spark, block, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", block)
    monkeypatch.setattr(X, "QUESTIONS", 4)
    data = tables()
    chunks, questions, vectors = frames(spark, *data)
    s, want = X.Search(chunks, questions, vectors), by_hand(*data)
    assert s.turns == 3
    asked = {q[0]: q for q in data[2]}

    def best(score, k=6, only=lambda q, r: True, boosts=()):
        out = []
        for q, every in want.items():
            rows = [r for r in every if only(q, r)]
            f = score(rows)
            for member, share in boosts:
                span = (max(f) - min(f)) or 1.0
                f = [six(x + (share * span if member(q, r) else 0.0)) for x, r in zip(f, rows, strict=True)]
            ranked = sorted(zip(f, rows, strict=True), key=lambda x: (-x[0], -x[1][1], x[1][0]))[:k]
            out += [(q, p, r[0], round(x, 6)) for p, (x, r) in enumerate(ranked, 1)]
        return sorted(out)

    weighted = lambda rows: [six(0.6 * b + 0.4 * d) for b, d in zip(scaled([r[1] for r in rows]), scaled([r[2] for r in rows]), strict=True)]
    got = lambda df: sorted((r.question_id, r.rank, r.id, round(r.fused, 6)) for r in df.collect())
    family = lambda q, r: r[3] == asked[q][4]
    diagram = lambda q, r: asked[q][3] and r[4]
    assert got(s.top("weighted", 6)) == best(weighted)
    assert got(s.top("weighted", 6, boosts=[("family", 0.15), ("workflow", 0.06)])) == best(weighted, boosts=[(family, 0.15), (diagram, 0.06)])
    routed = lambda q, r: "fa" not in asked[q][5] or r[3] in (None, "fa")
    assert got(s.top("weighted", 6, routed=True)) == best(weighted, only=routed)
    lexical = sorted((q, p, r[0]) for q, rows in want.items() for p, r in enumerate(sorted((r for r in rows if r[1]), key=lambda r: (-r[1], r[0]))[:3], 1))
    assert sorted((r.question_id, r.rank, r.id) for r in s.top("bm25", 3, only_shared=True).collect()) == lexical
    places = {}
    for q, rows in want.items():
        a = {r[0]: p for p, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
        b = {r[0]: p for p, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
        places[q] = [(round(1 / (60 + a[r[0]]) + 1 / (60 + b[r[0]]), 6), r) for r in rows]
    rrf = sorted((q, p, r[0], f) for q, rows in places.items() for p, (f, r) in enumerate(sorted(rows, key=lambda x: (-x[0], -x[1][1], x[1][0]))[:2], 1))
    assert got(s.rrf(2)) == rrf
    sums = {i: sum(round(r[2] * 1e6) for rows in want.values() for r in rows if r[0] == i) for i, *_ in data[0]}
    assert {r.id: r.micro for r in s.dense_sums().collect()} == sums


def test_seats_of_both_populations(spark):
    data = tables(seed=5)
    chunks, questions, vectors = frames(spark, *data)
    rows = X.Search(chunks, questions, vectors).top("weighted", 6, sides=True).drop("rank")
    held = {}
    for r in rows.collect():
        held.setdefault(r.question_id, []).append(r)
    got = {}
    for r in R.mix_floor(rows, 6).collect():
        got.setdefault(r.question_id, []).append((r.rank, r.id))
    for q, every in held.items():
        every = sorted(every, key=lambda r: (-r.fused, -r.bm25, r.id))
        seats = every[:6]
        if every[0].intent:
            for least, side in ((2, True), (2, False)):
                own = [r for r in every if r.is_workflow == side]
                have = sum(r.is_workflow == side for r in seats)
                more = [r for r in own[have:least] if r.fused >= 0.55 * every[0].fused]
                others = [r for r in seats if r.is_workflow != side]
                if more:
                    seats = [r for r in seats if r.is_workflow == side] + more + others[: max(0, len(others) - len(more))]
        assert [i for _, i in sorted(got[q])] == [r.id for r in sorted(seats, key=lambda r: (-r.fused, -r.bm25, r.id))]


def test_empty_sides(spark):
    data = tables(n=5, q=2)
    chunks, questions, vectors = frames(spark, *data)
    assert X.Search(chunks.limit(0), questions, vectors).top("weighted", 3).count() == 0
    assert X.Search(chunks, questions.limit(0), vectors).top("weighted", 3).count() == 0
    bare = X.Search(chunks.select("id", "text"), questions.select("question_id", "query"))
    assert bare.top("weighted", 3).count() == 6 and {r.dense for r in bare.top("dense", 3).collect()} == {0.0}
    assert bare.ranks(spark.createDataFrame([(0, 99)], "question_id long, id long"), ["bm25"]).count() == 0


def test_reciprocal_ranks_of_routed_populations(spark):
    """Diagrams that both channels put far down: their first ones in either channel are not their best ones."""
    n = 300
    chunks = [(i, f"common word {'x ' * (i % 37)}", "fa" if i % 2 else "fb", i >= 200) for i in range(n)]
    vectors = [(i, [math.cos(i * 0.7), (n - i) / n if i < 200 else -1 - ((i * 53) % 97) / 97]) for i in range(n)]
    questions = [(q, "common word", [0.2 * q, 1.0], True, "fa", ["fa"] if q else []) for q in range(3)]
    s, want = X.Search(*frames(spark, chunks, vectors, questions)), by_hand(chunks, vectors, questions)
    got = {(r.question_id, r.id): (r.rank, round(r.fused, 6)) for r in s.rrf(2, 1, sides=True, routed=True).collect()}
    expected = {}
    for q, rows in want.items():
        rows = [r for r in rows if not q or r[3] == "fa"]
        a = {r[0]: p for p, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
        b = {r[0]: p for p, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
        scored = sorted(((-round(1 / (1 + a[r[0]]) + 1 / (1 + b[r[0]]), 6), -r[1], r[0], r[4]) for r in rows))
        kept = sorted([x for side in (True, False) for x in [y for y in scored if y[3] == side][:2]])
        expected |= {(q, x[2]): (p, -x[0]) for p, x in enumerate(kept, 1)}
    assert got == expected


def test_the_whole_search_reads_the_question(spark):
    texts = {1: "accommodation of visitors and vendors", 2: "approval of quotations by the committee", 3: "subcontract approval procedure", 4: "tender launching and vendors", 5: "approval chain diagram of vendors"}
    families = {1: "PSE", 2: "PVMO", 3: "PCN", 4: "PTN", 5: None}
    chunks = spark.createDataFrame([(i, t, families[i], i == 5) for i, t in texts.items()], "id long, text string, family string, is_workflow boolean")
    questions = spark.createDataFrame([(1, "Accommodaton of visitors?"), (2, "aproval rules in P-CN-02"), (3, "who approves vendor tenders"), (4, "rules in P-XX-01"), (5, "")], "question_id long, query string")
    got = {}
    for fusion in ("weighted", "rrf"):
        for r in R.ask_index(chunks, questions, None, fusion=fusion, min_rel=0.0).collect():
            got.setdefault((fusion, r.question_id), []).append((r.rank, r.id, r.repaired))
    for fusion in ("weighted", "rrf"):
        assert min(got[fusion, 1])[1:] == (1, "accommodation of visitors?")
        assert {i for _, i, _ in got[fusion, 2]} == {3, 5} and min(got[fusion, 2])[2] == "approval rules in P-CN-02"
        assert len(got[fusion, 4]) == 5  # no chunk of that family: all may be found
        assert any(i == 5 for _, i, _ in got[fusion, 3])
    plain = {r.id: r.fused for r in R.ask_index(chunks, questions.where("question_id = 3"), None, boost=0.0, workflow_boost=0.0, min_rel=0.0).collect()}
    raised = {r.id: r.fused for r in R.ask_index(chunks, questions.where("question_id = 3"), None, min_rel=0.0).collect()}
    assert [i for i in texts if raised[i] > plain[i]] == [2, 4, 5]  # both hinted families, and the diagram
    with pytest.raises(ValueError, match="fusion"):
        R.ask_index(chunks, questions, fusion="sum")


def expected_rrf(want, k, c, allowed=lambda q, r: True):
    """(question, id) -> (rank, fused) of the k best of either population, by hand."""
    out = {}
    for q, rows in want.items():
        rows = [r for r in rows if allowed(q, r)]
        a = {r[0]: p for p, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
        b = {r[0]: p for p, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
        scored = sorted((-round(1 / (c + a[r[0]]) + 1 / (c + b[r[0]]), 6), -r[1], r[0], r[4]) for r in rows)
        kept = sorted(x for side in (True, False) for x in [y for y in scored if y[3] == side][:k])
        out |= {(q, x[2]): (p, -x[0]) for p, x in enumerate(kept, 1)}
    return out


def test_only_open_questions_are_searched_again(spark, monkeypatch):
    """The first rows of either channel do not settle question 1; the others are settled by their first scan."""
    n = 300
    chunks = [(i, f"common word {'x ' * (i % 37)}" if i < 200 or i % 2 else "common word other", None, i >= 200) for i in range(n)]
    vectors = [(i, [(n - i) / n if i < 200 else -1 - ((i * 53) % 97) / 97, 1.0 if i >= 200 else 0.0, i / n]) for i in range(n)]
    questions = [(0, "common word", [1.0, 0.0, 0.0], True, None, []), (1, "other", [0.0, 1.0, 0.001], True, None, []), (2, "common word", [1.0, 0.0, 0.01], True, None, [])]
    s, want = X.Search(*frames(spark, chunks, vectors, questions)), by_hand(chunks, vectors, questions)
    calls, seen = [], X.Search._each_turn

    def each(self, f, only=None):
        calls.append(None if only is None else sorted(only.tolist()))
        return seen(self, f, only)

    monkeypatch.setattr(X.Search, "_each_turn", each)
    got = {(r.question_id, r.id): (r.rank, round(r.fused, 6)) for r in s.rrf(2, 1, sides=True).collect()}
    assert got == expected_rrf(want, 2, 1)
    assert calls[:2] == [None, None] and len(calls) > 2 and all(c == [1] for c in calls[2:])


@pytest.mark.parametrize("large", [False, True])
def test_pairs_of_a_run_are_looked_up_at_once(large, monkeypatch):
    """Equal scores, ids that repeat, segments that may not be found and scores beyond whole millionths."""
    rnd, m, n = np.random.default_rng(3), 40, 5
    x = rnd.integers(-3, 4, (n, m)) * (1e13 if large else 0.25)
    x[2] = 0.0
    ids = rnd.permutation(np.repeat(np.arange(0, 40, 2), 2))
    may = np.ones((n, m), bool)
    may[1, ::3] = False
    by_id = np.argsort(ids, kind="stable")
    block = SimpleNamespace(m=m, ids=ids, by_id=by_id, id_place=ids[by_id].searchsorted(ids))
    scored = SimpleNamespace(a=0, b=n, block=block, raw=lambda name: x, six=lambda name: x, allowed=lambda recipe: may, spread=lambda y: y, empty=lambda name: False)
    q = np.repeat(np.arange(n - 1), 30)  # the last question has no pairs
    own, values = rnd.integers(-1, 41, len(q)), rnd.choice(x[0], len(q))
    wanted = X._Wanted(q, own, np.zeros(len(q)), {"dense": values}, n)
    better = X._Better({"dense": SimpleNamespace(value=lambda s: x)}, wanted)
    if not large:
        monkeypatch.setattr(X._Better, "_ties", lambda *a: pytest.fail("pairs one by one"))
    better.add(scored)
    by = np.lexsort((own, q))
    for i, place in enumerate(wanted.order["dense"]):
        at = by[place]
        row, can = x[q[at]], may[q[at]]
        assert better.n["dense"][i] == (can & ((row > values[at]) | ((row == values[at]) & (ids < own[at])))).sum()


def test_questions_without_a_vector_rank_by_id(spark):
    data = tables(seed=7)
    questions = [(q, t, None, i, f, r) for q, t, _, i, f, r in data[2]]
    got = {(r.question_id, r.id): (r.rank, round(r.fused, 6)) for r in X.Search(*frames(spark, data[0], data[1], questions)).rrf(3, sides=True).collect()}
    assert got == expected_rrf(by_hand(data[0], data[1], questions), 3, 60)


def test_the_whole_search_counts_terms_once(spark, monkeypatch):
    names, real = [], X.materialize
    monkeypatch.setattr(X, "materialize", lambda df, name="cut": names.append(name) or real(df, name))
    chunks = spark.createDataFrame([(1, "approval of visitors visitors"), (2, "approval")], "id long, text string")
    out = R.ask_index(chunks, spark.createDataFrame([(1, "visitors approval")], "question_id long, query string"), None, fusion="rrf", min_rel=0.0)
    assert [(r.rank, r.id) for r in out.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert "questions" in names and "df" not in names


def test_tasks_of_a_scan_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(X, "TASKS", 1, raising=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        data = tables(n=200)
        chunks, questions, vectors = frames(spark, *data)
        s = X.Search(chunks, questions, vectors)
        scans = s._each_turn(lambda asked, rows: s._reduce(asked, rows.repartition(30), lambda: [X._Best(X.Recipe("bm25"), 3, False, False)], X.BEST))
        assert scans.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        got = {(r.question_id, r.id): (r.rank, round(r.fused, 6)) for r in s.rrf(3, sides=True).collect()}
        assert got == expected_rrf(by_hand(*data), 3, 60)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
