import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking as C
from lodestone.operators import conversation as S
from lodestone.operators import geometry as P
from lodestone.operators import graph as G
from lodestone.operators import retrieval as R
from lodestone.operators import validation as V
from lodestone.operators.answering import answer, generate, hashing_encoder
from lodestone.operators.search import Recipe, Search
from lodestone.operators.spelling import repair_queries
from lodestone.sources import files
from lodestone.sources.pages import with_fallback


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


# --- retrieval -------------------------------------------------------------------------------


def scored(spark, *fused, wf=()):
    return spark.createDataFrame([(1, i, f, 0.0, i in wf, True) for i, f in enumerate(fused)], "question_id long, id long, fused double, bm25 double, is_workflow boolean, intent boolean")


def test_cutoff_and_budget(spark):
    r = R.best(scored(spark, 1.0, 0.9, 0.6, 0.5, 0.4), "fused", 5)
    assert [x[0] for x in rows(R.cutoff(r), "id")] == [0, 1, 2]
    r = R.best(scored(spark, 1.0, 0.3, 0.2, 0.1), "fused", 4)
    assert [x[0] for x in rows(R.cutoff(r), "id")] == [0, 1, 2]
    assert [x[0] for x in rows(R.context_budget(r, F.lit(10).cast("long"), 25), "id")] == [0, 1]
    assert [x[0] for x in rows(R.context_budget(r, F.lit(100).cast("long"), 25), "id")] == [0]


def test_mix_floor(spark):
    out = R.mix_floor(scored(spark, 1.0, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.3, wf=(7, 8)), 6)
    assert [r.id for r in out.orderBy("rank").collect()] == [0, 1, 2, 3, 4, 7]
    none = R.mix_floor(scored(spark, 1.0, 0.9, 0.8, 0.1, wf=(3,)), 3)
    assert [r.id for r in none.orderBy("rank").collect()] == [0, 1, 2]
    # at k = 1 both floors are one seat, and the second pass gives it to prose
    single = R.mix_floor(scored(spark, 0.9, 1.0, wf=(1,)), 1)
    assert [r.id for r in single.collect()] == [0]


def test_fusion_rejects_unknown_mode():
    with pytest.raises(ValueError, match="unknown fusion"):
        Recipe("none")


def test_route_never_empties(spark):
    c = spark.createDataFrame([(1, 1, "PCM", ["PCM"]), (1, 2, None, ["PCM"]), (1, 3, "PTN", ["PCM"]), (2, 1, "PCM", ["XX"]), (2, 3, "PTN", ["XX"])], "question_id int, id int, family string, routes array<string>")
    assert rows(R.route(c, c), "question_id", "id") == [(1, 1), (1, 2), (2, 1), (2, 3)]


# --- headings --------------------------------------------------------------------------------


def layout(spark, texts, bold=(), big=()):
    return spark.createDataFrame([(1, i, 0, t, 14.0 if i in big else 10.0, i in bold) for i, t in enumerate(texts)], "doc_id long, idx long, page long, text string, size double, bold boolean")


def test_inline_list_and_duplicate_and_run_on(spark):
    texts = ["1. PURPOSE", "body", "body", "body", "1. Red paint", "2. Blue paint", "3. White paint", "body", "5. TOOLS", "no more", "5 Buckets)", "7.1. The wall dries within", "a day or so", "5.2", "STEPS OF WORK"]
    got = C.detect_headings(layout(spark, texts, bold=(0, 8, 13)))
    assert [(r.idx, r.text) for r in got.orderBy("idx").collect()] == [(0, "1. PURPOSE"), (8, "5. TOOLS"), (13, "5.2. STEPS OF WORK")]


def test_running_headers_need_three_pages(spark):
    def pages(n):
        return spark.createDataFrame([(1, i, i, f"Page {i} of {n}", 10.0, False) for i in range(n)], "doc_id long, idx long, page long, text string, size double, bold boolean")

    assert C.running_headers(pages(2)).count() == 0
    assert rows(C.running_headers(pages(4)), "key", "n_pages") == [("Page # of #", 4)]


def test_labels(spark):
    df = spark.createDataFrame([("1. STAKHOLDER",), ("PROCESS INPUT",), ("5 Million)",), ("",)], "raw_heading string")
    got = {r.raw_heading: (r.section, r.label_method) for r in C.label_sections(df).collect()}
    assert got["PROCESS INPUT"] == ("PROCESS INPUT", "exact")
    assert got["1. STAKHOLDER"] == ("STAKEHOLDER", "fuzzy")
    assert got["5 Million)"][0] == "UNMATCHED" and got[""] == ("UNMATCHED", "empty")
    coded = C.label_sections(df, hashing_encoder())
    assert {r.label_method for r in coded.collect()} <= {"exact", "fuzzy", "embed", "below_threshold", "empty"}


def test_windows():
    assert C.windows_of("a\n\nb") == ["a\n\nb"]
    assert C.windows_of("") == []
    long = C.windows_of("x" * 3000, 1200, 150)
    assert all(len(w) <= 1352 for w in long) and "".join(long).count("x") >= 3000
    lines = "\n".join(f"line {i} " + "y" * 90 for i in range(40))
    parts = C.windows_of(lines, 500, 50)
    assert all(any(f"line {i} " in p for p in parts) for i in range(40))
    assert parts[1].startswith(parts[0][-50:].strip()[:10])


def test_routing(spark):
    p = spark.createDataFrame([("a", i, "objectives and stakeholder text of a page") for i in range(2)] + [("b", i, "x") for i in range(5)] + [("c", i, "long enough text on every page") for i in range(4)], "doc_id string, page int, text string")
    marks = F.contains("full", F.lit("OBJECTIVES")).cast("int") + F.contains("full", F.lit("STAKEHOLDER")).cast("int")
    got = {r.doc_id: (r.kind, r.why, r.signals_disagree) for r in C.routing(p, marks).collect()}
    assert got["a"] == ("process", "2 ISO sections", True)
    assert got["b"] == ("workflow", "no extractable text on any page", False)
    assert got["c"] == ("process", "4 pages", True)


# --- validation ------------------------------------------------------------------------------


def test_verdicts(spark):
    a = spark.createDataFrame([(1, "F-P-CM-01-01"), (2, "F-P-CM-09-09"), (3, "F‐P‐CM‐01‐02"), (4, "none"), (5, None)], "answer_id long, answer string")
    known = spark.createDataFrame([("F-P-CM-01-01",), ("F-P-CM-01-02",)], "code string")
    context = spark.createDataFrame([(1, "F-P-CM-01-01"), (3, "F-P-CM-01-01")], "answer_id long, text string")
    got = {r.answer_id: r.verdict for r in V.validate(a, known, context).collect()}
    assert got == {1: "clean", 2: "flagged", 3: "ungrounded", 4: "clean", 5: "clean"}
    free = {r.answer_id: (r.verdict, r.display_answer) for r in V.validate(a, known, policy="block").collect()}
    assert free[3][0] == "clean" and free[2][0] == "blocked" and "F-P-CM-09-09" in free[2][1]


def test_gaps(spark):
    schema = "nodes array<struct<id: string, label: string>>, edges array<struct<`from`: string, `to`: string>>, coverage double, warnings array<string>"
    nine = [(f"n{i}", f"L{i}") for i in range(9)]
    cases = [
        ([("a", "A"), ("b", "B"), ("o", "Lost")], [("a", "b")], 1.0, []),
        ([("a", "A"), ("b", "B")], [("a", "b")], 0.7778, ["2 of 9 text spans unclassified (x)"]),
        ([("a", "A"), ("b", "B")], [("a", "b")], 0.5, []),
        (nine, [("n0", "n1")], 1.0, []),
        ([("a", "A"), ("b", "B")], [("a", "b")], 0.0, []),
    ]
    df = spark.createDataFrame(cases, schema)
    got = [r[0] for r in df.select(V.workflow_gaps(F.col("nodes"), F.col("edges"), F.col("coverage"), F.col("warnings"))).collect()]
    assert got[0] == ["1 step(s) with no route in or out: “Lost”"]
    assert got[1] == ["2 of 9 text spans unclassified on this page"]
    assert got[2] == ["only 50% of the page's text could be placed"]
    assert got[3][0].endswith("and 3 more") and got[4] == ["only 0% of the page's text could be placed"]


def test_variants(spark):
    h = spark.createDataFrame([(1, 1, "S", "V1.pdf", "V1"), (1, 2, "S", "V3.pdf", "V3"), (1, 3, "T", "T.pdf", None), (1, 4, "S", "V1.pdf", "V1"), (1, 5, None, "x", None)], "answer_id int, rank int, family string, filename string, variant string")
    assert rows(V.variant_conflicts(h), "family", "filename", "place") == [("S", "V1.pdf", 1), ("S", "V3.pdf", 2)]


# --- graphs ----------------------------------------------------------------------------------


def graph(spark, ids, edges):
    n = spark.createDataFrame([("g", i, label, kind, k) for k, (i, label, kind) in enumerate(ids)], "graph string, id string, label string, kind string, pos int")
    e = spark.createDataFrame([("g", a, b, c, k, float(k)) for k, (a, b, c) in enumerate(edges)], "graph string, src string, dst string, condition string, pos int, head_margin double")
    return n, e


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, i) for i in range(1001, 1300)]
    loops = [(5000, 5000), (5001, None)]
    df = spark.createDataFrame(chain + hub + loops, "a long, b long")
    got = dict(rows(G.component_minimum(df), "node", "component"))
    rounds = G.connected_components(df, one_task=0)
    assert len({r.root for r in rounds.where("node <= 200").collect()}) == 1 and rounds.select("root").distinct().count() == 3 and rounds.count() == len(got)
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1300)} == {1000} and got[5000] == 5000
    assert G.component_minimum(df.limit(0)).count() == 0


def test_walks_reach_the_end_of_long_chains(spark):
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(70)] + [("g", 70, 3)], "graph string, src long, dst long")
    got = G.reachable(edges, spark.createDataFrame([("g", 0)], "graph string, id long"))
    assert sorted(rows(got, "id", "depth")) == [(i, i) for i in range(71)]


def test_sequence_stops_at_forks():
    assert G.sequence_of(["a", "b", "c"], [("a", "b", None), ("b", "c", ""), ("c", "a", "Rejected")]) == (["a", "b", "c"], False)
    assert G.sequence_of(["a", "b", "c"], [("a", "b", "under 3M"), ("a", "c", "over 3M")]) == (["a"], True)
    assert G.sequence_of(["a", "b"], [("a", "b", None), ("b", "a", None)]) == ([], False)


def test_narrative():
    text = G.narrative_of({"a": "Start", "b": "PM", "c": "COO", "d": "End"}, [("a", "b", None), ("b", "c", None), ("c", "b", "rejected"), ("c", "d", None)])
    assert text.split("\n") == ["The workflow begins with Start.", "1. The process moves to PM.", "2. The process moves to COO.", "   - If rejected, it returns to PM.", "   - If approved, it moves to End.", "3. The workflow ends once closed by COO."]
    assert G.narrative_of({"a": "A"}, []) is None
    text = G.narrative_of({"a": "Desk", "b": "Gate", "c": "Yard", "d": "Shed", "e": "Road"}, [("a", "b", None), ("a", "c", "wet"), ("b", "d", None), ("c", "d", None), ("d", "a", "late"), ("d", "a", "lost"), ("b", "e", "dry")])
    assert text.split("\n") == ["The workflow begins with Desk.", "1. A decision is made:", "   - If approved, it moves to Gate.", "   - If wet, it moves to Yard.", "2. From Gate, A decision is made:", "   - If approved, it moves to Shed.", "   - If dry, it moves to Road.", "3. From Yard, The process moves to Shed.", "4. From Shed, A decision is made:", "   - If late, it returns to Desk.", "   - If lost, it returns to Desk.", "5. The workflow ends once closed by Gate."]
    ring = G.narrative_of({"x": "One", "y": "Start here", "z": "Three"}, [("x", "y", None), ("y", "z", None), ("z", "x", None)])
    assert ring.startswith("The workflow begins with Start here.\n1. The process moves to Three.\n2. The process moves to One.\n   - If sent back, it returns to Start here.")


def test_contraction_keeps_thresholds(spark):
    n, e = graph(spark, [("a", "A", "step"), ("j1", "", "junction"), ("j2", "", "junction"), ("b", "B", "step")], [("a", "j1", None), ("j1", "j2", "Up to 70k LE"), ("j2", "b", None)])
    assert rows(G.contract_junctions(n, e), "src", "dst", "condition", "head_margin") == [("a", "b", "Up to 70k LE", 2.0)]


def test_prose_lanes_and_collapse(spark):
    n, e = graph(spark, [("a", "Start", "step"), ("b", "PM", "approver"), ("c", "start!", "step"), ("d", "Alone", "step")], [("a", "b", "over 3M"), ("c", "b", None), ("a", "c", None)])
    text = G.render_prose(n, e).first()["text"]
    assert "Steps: Start; start!; Alone." in text and "  - Start -> PM [over 3M]" in text
    assert 'A purchase value of "over 3M" requires approval by PM.' in text
    page = spark.createDataFrame([("g", "Site plan", "Main", "Rev 7")], "graph string, title string, name string, revision string")
    marks = spark.createDataFrame([("g", 0, "Over 3M", "PM"), ("g", 1, "9 K", "HR"), ("g", 2, "9 K", "HR")], "graph string, pos int, condition string, approver string")
    text = G.render_prose(n, e, page, marks).first()["text"]
    assert text.startswith("Site plan - Main\nApproval workflow: Main.\n\nSteps") and text.endswith("Thresholds recorded on this page but not tied to this flow: 9 K -> HR\n\nRev 7")
    assert {r.lane for r in G.lanes(n, e).collect()} == {"a"}
    nodes, edges = G.collapse(n, e)
    assert rows(nodes, "id", "label") == [("alone", "Alone"), ("pm", "PM"), ("start", "Start")]
    assert rows(edges, "src", "dst", "condition") == [("start", "pm", ""), ("start", "pm", "over 3M")]
    assert [r.id for r in G.orphan_nodes(n, e).collect()] == ["d"]
    assert rows(G.escalation(n, e), "condition", "approver") == [("over 3M", "PM")]


# --- geometry --------------------------------------------------------------------------------


def test_clusters_and_gutters(spark):
    s = spark.createDataFrame([(1, "over", 0.0, 0.0, 40.0, 10.0), (1, "500 K", 5.0, 12.0, 40.0, 22.0), (1, "apart", 100.0, 11.0, 140.0, 21.0)], "page long, text string, x0 double, y0 double, x1 double, y1 double")
    assert rows(P.cluster_spans(s), "text") == [("apart",), ("over 500 K",)]
    i = spark.createDataFrame([(1, 0.0, 10.0), (1, 2.0, 5.0), (1, 20.0, 30.0), (1, 33.0, 40.0)], "page int, a double, b double")
    assert rows(P.gutters(i), "centre") == [(15.0,)]


# --- sessions --------------------------------------------------------------------------------

PROBES = [
    ("Which ledger holds the yearly audit notes?", True, False), ("Who checks an invoice once the crane has left?", True, False),
    ("Can the storekeeper open a sealed crate?", True, False), ("and the other gate", False, False),
    ("At which temperature should the TM stop the pour?", True, False), ("What does shuttering mean on a site plan?", True, False),
    ("How many visitors may enter the yard at once?", True, False), ("Who seals the gate after that?", True, True),
    ("for the second shift", True, True), ("how about the night crew", True, True), ("or the older ledger?", True, True),
    ("where?", True, True), ("when does she return", True, True), ("carry on please", True, True), ("your reply stops too early", True, True),
    ("who else has to be told of a leak", True, True), ("that is only half of the list", True, True), ("Who reads them before lunch?", True, True),
]


def test_gate(spark):
    df = spark.createDataFrame(PROBES, "query string, has_history boolean, want boolean")
    wrong = S.followup_gate(df).where("is_followup <> want").collect()
    assert wrong == []


def test_modes_and_rewrites(spark):
    m = spark.createDataFrame([("a b c", True, "continuation", None), ("d", True, "junk", "the whole question here"), ("e", False, "CONTINUATION", "x")], "query string, is_followup boolean, label string, better string")
    got = S.resolve(m, F.col("label"), F.col("better"), F.lit(True)).collect()
    assert [(r.mode, r.query_used) for r in got] == [("continuation", "a b c"), ("followup", "the whole question here"), ("new", "e")]
    c = m.select(S.clean_rewrite(F.lit('\n"Here is it: who signs the form?"\nmore'), F.lit("raw")).alias("x"))
    assert c.first()["x"] in ("who signs the form?", "Here is it: who signs the form?")
    assert m.select(S.clean_rewrite(F.lit("two words"), F.lit("raw")).alias("x")).first()["x"] == "raw"


def test_spelling(spark):
    q = spark.createDataFrame([(1, "Scafolding rules P-CM-01"), (2, "scaffolding"), (3, "two scafoldings, ruels")], "query_id int, query string")
    v = spark.createDataFrame([("scaffolding", 5), ("rule", 9), ("scolding", 90)], "term string, freq long")
    got = {r.query_id: (r.repaired, len(r.repairs)) for r in repair_queries(q, v).collect()}
    assert got == {1: ("scaffolding rules P-CM-01", 1), 2: ("scaffolding", 0), 3: ("two scaffolding, ruels", 1)}


# --- generation and files --------------------------------------------------------------------


def test_generation_failures_are_values(spark):
    def g(p):
        if "slow" in p:
            raise TimeoutError
        if "odd" in p:
            raise RuntimeError
        return f"<think>x</think>ok {p}"

    df = spark.createDataFrame([("a",), ("slow",), ("odd",)], "prompt string")
    assert rows(generate(df, g), "prompt", "response", "error_type") == [("a", "ok a", None), ("odd", None, "failed"), ("slow", None, "timeout")]


def test_answer(spark):
    q = spark.createDataFrame([(1, "Which form?")], "answer_id long, question string")
    hits = spark.createDataFrame([(1, 1, "f.pdf", "S", None, "uses F-P-CM-01-01", 20)], "answer_id long, rank int, filename string, section string, label string, text string, n_chars int")
    known = spark.createDataFrame([("F-P-CM-01-01",)], "code string")
    r = answer(q, hits, lambda p: "F-P-CM-01-01" if "uses F-P-CM-01-01" in p else "?", known).first()
    assert (r.verdict, r.answer) == ("clean", "F-P-CM-01-01")


def test_files(spark, tmp_path):
    import json

    chunk = {"filename": "a.pdf", "text": "t", "graph": {"name": "l", "nodes": [{"id": "x", "label": " ", "kind": "step"}], "edges": []}}
    (tmp_path / "c.json").write_text(json.dumps([{"filename": "p.pdf", "text": "t", "unknown": 1}]))
    (tmp_path / "w.json").write_text(json.dumps([chunk, chunk | {"filename": "b.pdf", "source_type": "vlm_description", "graph": None}]))
    got = files.load_corpus(spark, str(tmp_path / "c.json"), [str(tmp_path / "none.json"), str(tmp_path / "w.json")])
    assert rows(got, "filename") == [("b.pdf",), ("p.pdf",)]
    assert rows(files.ground_truth(got), "filename") == [("p.pdf",)]
    with pytest.raises(files.CorpusMissing):
        files.load_corpus(spark, str(tmp_path / "no.json"))
    (tmp_path / "d" / "other").mkdir(parents=True)
    for name in ("a.pdf", "b.PDF", "other/c.pdf", "x.txt"):
        (tmp_path / "d" / name).write_bytes(b"x")
    assert rows(files.scan_folder(spark, str(tmp_path / "d")), "filename") == [("a.pdf",)]
    assert rows(files.scan_folder(spark, str(tmp_path / "d"), recursive=True), "filename") == [("a.pdf",), ("b.PDF",)]
    (tmp_path / "other" / "root" / "Other").mkdir(parents=True)
    (tmp_path / "other" / "root" / "Other" / "e.pdf").write_bytes(b"x")
    assert rows(files.scan_folder(spark, str(tmp_path / "other" / "root"), recursive=True), "filename") == [("e.pdf",)]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, t string")
    assert files.append_new(df, str(tmp_path / "o")) == 2 and files.append_new(df.union(spark.createDataFrame([(3, "c")], df.schema)), str(tmp_path / "o")) == 1
    assert rows(files.merge_append(df.withColumnRenamed("t", "filename"), spark.createDataFrame([(9, "b"), (9, "z")], "doc_id long, filename string")), "doc_id") == [(1,), (2,), (9,)]
    assert files.fingerprint(df, "m", "t", "doc_id") == files.fingerprint(df.orderBy(F.desc("doc_id")), "m", "t", "doc_id") != files.fingerprint(df, "n", "t", "doc_id")
    assert files.answer_log(df).first()["value"] == "doc_id=1 t=a"


def test_page_fallback(spark):
    p = spark.createDataFrame([(1, "<p>A page with quite enough text to be read.</p>"), (2, "<p>?</p>"), (3, "<b>!</b>")], "page_id long, html string")

    def read(raw):
        if "!" in raw:
            raise ValueError("no text layer")
        return "read by eye"

    assert rows(with_fallback(p, read), "page_id", "source", "ocr_error") == [(1, "native_text", None), (2, "ocr_fallback", None), (3, "ocr_failed", "no text layer")]


# --- whole diagrams --------------------------------------------------------------------------


def test_tiles_and_shared_lanes(spark):
    from lodestone.operators import diagrams as D

    n = spark.createDataFrame([(1, "t1", "Main", "a", "COO Approval", "approver", 1), (1, "t1", "Main", "b", "Start", "step", 0), (1, "t2", "main", "x", "COO approval", "approver", 2), (1, "t2", "main", "y", "Sta", "step", 3)], "page int, tile string, lane string, id string, label string, kind string, pos int")
    e = spark.createDataFrame([(1, "t1", "Main", "b", "a", None, 0), (1, "t2", "main", "b", "x", "over 3M", 1)], "page int, tile string, lane string, src string, dst string, condition string, pos int")
    nodes, edges = D.merge_tiles(n, e)
    assert rows(nodes, "id") == [("coo_approval",), ("start",)]
    assert rows(edges, "src", "dst", "condition") == [("b", "coo_approval", "over 3M"), ("start", "coo_approval", None)]
    n = spark.createDataFrame([(1, "steel", "s", 0), (1, "wood", "w", 1), (1, "page", "coo", 2), (1, "page", "vp", 3)], "page int, lane string, id string, pos int")
    e = spark.createDataFrame([(1, "steel", "s", "coo", 0), (1, "wood", "w", "coo", 1), (1, "page", "coo", "vp", 2)], "page int, lane string, src string, dst string, pos int")
    assert rows(D.shared_lanes(n, e), "lane", "id") == [("steel", "coo"), ("steel", "s"), ("steel", "vp"), ("wood", "coo"), ("wood", "vp"), ("wood", "w")]
    lanes = lambda title, hint: {r.lane for r in D.shared_lanes(n, e, spark.createDataFrame([(1, title, hint)], "page int, title string, hint string")).collect()}
    assert lanes(None, None) == lanes(" PAGE", None) == lanes("Other", "Page") == {"steel", "wood"} and lanes("Other", None) == {"steel", "wood", "page"}
    ends = spark.createDataFrame([("g", "a", "b"), ("g", "a", "z"), ("h", "q", "r")], "graph string, src string, dst string")
    known = spark.createDataFrame([("g", "a"), ("g", "b"), ("k", "x")], "graph string, id string")
    assert rows(D.dangling_edges(known, ends), "graph", "missing") == [("g", "z"), ("h", "q, r")] and rows(D.graphs_without_edges(known, ends)) == [("k",)]


def test_fragments(spark):
    from lodestone.operators import diagrams as D

    c = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0, "Below"), (1, 2, 10.2, 0.1, 10.0, 50.0, None), (1, 3, 80.0, 50.0, 10.0, 50.0, "500k"), (1, 4, 500.0, 0.0, 510.0, 0.0, None)], "page long, conn long, ax double, ay double, bx double, by double, label string")
    assert rows(D.merge_fragments(c), "ax", "ay", "bx", "by", "label", "n") == [(0.0, 0.0, 80.0, 50.0, "Below 500k", 3), (500.0, 0.0, 510.0, 0.0, "", 1)]
    fan = spark.createDataFrame([(1, i, 0.0, 0.0, x, y, t) for i, (x, y, t) in enumerate([(10.0, 0.0, "a"), (0.0, 10.0, None), (-10.0, 0.0, "b")])], c.schema)
    assert rows(D.merge_fragments(fan), "conn", "label", "n") == [(0, "a b", 1), (1, "a b", 1), (2, "a b", 1)]
    # out of a box and back to it by way of another box: two connectors, not one that ends where it begins
    walk = [(0.0, 0.0), (0.0, 60.0), (50.0, 60.0), (50.0, 0.0)]
    back = spark.createDataFrame([(1, i, *a, *b, t) for i, (a, b, t) in enumerate(zip(walk, walk[1:], ("out", None, "in"), strict=False))], c.schema)
    boxes = spark.createDataFrame([(1, 1, -20.0, -40.0, 70.0, 0.0), (1, 2, 40.0, 62.0, 90.0, 90.0)], "page long, box long, x0 double, y0 double, x1 double, y1 double")
    assert rows(D.merge_fragments(back), "ax", "ay", "bx", "by", "n") == [(0.0, 0.0, 50.0, 0.0, 3)]
    assert rows(D.merge_fragments(back, boxes), "ax", "ay", "bx", "by", "label", "n") == [(0.0, 0.0, 50.0, 60.0, "out", 2), (50.0, 60.0, 50.0, 0.0, "in", 1)]
    far = boxes.where("box = 1")
    assert rows(D.merge_fragments(back, far), "label", "n") == [("out in", 3)]


def test_stated_routes(spark):
    from lodestone.operators.scoring import answer_lines, label_hits, stated_routes

    labels = ["PM", "PM Review", "Finance", "COO"]
    assert label_hits("the PM review, then PM", labels) == ["PM Review", "PM"]
    said = "The flow begins with PM.\n1. Finance\n - over 3M goes to COO\n2. PM Review\nReturns and loops\nCOO"
    routes = spark.createDataFrame([(1, "PM", "PM Review"), (1, "Finance", "COO")], "answer_id long, src string, dst string")
    lines = answer_lines(spark.createDataFrame([(1, said)], "answer_id long, answer string"), routes)
    assert {(r.src, r.dst) for r in stated_routes(lines).collect()} == {("PM", "Finance"), ("Finance", "COO"), ("Finance", "PM Review")}


def test_saved_pages_and_gates(spark):
    from lodestone.operators import diagrams as D
    from lodestone.operators import evaluation as E

    lane = "struct<name: string, nodes: array<struct<id: string, label: string, kind: string>>, edges: array<struct<`from`: string, `to`: string, condition: string>>>"
    pages = spark.createDataFrame([("f.pdf", 2, (([("Main", [("a", "Start", "step"), ("b", "PM", "approver")], [("a", "b", "over 3M")])],)))], f"filename string, page int, graph struct<lanes: array<{lane}>>")
    r = D.lane_chunks(pages).first()
    assert (r.filename, r.page, r.section) == ("f.pdf", 2, "Main") and "  - Start -> PM [over 3M]" in r.text
    t = spark.createDataFrame([("head\nApproval thresholds:\n - x",), ("none",)], "t string")
    cut = t.withColumn("p", E.split_tail(F.col("t"), "Approval thresholds"))
    assert [tuple(r.p) for r in cut.collect()] == [("head\n", "Approval thresholds:\n - x"), ("none", "")]
    assert E.splice_gate(cut, F.concat("p.head", "p.tail"), F.col("t")).count() == 2
    with pytest.raises(ValueError, match="differ"):
        E.splice_gate(cut, F.col("p.head"), F.col("t"))
    a = spark.createDataFrame([(1, True), (2, False), (3, True)], "question_id int, hit boolean")
    b = spark.createDataFrame([(1, False), (2, True), (3, True)], "question_id int, hit boolean")
    assert rows(E.hit_flips(a, b, "hit")) == [(1, "lost"), (2, "gained")]
