"""Evaluation, answering, settings, sinks and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import answering as A
from lodestone.operators import conversation as S
from lodestone.operators import diagrams as D
from lodestone.operators import evaluation as E
from lodestone.operators import pages as P
from lodestone.settings import Settings
from lodestone.sources import files


def test_outcomes(spark):
    rows = [
        (1, "en", "none", None, [], "That is not specified.", [], None),
        (2, "en", "none", None, [], "It is 5 days.", ["d"], None),
        (3, "en", "d", "manual", ["x"], "?", ["d"], None),
        (4, "en", "d", None, ["5 Days", "COO"], "the coo within 5 days", ["d"], True),
        (5, "ar", "d", None, ["5 days", "the COO"], "خلال 5 أيام", ["e"], None),
        (6, "ar", "d", None, ["the COO"], None, ["d"], None),
        (7, "ar", "d", None, ["F-P-CM-01-02"], "f-p-cm-01-03", ["d"], None),
        (8, "en", "d", None, ["5 days"], None, ["d"], None),
    ]
    df = spark.createDataFrame(rows, "id int, lang string, doc string, scoring string, targets array<string>, answer string, docs array<string>, reused boolean")
    got = {r.id: (r.outcome, r.doc_hit, r.missed) for r in E.outcomes(df).collect()}
    assert got == {1: ("ok", None, []), 2: ("INVENTED", None, []), 3: ("manual", True, []), 4: ("ok", None, []), 5: ("ok", False, []), 6: ("n/a", True, []), 7: ("WRONG", True, ["F-P-CM-01-02"]), 8: ("WRONG", True, ["5 days"])}
    r = E.outcome_rates(E.outcomes(df)).first()
    assert (r.n, r.ok, r.scored, r.docs, r.doc_hits, r.manual, r.not_scoreable, r.rate) == (8, 3, 6, 5, 4, 1, 1, 0.5)
    assert E.answerable(df).count() == 6


def test_gold_is_whole_passages(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a red gate. a red gate."), (2, "a red gat"), (3, None), (4, "x[ab]*")], "id long, text string")
    items = spark.createDataFrame([(7, "red gate"), (8, "red gate"), (9, "[ab]*"), (10, ""), (11, None)], "question_id long, passage string")
    for most in (5000, 2):
        monkeypatch.setattr(E, "PASSAGES", most)
        assert sorted(map(tuple, E.gold_pairs(items, docs).collect())) == [(7, 1), (8, 1), (9, 4)]
    assert E.gold_pairs(items.limit(0), docs).count() == 0


def test_bad_requests_are_made_once_more(spark):
    def picky(p):
        raise A.BadRequest("no such option")

    df = spark.createDataFrame([("a",)], "prompt string")
    assert A.generate(df, picky, plain=lambda p: "plain " + p).first().response == "plain a"
    assert A.generate(df, picky).first().error_type == "bad_response"


def test_labels_and_rewrites_fall_back(spark):
    said = [("Label: CONTINUATION", "CONTINUATION"), ("I think FOLLOWUP or CONTINUATION\nCONTINUATION", "FOLLOWUP"), ("well\ncontinuation!", "CONTINUATION"), ("", "FOLLOWUP"), (None, "FOLLOWUP"), ("DISCONTINUATION", "FOLLOWUP")]
    df = spark.createDataFrame(said, "said string, want string")
    assert df.where(S.clean_label(F.col("said")) != F.col("want")).count() == 0
    m = spark.createDataFrame([(1, "carry on", "Q: a", True), (2, "fail", "Q: a", True), (3, "Who signs the form?", None, False)], "id int, query string, history string, is_followup boolean")

    def model(p):
        if "fail" in p:
            raise ConnectionError
        return "CONTINUATION" if p.startswith(A.LABEL_TASK) else "Who else signs the form?"

    told = A.classify(m, model)
    assert {r.id: r.label for r in told.collect()} == {1: "CONTINUATION", 2: "FOLLOWUP", 3: "FOLLOWUP"}
    told = A.rewrite(m.withColumn("mode", F.when(F.col("is_followup"), "followup").otherwise("new")), model)
    assert {r.id: r.rewritten for r in told.collect()} == {1: "Who else signs the form?", 2: "fail", 3: "Who signs the form?"}


def test_arabic_questions_and_withheld_answers(spark):
    hit = "rank int, filename string, section string, family string, variant string, text string"
    m = spark.createDataFrame([(1, "ما هو نموذج مدير المشروع", None, None, None)], f"answer_id long, question string, history string, previous_answer string, previous_hits array<struct<{hit}>>")
    hits = spark.createDataFrame([(1, 1, "a.pdf", "s", None, None, "F-P-CM-01-01 is the form")], f"answer_id long, {hit}")
    asked = []

    def model(p):
        if p.startswith("Translate from Arabic"):
            return "Which form does the GZ0GZ use?"
        if p.startswith("Translate from English"):
            return "محجوب ZQ0ZQ"
        return "Use F-P-CM-09-09" if "Which form does the PM use?" in p and A.ARABIC_RULE in p else "?"

    known = spark.createDataFrame([("F-P-CM-01-01",)], "code string")
    out = A.ask(m, lambda q: asked.append(q) or hits.join(q.select("answer_id"), "answer_id"), model, known, policy="block").first()
    assert (out.mode, out.query_used, out.verdict, out.display_answer, out.recorded) == ("new", "Which form does the PM use?", "blocked", "محجوب F-P-CM-09-09", "Use F-P-CM-09-09")


def test_arabic_items_are_made_once(spark):
    items = spark.createDataFrame([(1, "Who signs P-CM-01?", "x"), (2, "Which form?", "y")], "id int, question string, doc string")
    asked = lambda p: "ترجمة ZQ0ZQ" if "ZQ0ZQ" in p.split("\n\n")[-1] else "ترجمة"
    first = A.arabic_items(items.where("id = 1"), asked)
    assert [(r.question, r.question_en, r.doc, r.review) for r in first.collect()] == [("ترجمة P-CM-01", "Who signs P-CM-01?", "x", "machine")]
    held = spark.createDataFrame([(1, "قديم", "Who signs P-CM-01?", "x", "human")], "id int, question string, question_en string, doc string, review string")
    got = {r.id: (r.question, r.review) for r in A.arabic_items(items, asked, held).collect()}
    assert got == {1: ("قديم", "human"), 2: ("ترجمة", "machine")}


def faults(spark, answer, routes, text=""):
    from lodestone.operators import scoring as S

    answers = spark.createDataFrame([(1, answer, text)], "answer_id long, answer string, text string")
    table = spark.createDataFrame([(1, *r) for r in routes], "answer_id long, src string, dst string, condition string")
    lines = S.answer_lines(answers, table)
    pairs = lambda df, *c: [tuple(r) for r in df.orderBy("line_no").select(*c).collect()]
    said = {(r.src, r.dst) for r in S.stated_routes(lines).collect()}
    return pairs(S.borrowed_conditions(lines, table), "src", "condition"), pairs(S.wrong_branches(lines, table), "src", "dst"), [x for (x,) in pairs(S.false_decisions(lines, table), "label")], [r.quote for r in S.unsupported_quotes(answers).collect()], said


def test_faults_of_answers(spark):
    routes = [("Desk", "Gate", "over 5 M"), ("Desk", "Yard", None), ("Gate", "Road", "dry")]
    answer = 'The workflow begins with Desk.\n1. A decision is made:\n   - If over 5 M, it moves to Gate.\n   - If dry, it moves to Yard.\n   - If approved, it moves to Road.\n2. The process moves to Gate. A decision is made:\n   - If "dry season", it moves to Road.\nReturns and loops:\n- Yard -> Desk'
    borrowed, wrong, decisions, quotes, said = faults(spark, answer, routes, "Desk -> Gate [over 5 M], Gate -> Road [dry]")
    assert (borrowed, wrong, decisions, quotes) == ([("Desk", "dry")], [("Desk", "Road"), ("Gate", "Yard")], ["Gate"], ["dry season"])  # no heading ends a decision's bullets
    assert ("Yard", "Desk") in said and ("Gate", "Yard") not in said and ("Road", "Yard") not in said  # the list of returns is no part of the walk


def test_plain_lines_move_the_walk_but_not_the_step(spark):
    routes = [("Desk", "Gate", "over 5 M"), ("Desk", "Yard", None)]
    answer = "1. The process moves to Desk. A decision is made:\nThe Gate is informed first.\n- If over 5 M, it moves to Gate.\n- If approved, it moves to Yard.\nLater a decision is made:"
    borrowed, wrong, decisions, quotes, said = faults(spark, answer, routes)
    assert (borrowed, wrong, decisions, quotes) == ([], [], [], [])
    assert said == {("Desk", "Gate"), ("Gate", "Yard")}  # the walk stands on the Gate


def retold(answer, labels, routes, text):
    """What the docstrings say, line by line."""
    import re

    norm = lambda x: " ".join(re.findall("[a-z0-9]+", (x or "").lower()))
    walk = step = None
    deciding, said, decisions, borrowed, wrong = False, set(), 0, 0, 0
    out_of = lambda n: [r for r in routes if r[0] == n]
    for line in answer.split("\n"):
        if not line.strip():
            continue
        named = [x for x in re.findall("[A-Z][a-z]+", line) if x in labels]
        lead, bullet = "begins with" in line.lower(), line.lstrip()[0] in "-*•"
        head = lead or bool(re.match(r"\s*\d+[.)]", line))
        if re.search("a decision is made", line, re.I):
            at = named[-1] if named else step
            decisions += at is not None and len(out_of(at)) < 2
        if bullet and not head and deciding and step:
            wrong += bool(named) and named[0] not in [r[1] for r in out_of(step)]
            cands = re.findall(r'"([^"]{3,80})"', line) or re.findall(r"^\s*[-*•]\s*If\s+(.+?)\s*,", line)
            for c in map(norm, cands):
                if not c or c in ("approved", "sent back", "further action is required"):
                    continue
                owners = {r[0] for r in routes if r[2] and (norm(r[2]) in c or c in norm(r[2]))}
                if owners and step not in owners:
                    borrowed += 1
                    break
        if head:
            deciding = bool(re.search("a decision is made", line, re.I))
            step = named[-1] if named else step
        if re.match(r"\s*(returns and loops|send-backs)", line, re.I):
            walk = None
            continue
        said |= set(zip(named, named[1:], strict=False))
        if named and walk and not lead:
            said.add((walk, named[0]))
        if named and (head or not bullet):
            walk = named[-1]
    said, want = {p for p in said if p[0] != p[1]}, {(a, b) for a, b, _ in routes}
    quotes = sum(norm(q) != "" and norm(q) not in norm(text) for q in re.findall(r'"([^"]{3,80})"', answer))
    return len(want), len(want & said), len(said - want), quotes, decisions, borrowed, wrong


def test_scores_against_plain_code(spark):
    import random

    from lodestone.operators import scoring as S

    rng, names = random.Random(3), ["Desk", "Gate", "Yard", "Road", "Dock"]
    conditions = [None, "", "over 5 M", "dry", "approved", "Dry season!"]
    parts = ["1. ", "2) ", "- ", "  * ", "• ", "", "", "Returns and loops: ", "Send-backs ", "begins with ", "a decision is made: ", "If dry, ", "If  over 5 M , ", "If approved, ", '"dry" ', '"wet or dry season" ', '"!!!" ', "\n", "\n", "\n", "   \n", "to Desk ", "Gate ", "Yard and Road ", "the Dock ", "\n1. Desk. A decision is made:\n- If over 5 M, to Gate\n", "\n2. Road. A decision is made:\n* If \"dry\", to "]
    answers, routes = [], []
    for i in range(120):
        table = [(rng.choice(names), rng.choice(names), rng.choice(conditions)) for _ in range(rng.randint(1, 6))]
        routes += [(i, *r) for r in table]
        answers.append((i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))), "Desk [dry season]"))
    a = spark.createDataFrame([*answers, (500, None, None), (501, "1. Desk to Gate", None)], "answer_id long, answer string, text string")
    r = spark.createDataFrame([*routes, (502, "Desk", "Gate", None)], "answer_id long, src string, dst string, condition string")
    got = {x.answer_id: (x.gold, x.covered, x.asserted, x.quotes, x.decisions, x.borrowed, x.wrong) for x in S.score_answers(a, r).collect()}
    for i, answer, text in answers:
        own = [x[1:] for x in routes if x[0] == i]
        assert got[i] == retold(answer, {n for x in own for n in x[:2]}, own, text), (answer, own)
    assert got[500] == got[501] == (0,) * 7 and got[502] == (1, 0, 0, 0, 0, 0, 0)
    assert all(sum(g[k] for g in got.values()) > 0 for k in range(7))


def test_empty_pages(spark):
    d, s = spark.createDataFrame([], P.DRAWINGS), spark.createDataFrame([], P.SPANS)
    page = spark.createDataFrame([(1, 100.0, None)], "page long, height double, title_hint string")
    made = P.assemble(d, s, page)
    assert made.nodes.count() == made.edges.count() == 0
    r = made.pages.first()
    assert (r.coverage, r.unclassified, r.lost_amounts, r.warnings) == (1.0, [], [], [])


def test_settings():
    s = Settings({"A": " x ", "B": "", "C": "12", "D": "1x"})
    assert (s.text("A", "d"), s.text("B", "d"), s.number("C", 1), s.number("D", 5), s.number("E", 7)) == ("x", "d", 12, 5, 7)
    assert s.bad == [("D", "1x", 5)] and s.summary({"A": "y", "C": 0}) == {"A": "x", "C": 12}


def test_json_sinks_and_the_command_line(spark, tmp_path):
    from lodestone import __main__ as cli

    df = spark.createDataFrame([(1, "é\n1. Alpha beta\nsome body text that is long enough to stay"), (2, None)], "doc_id long, text string")
    assert files.write_json_array(df, str(tmp_path / "a.json")) == 2
    assert json.loads((tmp_path / "a.json").read_text("utf-8"))[1] == {"doc_id": 2, "text": None} and "é" in (tmp_path / "a.json").read_text("utf-8")
    with pytest.raises(ValueError, match="write_json"):
        files.write_json_array(df, str(tmp_path / "b.json"), most=1)
    df.write.parquet(str(tmp_path / "d"))
    args = cli.parser().parse_args(["chunk", "--documents", str(tmp_path / "d"), "--out", str(tmp_path / "o")])
    files.write_json(cli.run(spark, args), args.out)
    assert [r.made_by for r in spark.read.json(args.out).collect()] == ["window"]
    spark.createDataFrame([(5, "alpha body")], "question_id long, query string").write.parquet(str(tmp_path / "q"))
    for fusion in ("weighted", "rrf"):
        args = cli.parser().parse_args(["search", "--documents", str(tmp_path / "d"), "--questions", str(tmp_path / "q"), "--out", "x", "--fusion", fusion])
        assert [r.id for r in cli.run(spark, args).orderBy("rank").collect()] == [1, 2]
