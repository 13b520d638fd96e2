"""Registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry_module.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = duck.sql(entry_module.oracle_sql()[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def without_sql():
    return {n for n in set(entry_module.queries()) - set(NAMES) if not n.startswith("op") and n != "pipeline"}


def test_what_has_no_sql_is_held_against_brute_force_here():
    assert without_sql() == {"fuzzy_section_labels", "spelling_repair", "workflow_narrative", "answer_route_scores", "route_mentions"}


def test_fuzzy_labels_by_brute_force(spark, duck):
    import difflib
    import re

    from lodestone.operators.chunking import SECTIONS

    rows = entry_module.queries()["fuzzy_section_labels"](spark, SF).collect()
    names = {f"{d % 9 + 1}. " + s[: d % len(s)] + s[d % len(s) + d % 4 :] for (d,) in duck.sql("SELECT doc_id FROM documents").fetchall() for s in [SECTIONS[d % 13]]}
    assert {r.raw_heading for r in rows} == names
    for r in rows:
        bare = " ".join(re.sub("[^A-Z ]", " ", r.raw_heading.upper().lstrip("0123456789. ")).split())
        ratios = [difflib.SequenceMatcher(None, bare, s).ratio() for s in SECTIONS]
        best = max(ratios)
        if not bare:
            want = ("UNMATCHED", "empty", 0.0)
        elif bare in SECTIONS:
            want = (bare, "exact", 1.0)
        elif round(best, 3) >= 0.85:
            want = (SECTIONS[ratios.index(best)], "fuzzy", round(best, 3))
        else:
            want = ("UNMATCHED", "below_threshold", round(best, 3))
        assert (r.section, r.label_method, r.label_score) == want


def test_spelling_by_brute_force(spark, duck):
    import difflib
    import re
    from collections import Counter

    freq = Counter()
    for (text,) in duck.sql("SELECT text FROM documents").fetchall():
        for w in re.findall("[a-z0-9]+", (text or "").lower()):
            freq[w[:-1] if len(w) > 3 and w.endswith("s") and w[-2] not in "sui" else w] += 1
    by_length: dict = {}
    for w in freq:
        by_length.setdefault(len(w), []).append(w)
    best: dict = {}
    for r in entry_module.queries()["spelling_repair"](spark, SF).collect():
        out, edits = r.query, set()
        for w in sorted(set(re.findall("[a-z0-9]+", r.query.lower()))):
            one = w[:-1] if len(w) > 3 and w.endswith("s") and w[-2] not in "sui" else w
            if one not in best:
                best[one] = None
                if len(one) >= 4 and not one.isdigit() and one not in freq:
                    close = difflib.get_close_matches(one, [t for n in range(len(one) - 3, len(one) + 4) for t in by_length.get(n, ())], n=3, cutoff=0.9)
                    best[one] = max(close, key=lambda t: (difflib.SequenceMatcher(None, one, t).ratio(), freq[t])) if close else None  # noqa: B023
            if best[one]:
                edits.add(one)
                out = re.sub(rf"(?i)(?<![a-z0-9]){w}(?![a-z0-9])", best[one], out)
        assert (r.repaired, r.n_repairs) == (out, len(edits))


def walks(label, edges):
    """A plain telling of a diagram: every route in the step of the node it leaves."""
    edges = [(a, b, (c or "").strip()) for a, b, c in edges]
    ways = {}
    for a, b, c in edges:
        ways.setdefault(a, []).append((b, c))
    entered = {b for _, b, _ in edges}
    begin = [*(n for n in label if n in ways and n not in entered), *(n for n in label if "start" in label[n].lower() or "creation" in label[n].lower()), edges[0][0]][0]
    order, depth = [begin], {begin: 0}
    for n in order:
        for b, _ in ways.get(n, ()):
            if b not in depth:
                depth[b] = depth[n] + 1
                order.append(b)
    chain = [begin]
    while len(ahead := [b for b, _ in ways.get(chain[-1], ()) if b in ways and depth[b] > depth[chain[-1]]]) == 1 and ahead[0] not in chain:
        chain += ahead
    place = {n: i for i, n in enumerate(order)}
    links = set(zip(chain, chain[1:], strict=False))
    text, count = [f"The workflow begins with {label[begin]}."], 0
    for n in [*chain, *(x for x in order if x not in chain)]:
        rest = [(b, c, place.get(b, 99) < place[n]) for b, c in ways.get(n, ()) if (n, b) not in links]
        if n in chain[1:]:
            count += 1
            text.append(f"{count}. The process moves to {label[n]}.")
            told = set()
            for b, c, back in rest:
                if back and b not in told:
                    told.add(b)
                    text.append(f"   - If {c or 'sent back'}, it returns to {label[b]}.")
            rest = [x for x in rest if not x[2]]
            if len(rest) == 1:
                text.append(f"   - If {rest[0][1] or 'approved'}, it moves to {label[rest[0][0]]}.")
                continue
        if rest:
            count += 1
            lead = "" if n in chain else f"From {label[n]}, "
            if len(rest) > 1:
                text.append(f"{count}. {lead}A decision is made:")
                text += [f"   - If {c or 'approved'}, it {'returns' if back else 'moves'} to {label[b]}." for b, c, back in rest]
            else:
                ((b, c, back),) = rest
                text.append(f"{count}. {lead}{f'If {c}, the' if c else 'The'} process {'returns' if back else 'moves'} to {label[b]}.")
    closers = sorted({label[a] for a, b, _ in edges if b not in ways})
    return "\n".join([*text, *([f"{count + 1}. The workflow ends once closed by {', '.join(closers)}."] if closers else [])])


def test_narratives_by_brute_force(spark):
    from lodestone.queries import graphs

    n, e = graphs.both(spark, SF)
    labels, edges = {}, {}
    for r in n.orderBy("pos").collect():
        labels.setdefault(r.graph, {})[r.id] = r.label
    for r in e.orderBy("pos").collect():
        edges.setdefault(r.graph, []).append((r.src, r.dst, r.condition))
    got = {r.graph: r.text for r in entry_module.queries()["workflow_narrative"](spark, SF).collect()}
    assert got == {g: walks(labels[g], x) for g, x in edges.items()}


def test_route_scores_by_brute_force(spark):
    """The prose lists every route on a line of its own, so all are covered; what else it says is read from its lines here."""
    import re

    from lodestone.operators import graph as G
    from lodestone.queries import graphs

    n, e = graphs.both(spark, SF)
    name = {(r.graph, r.id): r.label for r in n.collect()}
    gold = {}
    for r in e.collect():
        a, b = name[r.graph, r.src], name[r.graph, r.dst]
        if a != b:
            gold.setdefault(r.graph, set()).add((a, b))
    prose = {r.graph: r.text for r in G.render_prose(n, e).collect()}
    for r in entry_module.queries()["answer_route_scores"](spark, SF).collect():
        want, at, said = gold[r.answer_id], None, set()
        labels = {x for pair in want for x in pair}
        for line in prose[r.answer_id].split("\n"):
            named = [x for x in re.findall(r"Step [A0-9]+", line) if x in labels]
            if not line.strip():
                continue
            said |= set(zip(named, named[1:], strict=False))
            if named and at:
                said.add((at, named[0]))
            if named and not line.lstrip().startswith("-"):
                at = named[-1]
        said = {(a, b) for a, b in said if a != b}
        assert (r.gold, r.covered, r.asserted) == (len(want), len(want & said), len(said - want)) and r.covered == r.gold


def test_entry(spark, duck):
    assert entry_module.entry(spark).count() > 0


def test_route_mentions_reads_whole_answers(spark):
    from lodestone.functions.text import workflow_routes
    from lodestone.operators import graph as G
    from lodestone.queries import graphs

    n, e = graphs.both(spark, SF)
    told = {r.graph: r.text.lower() for r in G.narrative(n, e).collect()}
    prose = G.render_prose(n, e)
    want = {}
    for r in prose.select("graph", workflow_routes(prose["text"]).alias("routes")).collect():
        if r.routes:
            want[r.graph] = (len(r.routes), sum(x.src.lower() in told.get(r.graph, "") and x.dst.lower() in told.get(r.graph, "") for x in r.routes))
    got = {r.answer_id: (r.routes, r.mentioned) for r in entry_module.queries()["route_mentions"](spark, SF).collect()}
    assert got == want and sum(m for _, m in got.values()) > 0
