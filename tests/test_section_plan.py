"""What sections shuffle: whole texts by document, and no line of them again; and headers as before."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking as C
from lodestone.queries.chunking import section_chunks


def test_lines_are_not_shuffled(spark):
    plan = section_chunks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [row for row in plan.splitlines() if "Exchange hashpartitioning(" in row]
    assert shuffles and all("REPARTITION_BY_COL" in row for row in shuffles)


@pytest.mark.parametrize("dealt", [False, True])
def test_sections_by_plain_code(spark, dealt):
    rows = [(d, i, i // 4, None if i == 5 else "Top 1" if i % 4 == 0 else f"line {chr(97 + i)} " + "x" * (i % 5) * 9) for d in range(4) for i in range(12 + d)]
    lines = spark.createDataFrame(rows, "doc_id long, idx long, page long, text string")
    lines = lines.repartition("doc_id") if dealt else lines.repartition(3, "idx")
    left = sorted(tuple(r) for r in C.drop_running_headers(lines).select("doc_id", "idx").collect())
    assert left == [(d, i) for d, i, _, text in rows if text != "Top 1"]  # lines without a text stay
    heads = lines.where((F.col("idx") % 6 == 3) & (F.col("doc_id") > 0)).select("doc_id", "idx", F.concat("text", F.lit("!")).alias("text"))
    found = {(r.doc_id, r.idx): r.heading_idx for r in C.assign_sections(lines, heads).collect()}
    under = {(d, i): max((j for j in range(i + 1) if j % 6 == 3 and d), default=None) for d, i, _, _ in rows}
    assert found == under
    want = set()
    for d, h in set((d, under[d, i]) for d, i, _, _ in rows):
        inside = [(i, t) for x, i, _, t in rows if x == d and under[d, i] == h and i != h]
        body = "\n".join(t for _, t in inside if t is not None)
        if len(body) >= C.MIN_CHARS:
            want.add((d, h, None if h is None else next(t for x, i, _, t in rows if (x, i) == (d, h)) + "!", body, len(inside)))
    assert {tuple(r) for r in C.sections(lines, heads).select("doc_id", "heading_idx", "raw_heading", "body", "n_lines").collect()} == want
