"""The audit of filters: scans in blocks, equal keys of different words, orders by brute force."""

import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from conftest_rows import odd_rows

from lodestone.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def scanned(texts, block):
    column = pa.array([t.encode() for t in texts], pa.binary())
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    s = fa.Scan(data, np.frombuffer(column.buffers()[1], np.int32)[: len(texts) + 1], "#$%&*|", block)
    return list(zip(s.words.tolist(), s.distinct.tolist(), s.capitals.tolist(), s.symbols.tolist(), s.points.tolist(), strict=True))


def plain(text):
    words = WORD.findall(text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text)


def texts(seed, n):
    rng = np.random.default_rng(seed)
    letters = list("aAbB é漢🙂#|\n\t \x0b\x1c\x85") + [" "]
    out = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(n)]
    out += ["", "x" * 200, "x" * 199 + "y " + "x" * 200 + " " + "x" * 199 + "y", "tail"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block", [1, 3, 16, 64, 100, 1 << 20])
def test_scan_counts_as_plain_code(block):
    for seed in range(4):
        said = texts(seed, 40)
        assert scanned(said, block) == [plain(t) for t in said]


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_words_of_one_key_are_told_apart(block, monkeypatch):
    monkeypatch.setattr(fa, "_stir", lambda x: np.ones_like(x))
    said = texts(1, 30)
    assert scanned(said, block) == [plain(t) for t in said]


def test_different_words_of_a_long_text_are_merged(monkeypatch):
    monkeypatch.setattr(fa, "MERGE", 50)
    text = " ".join(f"w{i % 700}" for i in range(5000))
    assert scanned(["a b", text, "", "w1 w1"], 256) == [plain(t) for t in ("a b", text, "", "w1 w1")]


def brute(rows, labels):
    fails = []
    for i, text, lang, _ in rows:
        words, distinct, capitals, symbols, points = plain(text or "")
        fail = {"A": words < 100, "B": 100 * distinct < 80 * words, "C": 100 * capitals > 10 * points, "D": symbols > 0}
        fail["E"] = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _, _ in rows)
        q, x = (any(d == i and i is not None and v[k] == 1 for d, *v in labels) for k in (0, 1))
        fails.append((lang or "", fail, q, x))
    out = set()
    for part in {f[0] for f in fails}:
        docs = [f for f in fails if f[0] == part]
        rows_of, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, c in enumerate(order, 1):
                gone = [d for d in left if d[1][c]]
                total[c] += len(gone)
                kept = [d for d in left if not d[1][c]]
                redundant = sum(d[1][c] for d in docs) - len(gone)
                unique = sum(d[1][c] and sum(d[1].values()) == 1 for d in docs)
                rows_of.append(("".join(order), step, len(kept), len(gone), redundant, unique, sum(d[2] for d in gone), sum(d[3] for d in gone)))
                left = kept
        out |= {(part, *r, total[r[0][r[1] - 1]]) for r in rows_of}
    return out


def test_audit_against_brute_force(spark, docs):
    good = " ".join(f"word{i}" for i in range(120))
    rows = [*odd_rows(), (10, good, "en", "s"), (11, good, "de", "s"), (12, good + " | more", None, "s"), (13, good.upper(), "", "s"), (14, good, "de", "s"), (10, good, "en", "s"), (15, "Alpha " * 200, "en", "s")]
    labels = [(10, 1, 0), (11, 1, 1), (11, 0, 0), (12, None, 1), (None, 1, 1), (99, 1, 1), (4, 1, 0)]
    table = spark.createDataFrame([(*r, "m", 1) for r in labels], "doc_id long, quality int, toxic int, mask string, part int")
    found = fa.filter_audit(docs(rows), table).collect()
    assert len(found) == 600 * len({r[2] or "" for r in rows})
    assert {tuple(r) for r in found} == brute(rows, labels)


def test_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.filter_audit(docs([]), labels).collect() == []
    assert fa.filter_audit(docs([(1, None, None, None)]), labels).where("step = 1 and filter_order like 'A%'").first()["removed"] == 1


def test_a_long_text_takes_little_memory():
    import tracemalloc

    text = b" ".join(b"w%d" % (i % 50_000) for i in range(3_000_000))
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    tracemalloc.start()
    s = fa.Scan(data, offsets, "#")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (s.words[0], s.distinct[0]) == (3_000_000, 50_000)
    assert peak < 120 << 20, peak
