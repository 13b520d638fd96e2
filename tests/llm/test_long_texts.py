"""Very long texts in pieces, rows that repeat, languages with long texts only; every token by a plain network."""

import random
import tracemalloc

import numpy as np
import pytest

from lodestone.llm import langid, simhash
from lodestone.llm.queries import op3_language_id

SF = "/root/testdata/sf0.001"


def odd_text(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(["a", "B", "Été", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", "漢", "longer", "."]) for _ in range(n))


@pytest.mark.parametrize("size", [1, 2, 5, 17])
def test_fingerprints_in_pieces(size):
    for seed in range(30):
        text = odd_text(seed, seed * 3).encode()
        assert simhash.fingerprint(text, size) == simhash.fingerprint(text)
        assert b"".join(simhash.pieces(text, size)) == text
    assert simhash.fingerprint(b" \t ", size) == 0


def test_a_long_text_has_its_fingerprint_in_little_memory():
    text = " ".join(f"word{i % 99_991}" for i in range(2_500_000)).encode()
    tracemalloc.start()
    simhash.fingerprint(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20, peak


@pytest.mark.parametrize("size", [1, 2, 5, 17])
def test_pieces_have_the_tokens_of_the_text(size):
    for seed in range(30):
        text = odd_text(seed, seed * 3)
        assert [t for p in langid.pieces(text, size) for t in p.split()] == text.split()


def test_prediction_of_a_long_text_takes_memory_by_its_different_tokens():
    reader = langid.Reader(langid.BiGru([f"l{i}" for i in range(60)], 4))
    text = " ".join(f"word{i % 2000}" for i in range(1_000_000))
    reader.predict([text[:10_000]])
    tracemalloc.start()
    reader.predict([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20, peak


def test_rows_that_share_an_id_keep_their_language(docs):
    rows = [(i, f"plain text number {i}", "en", "s") for i in range(60)] + [(1001, f"deutscher Text Nummer {i % 7}", "de", "s") for i in range(3000)] + [(1002, "le texte", "fr", "s")] * 2000
    got = langid.sample(docs(rows), "doc_id", "text", "lang")
    assert {lang for lang, _ in got} == {"en", "de", "fr"}
    assert sum(lang == "fr" for lang, _ in got) == 1 and len({t for lang, t in got if lang == "de"}) == 7


def test_a_language_with_long_texts_only_is_learned_from_their_beginnings(docs, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 30)
    rows = [(i, "short text", "en", "s") for i in range(10)] + [(i, "x" * 31, "en", "s") for i in range(20, 30)] + [(i, "ein langer Text " * 9, "de", "s") for i in range(50, 60)]
    got = langid.sample(docs(rows), "doc_id", "text", "lang")
    assert {t for lang, t in got if lang == "en"} == {"short text"}
    assert {t for lang, t in got if lang == "de"} == {("ein langer Text " * 9)[:30]}


def test_the_query_against_a_plain_network(spark):
    """Every token on its own, nothing remembered, means over all positions."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(langid.sample(table, "doc_id", "text", "lang"))
    found = {r.doc_id: r for r in op3_language_id(spark, SF).collect()}
    rows = table.where("length(text) < 1500").collect()
    assert len(found) == table.count() and len(rows) > 30
    for r in rows[:60]:
        sums = np.zeros(len(model.classes) + 1)
        for token in (r.text or "").split():
            for w in langid.windows_of(token):
                sums += model.sums([w])[0]
        got = found[r.doc_id]
        if not sums[-1]:
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        p = sums[:-1] / sums[-1]
        assert got.score == pytest.approx(p.max(), abs=1e-4) and p[model.classes.index(got.lang_pred)] == pytest.approx(p.max(), abs=1e-4)
