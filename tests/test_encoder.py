"""The stand-in encoder against plain code."""

import hashlib

import pandas as pd
import pytest

import __spark_entry__ as entry_module
from lodestone.operators import answering as A
from lodestone.sources.files import cached_embeddings


def plain(text, dim):
    v, s = [0.0] * dim, f"  {text or ''} ".lower()
    for i in range(len(s) - 2):
        h = int.from_bytes(hashlib.blake2b(s[i : i + 3].encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = sum(x * x for x in v) ** 0.5 or 1.0
    return [x / n for x in v]


def test_each_trigram_is_hashed_once(monkeypatch):
    texts = ["abc" * 2000, None, "", "Straße İl \U0001f600 x\n", "xyz abc"]
    want = [plain(t, 64) for t in texts]
    seen, real = [], hashlib.blake2b
    monkeypatch.setattr(A.hashlib, "blake2b", lambda x, **kw: seen.append(x) or real(x, **kw))
    assert [list(v) for v in A.hashing_encoder()(pd.Series(texts))] == want
    assert len(seen) == len(set(seen)) < 50
    assert A.hashing_encoder()(pd.Series([], dtype=object)).empty


def test_texts_whose_signs_cancel_have_a_direction():
    for text in ("itu", "fub", "}"):
        assert not any(plain(text, 64))
        v = A.hashing_encoder()(pd.Series([text, "itu and more"]))
        assert abs(float((v[0] * v[0]).sum()) - 1) < 1e-9
        assert list(v[1]) == plain("itu and more", 64)


def test_cached_vectors_of_odd_texts_equal_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [None, "", " ", "itu", "}", "a", "De.", "\U0001f600", "a" * 5000, "\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = entry_module.queries()["embedding_cache"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in enumerate(texts)])
    want = con.sql(entry_module.oracle_sql()["embedding_cache"])
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_no_text_and_an_empty_one_are_cached_apart(spark, tmp_path):
    get = lambda text: cached_embeddings(spark.createDataFrame([(1, text)], "id long, embed_text string"), str(tmp_path), "m", A.hashing_encoder(8)).first()["vector"]
    assert get("") == [0.0] * 8
    assert get(None) is None
    assert get("") == [0.0] * 8
