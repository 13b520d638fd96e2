"""Token files: exact round trips, ids of the library itself, damage that is noticed."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_rows import odd_rows
from pyspark.sql import functions as F

from lodestone.llm import range_coder as rc
from lodestone.llm import token_files as tf
from lodestone.llm.queries import op11_token_files, tokenizer_path
from lodestone.llm.tokens import Memory, WordBpe


def ids_like_text(n, seed=0):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 49_000, 500)
    return np.where(rng.random(n) < 0.8, words[(rng.zipf(1.3, n) - 1) % 500], rng.integers(0, 49_384, n))


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 299, 300, 301, 2999])
@pytest.mark.parametrize("length", [1, 7, 300])
def test_round_trip(n, length):
    ids = ids_like_text(n)
    payloads = rc.encode(ids, length, 50_000)
    assert len(payloads) == -(-n // length)
    assert (rc.decode(payloads, n, length, 50_000) == ids).all()


@pytest.mark.parametrize("ids", [np.zeros(5000), np.arange(5000), np.arange(5000)[::-1], np.full(777, rc.MOST_IDS - 1), np.tile([1, 2, 3], 2000)])
def test_round_trip_of_plain_series(ids):
    ids = ids.astype(np.int64)
    payloads = rc.encode(ids, 1000, int(ids.max()) + 1)
    assert (rc.decode(payloads, len(ids), 1000, int(ids.max()) + 1) == ids).all()


def test_blocks_do_not_depend_on_one_another():
    ids = ids_like_text(5000)
    together = rc.encode(ids, 512, 50_000)
    for i in (0, 3, 9):
        part = ids[i * 512 : (i + 1) * 512]
        assert rc.encode(part, 512, 50_000) == [together[i]]
        assert (rc.decode([together[i]], len(part), 512, 50_000) == part).all()


def test_what_repeats_takes_little_room():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 49_000, 40)
    assert sum(map(len, rc.encode(np.tile(phrase, 50), 2048, 50_000))) < 400
    assert sum(map(len, rc.encode(ids_like_text(20_000), 2048, 50_000))) < 2 * 20_000  # two bytes an id


def segment(block=100):
    ids = ids_like_text(1050).astype(np.int32)
    return ids, tf.pack_segment(ids, ["1", None, "ü", "4"], [500, 1, 0, 549], 7, 3, block)


@pytest.mark.parametrize("step", [1, 3, 2048])
def test_segments(monkeypatch, step):
    monkeypatch.setattr(tf, "STEP", step)
    ids, data = segment()
    data = b"xx" + data + b"\n"
    s = tf.Segment(memoryview(data), 2)
    assert (s.shard, s.number, s.names, s.counts.tolist(), s.end) == (7, 3, ["1", None, "ü", "4"], [500, 1, 0, 549], len(data))
    found = [(place, np.concatenate(parts).tolist()) for place, parts in s.documents()]
    assert found == [(0, ids[:500].tolist()), (1, ids[500:501].tolist()), (2, []), (3, ids[501:].tolist())]


def test_damage_is_noticed():
    _, data = segment()
    for at in [*range(0, 60, 7), 64, 70, len(data) - 1, len(data) - 200]:
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(tf.Segment(memoryview(bytes(bad))).documents())
    with pytest.raises(ValueError):
        tf.Segment(memoryview(data[:-1]))
    with pytest.raises(ValueError):
        tf.pack_segment(np.array([rc.MOST_IDS]), ["1"], [1], 0, 0)


def test_segments_of_the_coding_before_are_not_read():
    _, data = segment()
    header = bytearray(data[: tf.HEADER.size])
    header[4:8] = (1).to_bytes(4, "little")
    old = bytes(header) + zlib.crc32(header).to_bytes(4, "little") + data[tf.HEADER.size + 4 :]
    with pytest.raises(ValueError, match="version 1 "):
        tf.Segment(memoryview(old))


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("segment", [1, 50, 1 << 20])
def test_files_against_the_library(spark, docs, tmp_path, segment):
    rows = [r for r in odd_rows() if r[0] != 6] + [(100 + i, f"text {i} of many, <|endoftext|> [SEP] {'x' * i}", "en", "s") for i in range(40)]
    path = str(tmp_path / "tokens")
    tf.write_tokens(docs(rows), tokenizer_path(), path, block=64, segment=segment, segments_per_file=2)
    found = tf.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    rows.sort(key=lambda r: -1 if r[0] is None else r[0])
    assert [tuple(r) for r in found] == expected([(r[0], r[1]) for r in rows])


def test_ids_that_repeat_are_documents_each(spark, docs, tmp_path):
    path = str(tmp_path / "tokens")
    tf.write_tokens(docs([(5, f"copy {i % 3}", "en", "s") for i in range(300)] + [(4, "before", "en", "s")]), tokenizer_path(), path, segment=100)
    found = tf.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [4] + [5] * 300
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:], strict=False))


def test_no_documents(spark, docs, tmp_path):
    tf.write_tokens(docs([]), tokenizer_path(), str(tmp_path / "tokens"))
    assert tf.read_tokens(spark, str(tmp_path / "tokens")).collect() == []


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    found = op11_token_files(spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [x[:4] for x in expected([tuple(r) for r in rows])]
    assert op11_token_files(spark, sf).agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == sum(r["n_tokens"] for r in found)


END = b"\2\0\0\0"


def odd_texts():
    latin = [chr(c) for c in range(256)]
    said = ["", " ", "\n", "a", " lead and trail \t", "It's we'RE 'S o'clock '", "a<|endoftext|>b <| |> <b|c>", "x" * 3000 + ".", "a1b22c333", "No.1,(2)!!?", "\u0130\u0131 \u00df\u1e9e \u03a3\u03c3\u03c2", "e\u0301 \u00e9 \u212b", "\u4f60\u597d\uff0c world \U0001f600!", "caf\u00e9 \u00c9COLE \u00d7\u00f7 \u00bd\u00b2 \u00aa\u00ba\u00b5 a\u00adb a\u00a0b"]
    return said + [f"a{c}B{c}{c}1{c} {c}, {c}" for c in latin] + ["".join(latin[i : i + 16]) for i in range(0, 256, 5)]


def test_texts_together_against_the_library():
    from tokenizers import Tokenizer

    t, bpe, texts = Tokenizer.from_file(tokenizer_path()), WordBpe(tokenizer_path()), odd_texts()
    want = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    data = pa.array([x.encode() for x in texts], pa.binary())
    for _ in range(2):  # nothing is remembered, all is
        for part in (slice(0, len(texts)), slice(7, 90), *(slice(i, i + 1) for i in range(len(texts)))):
            ids, counts = bpe.packed_all(data[part], END)
            assert counts.tolist() == [len(w) for w in want[part]]
            assert ids.tolist() == [i for w in want[part] for i in w]


def test_bytes_that_are_no_text_are_tokenised_as_by_word():
    bpe = WordBpe(tokenizer_path())
    texts = [b"ok \xc3 \xc3a \xa9b", b"\xff\xc2", b"a\xc3\xc3\xa9 end"]
    ids, counts = bpe.packed_all(pa.array(texts, pa.binary()), END)
    assert ids.tobytes() == b"".join(bpe.packed(x) + END for x in texts)


def test_plain_words_are_cut_together_and_pieces_looked_up_once(monkeypatch):
    """Words that are not remembered were looked up one by one, each with calls of its own."""
    bpe, asked, alone = WordBpe(tokenizer_path()), [], []
    monkeypatch.setattr(WordBpe, "_loaded", {"here": bpe})
    pieces, word = bpe._pieces, bpe.word
    monkeypatch.setattr(bpe, "_pieces", lambda x: asked.append(len(x)) or pieces(x))
    monkeypatch.setattr(bpe, "word", lambda x: alone.append(x) or word(x))
    texts = [" ".join(f"{a}{b}y{end}" for a in "bcdfg" for b in "aeiou") for end in (".", ",", "", ".")]
    tokens = tf.tokenized("here", 2)
    for _ in range(2):
        ids, counts = tokens(pa.array([x.encode() for x in texts], pa.binary()))
        assert (len(counts), counts.sum()) == (4, len(ids))
    assert (asked, alone) == ([27], [])  # 25 words, a stop and a comma


def test_memory_is_bounded_and_right():
    memory, made = Memory(20_000), []
    for i in range(300):
        keys = [b"always", *(b"%d" % (i * 10 + j) for j in range(10))]
        assert memory.values(keys, lambda x: made.extend(x) or [k[::-1] for k in x]) == [k[::-1] for k in keys]
        assert len(memory.new) + len(memory.old) < 200
    assert made.count(b"always") == 1
    long = b"x" * 5000
    assert memory.values([long], lambda x: x) == [long] and long not in memory.new


@pytest.mark.parametrize("limit", [1, 2, 3, 1000, 49_408, rc.MOST_IDS])
def test_new_ids_of_any_vocabulary(limit):
    bounds = rc.new_ids(limit)
    parts = np.diff(bounds)
    assert (len(parts), bounds[-1]) == (limit, 1 << rc.new_bits(limit)) and parts.min() > 0
    assert parts.max() < 1 << 63 - rc.ID_BITS - rc.SLOT_BITS and bounds[-1] <= 1 << rc.SLOT_BITS
    ids = np.unique(np.linspace(0, limit - 1, 3000).astype(np.int64))
    assert (rc.decode(rc.encode(ids, 100, limit), len(ids), 100, limit) == ids).all()


def test_blocks_that_are_too_long():
    with pytest.raises(ValueError):
        rc.encode(np.zeros(10, np.int64), rc.LONGEST + 1, 5)


def test_odd_words_are_remembered_in_bounded_memory(monkeypatch):
    from lodestone.llm import tokens

    bpe, alone = WordBpe(tokenizer_path()), []
    word = bpe.word
    monkeypatch.setattr(bpe, "word", lambda x: alone.append(x) or word(x))
    for _ in range(2):
        bpe.packed_all(pa.array(["it's \u0434\u0430".encode()], pa.binary()), END)
    assert len(alone) == 2
    monkeypatch.setattr(tokens, "REMEMBERED", 2000)
    for i in range(100):
        bpe.packed_all(pa.array([f"w{i}x{'y' * (i % 50)}'s".encode()], pa.binary()), END)
        assert len(bpe.pieces) < 40
