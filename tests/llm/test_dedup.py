import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest_rows import odd_rows

from lodestone.llm import exact_dedup, line_dedup, simhash
from lodestone.llm.cuckoo import CuckooFilter, Full

WHITE = " \t\n\x0b\x0c\r"


def plain(t):
    return "".join(c for c in t or "" if c not in WHITE)


def many(n, seed=1):
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("abcd \n", k=rnd.randint(0, 5))) for _ in range(60)]
    return [(i, "hot text" if i % 3 == 0 else rnd.choice(base), "en", "s") for i in range(n)]


@pytest.mark.parametrize("rows", [odd_rows(), many(400), []])
@pytest.mark.parametrize("heavy", [2, 8])
def test_exact_dedup(docs, rows, heavy, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY_ROWS", heavy)
    got = exact_dedup.exact_dedup(docs(rows)).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[plain(t)].append((-len(t or ""), i is not None, i))
    assert len(got) == len(rows)
    want = {hashlib.sha256(k.encode()).hexdigest(): (sorted(v)[0][2], len(v)) for k, v in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) <= {1}


def test_keep_unique_keeps_rows(docs):
    out = exact_dedup.keep_unique(docs(odd_rows()))
    assert out.columns == ["doc_id", "text", "lang", "source", "_id", "_n", "kept", "keep_id"]
    rows = out.collect()
    assert len(rows) == len({plain(t) for _, t, *_ in odd_rows()})
    assert {plain(r.text) for r in rows} == {plain(t) for _, t, *_ in odd_rows()}
    assert exact_dedup.keep_unique(docs([])).count() == 0


def fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < 4 else [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints, distance):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def near_rows(n=150, seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    base = [word() for _ in range(300)]
    out = []
    for i in range(n):
        words = list(base) if i % 2 else [word() for _ in range(80)]
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = word()
        out.append((i, " ".join(words), "en", "s"))
    return out


@pytest.mark.parametrize("rows", [odd_rows(), near_rows(), []])
@pytest.mark.parametrize("cell", [4, 4096])
def test_near_dedup(docs, rows, cell, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", cell)
    got = simhash.near_dedup(docs(rows)).collect()
    prints = [fingerprint(t) for _, t, *_ in rows]
    want = sorted(zip([str(i) for i, *_ in rows], [f"{p:016x}" for p in prints], map(str, components([i for i, *_ in rows], prints, 4)), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def close_pairs(n=4000, seed=5):
    rnd = np.random.default_rng(seed)
    a = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rnd.integers(0, 64, n, dtype=np.uint64)
    return a, b


def test_embedding_is_a_lower_bound():
    a, b = close_pairs()
    assert (np.bitwise_count(simhash.embedding_of(a) ^ simhash.embedding_of(b)) <= np.bitwise_count(a ^ b)).all()


def test_close_pairs_meet_at_a_home():
    a, b = close_pairs()
    ea, eb = simhash.embedding_of(a), simhash.embedding_of(b)

    def places(counts, band):
        out = defaultdict(dict)
        for rows, cells, roles in simhash._cells(counts, band, 4, 1):
            for r, c, v in zip(rows.tolist(), cells.tolist(), roles.tolist(), strict=True):
                out[r][c] = min(v, out[r].get(c, 1))
        return out

    for grid in (simhash.FIRST, *simhash.SECOND):
        both = [(places(ea, band), places(eb, band)) for band in grid]
        for i in range(len(a)):
            assert any(pa[i][c] == 0 or pb[i][c] == 0 for pa, pb in both for c in set(pa[i]) & set(pb[i]))


@pytest.mark.parametrize("reach", [1, 2])
def test_neighbours_are_all_cells_one_way(reach):
    segments = [0, 3, 5]
    every = [sum(((1 << n) - 1) << (2 * s) for n, s in zip(c, segments, strict=True)) for c in np.ndindex(3, 3, 3)]
    size = lambda c: [bin(c >> (2 * s) & 3).count("1") for s in segments]
    found = set()
    for rows, cells in simhash.neighbours(np.array(every, np.uint64), segments, reach):
        found |= {(every[r], c) for r, c in zip(rows.tolist(), cells.tolist(), strict=True)}
    near = {(x, y) for x in every for y in every if x != y and sum(abs(p - q) for p, q in zip(size(x), size(y), strict=True)) <= reach}
    assert found <= near and {frozenset(p) for p in found} == {frozenset(p) for p in near} and len(found) == len(near) / 2


def crowd(n=600, seed=9):
    """Some dense balls, and many far fingerprints that share one band's counts."""
    rnd = np.random.default_rng(seed)
    ball = rnd.integers(0, 1 << 63, 3, dtype=np.uint64)[rnd.integers(0, 3, n)]
    for _ in range(5):
        ball ^= np.uint64(1) << rnd.integers(0, 64, n, dtype=np.uint64)
    far = rnd.integers(0, 1 << 63, n, dtype=np.uint64) & ~simhash.mask_of(simhash.FIRST[0])
    return np.unique(np.concatenate([ball, far, far[:200] ^ np.uint64(1 << 63)])).view(np.int64)


@pytest.mark.parametrize("cell", [16, 100, 4096])
def test_links_connect_what_all_pairs_connect(spark, cell, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", cell)
    fp = crowd()
    found = simhash.links(spark.createDataFrame([(int(x),) for x in fp], "fp long").repartition(3)).collect()
    bits = fp.view(np.uint64)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 64 for r in found)

    def roots(pairs):
        label = np.arange(len(fp))
        a, b = (np.array(x) for x in zip(*pairs, strict=True))
        while True:
            least = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            label = label[label]
            if (label == before).all():
                return label.tolist()

    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    place = {int(x): i for i, x in enumerate(fp)}
    assert roots([(place[r.a], place[r.b]) for r in found]) == roots(np.argwhere(near).tolist())


def test_keep_representatives(docs):
    rows = near_rows(60)
    out = simhash.keep_representatives(docs(rows)).collect()
    prints = [fingerprint(t) for _, t, *_ in rows]
    assert sorted(r.doc_id for r in out) == sorted(set(components([r[0] for r in rows], prints, 4)))
    odd = simhash.keep_representatives(docs(odd_rows()))
    texts = [fingerprint(r.text) for r in odd.collect()]
    assert len(texts) == len(set(texts)) and odd.columns[-1] == "keep_id"
    rows = [(None, "one two three", "en", "s")] * 40 + [(None, "four five six", "en", "s"), (7, "seven", "en", "s"), (7, "eight", "en", "s"), (7, "seven", "en", "s")]
    assert sorted(r.text for r in simhash.keep_representatives(docs(rows)).collect()) == ["eight", "four five six", "one two three", "seven"]


def line_rows():
    common, rare = "A line that very many documents hold, word for word.", "x" * 39
    out = list(odd_rows())
    for i in range(20, 40):
        out.append((i, f"own {i}\n{common if i % 2 else '  ' + common.upper()}\n{rare}\nlast", "en", "s"))
    return out + [(50, common + "\n" + common, "en", "s")]


def lines_by_hand(rows, least=40, n=5):
    keys = [[line.strip(WHITE).encode().lower().decode() for line in (t or "").split("\n")] for _, t, *_ in rows]
    held = defaultdict(list)
    for (i, *_), ks in zip(rows, keys, strict=True):
        for k in set(ks):
            held[k].append(i)
    out = []
    for (i, t, *_), ks in zip(rows, keys, strict=True):
        kept = []
        for line, k in zip((t or "").split("\n"), ks, strict=True):
            named = [x for x in held[k] if x is not None]
            if not (len(k) >= least and len(held[k]) >= n and named and max(named) != i):
                kept.append(line)
        out.append((str(i), len(ks), len(ks) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_line_dedup(docs, limit):
    for rows in (line_rows(), []):
        got = line_dedup.line_dedup(docs(rows), broadcast_keys=limit).collect()
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got) == lines_by_hand(rows)


@pytest.mark.parametrize("sent", [2, 100])
def test_filters_take_part_beyond_the_broadcast_bound(docs, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    monkeypatch.setattr(line_dedup, "FILTERS_SENT", sent)
    rows = [(i, "\n".join([*(f"a line that {k} of the documents have in common" for k in range(6)), *(f"line {k} of document {i} that no other document has" for k in range(40))]), "en", "s") for i in range(8)]
    asked = []
    plain_pass = line_dedup.pass_filters
    monkeypatch.setattr(line_dedup, "pass_filters", lambda keys, repeated, shards: asked.append((keys, plain_pass(keys, repeated, shards), shards)) or asked[-1][1])
    got = line_dedup.line_dedup(docs(rows), broadcast_keys=5).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got) == lines_by_hand(rows)
    ((keys, passed, shards),) = asked
    assert shards == 6 and keys.count() == 8 * 46 and 8 * 6 <= passed.count() < 8 * 46 / 4


def test_line_index_is_reversible(docs, spark, tmp_path):
    rows = [r for r in line_rows() if r[0] is not None]
    a, b = docs(rows[:18]), docs(rows[18:])
    index = line_dedup.LineIndex(spark, str(tmp_path / "i"), shards=3)
    index.insert(a)
    index.refresh()
    before = {tuple(r) for r in index.counts().collect()}
    index.insert(b)
    index.refresh()
    assert {tuple(r) for r in index.counts().collect()} != before
    held = {tuple(r) for r in index.counts().where("n_docs >= 5").select("hi", "lo").collect()}
    assert held <= {(r.hi, r.lo) for r in index.maybe_repeated(b).collect()} | {(r.hi, r.lo) for r in index.maybe_repeated(a).collect()}
    index.delete(b.select("doc_id").subtract(a.select("doc_id")))
    index.refresh()
    assert {tuple(r) for r in index.counts().collect()} == before


def test_line_index_outgrows_its_filters(docs, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    rows = [(i, "\n".join(f"a line {k} that all the documents of this test have" for k in range(100)), "en", "s") for i in range(5)]
    index = line_dedup.LineIndex(spark, str(tmp_path / "i"), shards=2)
    index.insert(docs(rows))
    index.refresh()
    assert index.maybe_repeated(docs(rows)).count() == 500
    index.delete(docs(rows[:1]).select("doc_id"))
    index.refresh()
    assert index.maybe_repeated(docs(rows)).count() == 0
    index.insert(docs(rows[:1]))
    index.refresh()
    assert index.maybe_repeated(docs(rows)).count() == 500


def test_cuckoo_filter():
    rnd = np.random.default_rng(2)
    hi, lo = rnd.integers(-(2**63), 2**63, (2, 5000))
    f = CuckooFilter.of(hi, lo)
    assert f.contains(hi, lo).all()
    other = rnd.integers(-(2**63), 2**63, (2, 20000))
    assert f.contains(*other).mean() < 0.002
    f.delete(hi[:2500], lo[:2500])
    assert f.contains(hi[2500:], lo[2500:]).all() and f.contains(hi[:2500], lo[:2500]).mean() < 0.01
    again = CuckooFilter.from_bytes(f.to_bytes())
    assert (again.table == f.table).all()
    with pytest.raises(Full):
        CuckooFilter(4).insert(hi[:50], lo[:50])


def test_repeated_ids_are_one_document(docs):
    line = "a line of this test that is long enough to be a key"
    rows = [(7, line, "en", "s")] * 5 + [(None, line, "en", "s")] * 5 + [(i, line, "en", "s") for i in range(3)]
    assert {(r.n_dropped, r.text) for r in line_dedup.line_dedup(docs(rows)).collect()} == {(0, line)}
    rows.append((3, line, "en", "s"))
    got = sorted((str(r.doc_id), r.n_dropped) for r in line_dedup.line_dedup(docs(rows)).collect())
    assert got == sorted([("7", 0)] * 5 + [("None", 0)] * 5 + [(str(i), 1) for i in range(4)])


def test_deletion_restores_the_texts(docs, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHANGES", 2)
    rows = [r for r in line_rows() if r[0] is not None]
    a, b = docs(rows[:16]), docs(rows[16:])
    index = line_dedup.LineIndex(spark, str(tmp_path / "i"))
    index.insert(a)
    before = sorted(map(str, index.dedup(a, broadcast_keys=0).collect()))
    for _ in range(2):
        index.insert(b)
        both = sorted(map(str, [*index.dedup(a).collect(), *index.dedup(b).collect()]))
        assert both == sorted(map(str, line_dedup.line_dedup(docs(rows)).collect()))
        index.delete(b.select("doc_id").subtract(a.select("doc_id")))
        assert sorted(map(str, index.dedup(a).collect())) == before
    strings = a.withColumn("doc_id", a["doc_id"].cast("string"))
    index = line_dedup.LineIndex(spark, str(tmp_path / "s"))
    assert index.dedup(strings.limit(0)).count() == 0
    index.insert(strings)
    assert index.dedup(strings).count() == 16
