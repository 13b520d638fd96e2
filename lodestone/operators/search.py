"""Exhaustive hybrid search for a batch of questions: blocks of chunks, all questions at once, k rows a task.

Min-max fusion, boosts and reciprocal ranks depend on every chunk, so every chunk is scored; but no
pair of a question and a chunk leaves the task that scored it, unless it is among the task's best. What
is global (bounds of scores, ranks of some chunks) comes from reductions of a few numbers a question
and task. The questions are a stated set: they go to all tasks, some thousand at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from copy import copy
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.retrieval import B, DENSE_WEIGHT, FLOOR_SHARE, K1, RRF_K
from lodestone.plans.scratch import materialize
from lodestone.plans.sizes import pieces, spread

#: Questions that go to all tasks at once, and turns of them that share a table of chunks.
QUESTIONS, SHARED = 4096, 8
#: Tasks of a scan by core: each has its best rows of every question, so their number must not grow with the table.
TASKS = 2
#: Chunks and questions that are scored at once: some arrays of half a megabyte.
BLOCK, RUN = 2048, 32
#: A term that a block's chunks have more often than this share is multiplied out, others are added where they are.
COMMON = 1 / 32
_WORD = re.compile("[a-z0-9]+")
_MEMORY = 200_000


class Words:
    """Tokens as in :func:`lodestone.functions.text.tokenize`, with a memory of singulars."""

    def __init__(self):
        self.known: dict[str, str] = {}

    def _singular(self, w: str) -> str:
        if len(w) > 3 and w[-1] == "s" and w[-2] not in "sui":
            return w[:-1]
        return w

    def counts(self, text: str | None) -> tuple[int, Counter]:
        """How many tokens, and how often each."""
        if len(self.known) > _MEMORY:
            self.known.clear()
        words = _WORD.findall((text or "").lower())
        out: Counter = Counter()
        for w, n in Counter(words).items():
            s = self.known.get(w)
            if s is None:
                s = self.known[w] = self._singular(w)
            out[s] += n
        return len(words), out


#: Which bytes are those of words.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def _counted(texts: pa.Array) -> list[pa.Array]:
    """(dl, terms, tfs) of texts: words are cut out of all bytes at once, and only different ones are put in the singular."""
    lower = [x.lower().encode() if x else b"" for x in texts.to_pylist()]
    data = np.frombuffer(b"\n".join([*lower, b""]), np.uint8)
    inside = _LETTER[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]  # the last byte is none of a word
    n = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in lower]))
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))).dictionary_encode()
    known = words.dictionary
    plural = pc.and_(pc.greater(pc.binary_length(known), 3), pc.match_substring_regex(known, "[^sui]s$"))
    known = pc.if_else(plural, pc.utf8_slice_codeunits(known, 0, -1), known).dictionary_encode()
    code = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.indices.to_numpy(zero_copy_only=False)]
    many = max(1, len(known.dictionary))
    dl = np.diff(n, prepend=0)
    found, tfs = np.unique(np.repeat(np.arange(len(lower)), dl) * many + code, return_counts=True)
    cuts = pa.array(np.searchsorted(found, np.arange(len(lower) + 1) * many), pa.int32())
    return [pa.array(dl, pa.int64()), pa.ListArray.from_arrays(cuts, known.dictionary.take(pa.array(found % many))), pa.ListArray.from_arrays(cuts, pa.array(tfs, pa.int32()))]


def term_counts(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, dl, terms, tfs): a text's length in tokens, its different terms, and how often each occurs. Rows stay where they are."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), *_counted(part.column(1))], ["id", "dl", "terms", "tfs"])

    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, dl long, terms array<string>, tfs array<int>")


class Asked:
    """The questions of a turn, as arrays; ``known`` has the place of each asked term."""

    def __init__(self, rows: list, known: dict[str, int] | None):
        words = Words()
        self.ids = np.array([r["question_id"] for r in rows], np.int64)
        self.intent = np.array([bool(r["intent"]) for r in rows], bool)
        self.boosted = [set(r["boost_families"] or ()) for r in rows]
        self.routes = [set(r["routes"] or ()) for r in rows]
        #: Families that some question names; a chunk's is its place here and 2, 1 for any other one, 0 for none.
        self.named = sorted(set().union(*self.boosted, *self.routes))
        self._tables: dict[frozenset, np.ndarray] = {}
        self.width = max((len(r["vector"]) for r in rows if r["vector"] is not None), default=0)
        self.vectors = np.zeros((len(rows), self.width))
        self.without = np.array([r["vector"] is None for r in rows], bool)
        counts = [words.counts(r["query"])[1] if known is not None else {} for r in rows]
        for i, r in enumerate(rows):
            if r["vector"] is not None:
                self.vectors[i, : len(r["vector"])] = r["vector"]
        #: By question from ``starts``: its terms' places, and how often it has each.
        self.starts = np.cumsum([0, *(len(c) for c in counts)])
        self.at = np.array([known[t] for c in counts for t in sorted(c)], np.int64)
        self.times = np.array([c[t] for c in counts for t in sorted(c)], np.float64)
        self.terms = len(known or ())
        self.positive = True

    def only(self, keep: np.ndarray) -> Asked:
        """The questions at these places alone."""
        out = copy(self)
        out.ids, out.intent, out.vectors, out.without = self.ids[keep], self.intent[keep], self.vectors[keep], self.without[keep]
        out.boosted, out.routes = [self.boosted[i] for i in keep], [self.routes[i] for i in keep]
        out._tables = {}
        n = np.diff(self.starts)[keep]
        out.starts = np.append(0, np.cumsum(n))
        which = np.repeat(self.starts[keep] - out.starts[:-1], n) + np.arange(out.starts[-1])
        out.at, out.times = self.at[which], self.times[which]
        return out

    def boost_table(self) -> np.ndarray:
        """questions x families: is the family one that the question is boosted by?"""
        return np.array([[False, False, *(f in b for f in self.named)] for b in self.boosted], bool).reshape(len(self.ids), len(self.named) + 2)

    def route_table(self, present: set) -> np.ndarray:
        """questions x families: may the family be found? All, or for routed questions a routed family that there is, or none."""
        out = np.ones((len(self.ids), len(self.named) + 2), bool)
        for i, routes in enumerate(self.routes):
            if routes & present:
                out[i] = [True, False, *(f in routes and f in present for f in self.named)]
        return out

    def table(self, name: str, present: set = frozenset()) -> np.ndarray:
        """One of both, made once."""
        key = frozenset({name, *present})
        if key not in self._tables:
            self._tables[key] = self.boost_table() if name == "family" else self.route_table(present)
        return self._tables[key]


class Block:
    """Chunks in the order of families, kinds and ids; chunks of one family and kind are a segment."""

    def __init__(self, batch: pa.RecordBatch, asked: Asked):
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        ids = columns["id"].to_numpy(zero_copy_only=False).astype(np.int64)
        place = pc.index_in(columns["family"], value_set=pa.array(asked.named, pa.string()), skip_nulls=True)
        place = pc.add(pc.fill_null(place, -1), 2)
        family = pc.if_else(pc.is_null(columns["family"]), 0, place).to_numpy(zero_copy_only=False).astype(np.int64)
        workflow = columns["is_workflow"].to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((ids, workflow, family))
        self.m = m = len(ids)
        self.ids, self.workflow, family = ids[order], workflow[order], family[order]
        self.segments = np.flatnonzero(np.diff(family * 2 + self.workflow, prepend=-1))
        self.sizes = np.diff(np.append(self.segments, m))
        self.segment = np.repeat(np.arange(len(self.segments)), self.sizes)
        self.families, self.kinds = family[self.segments], self.workflow[self.segments]
        self.by_id = np.argsort(self.ids, kind="stable")
        self.id_place = self.ids[self.by_id].searchsorted(self.ids)
        to = np.empty(m, np.int64)
        to[order] = np.arange(m)
        self._postings(asked, np.repeat(to, np.diff(np.asarray(columns["at"].offsets))), np.asarray(columns["at"].flatten()), np.asarray(columns["gain"].flatten()))
        vector = columns["vector"]
        self.has = to[np.flatnonzero(vector.is_valid().to_numpy(zero_copy_only=False))]
        self.vectors = np.zeros((len(self.has), asked.width))
        if len(self.has):
            sizes = vector.drop_null().value_lengths().to_numpy(zero_copy_only=False)
            flat = vector.drop_null().flatten().to_numpy(zero_copy_only=False)
            if (sizes == asked.width).all():
                self.vectors[:] = flat.reshape(len(sizes), asked.width)
            else:
                for i, (a, n) in enumerate(zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True)):
                    self.vectors[i, : min(n, asked.width)] = flat[a : a + min(n, asked.width)]

    def _postings(self, asked: Asked, rows: np.ndarray, terms: np.ndarray, gains: np.ndarray) -> None:
        order = np.argsort(terms, kind="stable")
        terms, self.rows, self.gains = terms[order], rows[order], gains[order]
        found, first, n = np.unique(terms, return_index=True, return_counts=True)
        often = n > COMMON * self.m
        #: By asked term: its place among the block's common ones, or where its postings begin and how many there are.
        self.common, self.first, self.n = np.full(asked.terms, -1), np.zeros(asked.terms, np.int64), np.zeros(asked.terms, np.int64)
        self.common[found[often]] = np.arange(often.sum())
        self.first[found[~often]], self.n[found[~often]] = first[~often], n[~often]
        in_common = self.common[terms]
        here = in_common >= 0
        self.worth = np.zeros((int(often.sum()), self.m))
        self._held = in_common[here], self.rows[here]
        self.worth[self._held] = self.gains[here]

    def present(self) -> np.ndarray:
        """common terms x chunks: 1 where the chunk has the term."""
        out = np.zeros(self.worth.shape)
        out[self._held] = 1
        return out


class Scored:
    """A run of questions over a block, questions x chunks; sums are rounded by ``six`` only where they are asked for."""

    def __init__(self, block: Block, asked: Asked, a: int, b: int):
        self.block, self.asked, self.a, self.b = block, asked, a, b
        self._made: dict[str, np.ndarray] = {}

    def raw(self, name: str) -> np.ndarray:
        if name not in self._made:
            self._made[name] = self._dense() if name == "dense" else self._lexical(self.block.worth, self.block.gains)
        return self._made[name]

    def six(self, name: str) -> np.ndarray:
        if name + "6" not in self._made:
            self._made[name + "6"] = self.raw(name) if self.empty(name) else _six(self.raw(name))
        return self._made[name + "6"]

    def empty(self, name: str) -> bool:
        """Has no question of the run a vector, so that all its dense scores are 0?"""
        return name == "dense" and bool(self.asked.without[self.a : self.b].all())

    def shares(self) -> np.ndarray:
        """Has the chunk a term of the question?"""
        if self.asked.positive:
            return self.raw("bm25") > 0
        return self._lexical(self.block.present(), np.ones(len(self.block.gains))) > 0

    def _lexical(self, worth: np.ndarray, gains: np.ndarray) -> np.ndarray:
        asked, block = self.asked, self.block
        lo, hi = asked.starts[self.a], asked.starts[self.b]
        at, times = asked.at[lo:hi], asked.times[lo:hi]
        q = np.repeat(np.arange(self.b - self.a), np.diff(asked.starts[self.a : self.b + 1]))
        common = block.common[at]
        here = common >= 0
        wanted, place = np.unique(common[here], return_inverse=True)
        share = np.zeros((self.b - self.a, len(wanted)))
        share[q[here], place] = times[here]
        out = share @ worth[wanted]
        n = block.n[at]
        if total := int(n.sum()):
            which = np.repeat(block.first[at] - (np.cumsum(n) - n), n) + np.arange(total)
            np.add.at(out.reshape(-1), np.repeat(q * block.m, n) + block.rows[which], np.repeat(times, n) * gains[which])
        return out

    def _dense(self) -> np.ndarray:
        if self.empty("dense"):
            return np.zeros((self.b - self.a, self.block.m))
        found = self.asked.vectors[self.a : self.b] @ self.block.vectors.T
        if np.array_equal(self.block.has, np.arange(self.block.m)):
            return found
        out = np.zeros((self.b - self.a, self.block.m))
        out[:, self.block.has] = found
        return out

    def allowed(self, recipe: Recipe) -> np.ndarray | None:
        """questions x segments: which may be found; None if all."""
        if not recipe.routed:
            return None
        may = self.asked.table("routes", recipe.present)[self.a : self.b][:, self.block.families]
        return None if may.all() else may

    def members(self, name: str) -> np.ndarray:
        """questions x segments: which are boosted."""
        if name == "family":
            return self.asked.table("family")[self.a : self.b][:, self.block.families]
        return self.asked.intent[self.a : self.b, None] & self.block.kinds[None, :]

    def spread(self, by_segment: np.ndarray) -> np.ndarray:
        return by_segment if by_segment.shape[1] == 1 else by_segment[:, self.block.segment]


def _millionths(x: np.ndarray) -> np.ndarray:
    """Whole millionths, halves away from zero."""
    y = x * 1e6
    z = np.abs(y)
    z += 0.5
    np.floor(z, out=z)
    return np.copysign(z, y, out=z)


def _six(x: np.ndarray) -> np.ndarray:
    """Six decimals, halves away from zero; never -0."""
    z = _millionths(x)
    z /= 1e6
    z += 0.0
    return z


def _span_scaled(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    span = np.where(high == low, 1.0, high - low)
    out = x - low[:, None]
    out /= span[:, None]
    return out


class Recipe:
    """A score: a channel or the weighted fusion of both, then boosts by a share of the range so far.

    ``bounds`` are (low, high) by channel and question, for fusions. A boost raises all chunks of a class (which boosts
    apply: bit j for boost j) by one number, so ranges after boosts follow from those of the classes before them.
    """

    def __init__(self, start: str, boosts: list[tuple[str, float]] | None = None, dense_weight: float = DENSE_WEIGHT, routed: bool = False, present: set | None = None):
        if start not in ("bm25", "dense", "weighted"):
            raise ValueError(f"unknown fusion: {start!r}")
        self.start, self.boosts, self.dense_weight = start, boosts or [], dense_weight
        self.routed, self.present = routed, present or set()
        self.bounds: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def value(self, s: Scored) -> np.ndarray:
        """The score before boosts."""
        if self.start != "weighted":
            return s.six(self.start)
        lexical, dense = (_span_scaled(s.six(n), *(x[s.a : s.b] for x in self.bounds[n])) for n in ("bm25", "dense"))
        lexical *= 1 - self.dense_weight
        dense *= self.dense_weight
        lexical += dense
        return _six(lexical)

    def classes(self, s: Scored) -> np.ndarray:
        """questions x segments."""
        out = np.zeros((s.b - s.a, len(s.block.segments)), np.int64)
        for j, (name, _) in enumerate(self.boosts):
            out += s.members(name).astype(np.int64) << j
        return out

    def gains(self, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        """By boost what it adds for each question; ``low`` and ``high`` are questions x classes, inf and -inf for none."""
        out = []
        for j, (_, share) in enumerate(self.boosts):
            least, most = low.min(1), high.max(1)
            span = np.where(most > least, most - least, 0.0)
            out.append(share * np.where(span == 0, 1.0, span))
            member = (np.arange(low.shape[1]) >> j & 1).astype(bool)
            low, high = (_six(x + np.where(member[None, :], out[-1][:, None], 0.0)) for x in (low, high))
        return out


class Search:
    """Questions (question_id, query, and perhaps vector, intent, boost_family or boost_families, routes) over chunks
    (id, text, and perhaps family, is_workflow) and vectors (id, vector).

    Statistics are over all chunks. A chunk or question without a vector has dense scores of 0; a chunk
    that shares no term with a question has a lexical score of 0, as have all if not ``lexical``, which
    spares reading the texts. Chunk and question ids are whole numbers.
    """

    def __init__(self, chunks: DataFrame, questions: DataFrame, vectors: DataFrame | None = None, *, floor: bool = True, text_col: str = "text", lexical: bool = True, tokens: DataFrame | None = None, df: DataFrame | None = None):
        """``tokens``: what :func:`term_counts` gives for the chunks, and ``df`` its (term, df), if they are there already."""
        self.spark = chunks.sparkSession
        have = lambda df, c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
        questions = questions.select("question_id", "query", have(questions, "vector", "array<double>"), have(questions, "intent", "boolean"), F.coalesce(have(questions, "boost_families", "array<string>"), F.array_compact(F.array(have(questions, "boost_family", "string")))).alias("boost_families"), have(questions, "routes", "array<string>"))
        self.questions = materialize(questions, "questions")
        n = self.questions.count()
        self.turns = max(1, -(-n // QUESTIONS))
        self.meta = chunks.select("id", have(chunks, "family", "string"), have(chunks, "is_workflow", "boolean"))
        self.vectors = vectors.select("id", "vector") if vectors is not None else None
        self.lexical, self.floor = lexical, floor
        if not lexical:
            return
        self.tokens = materialize(term_counts(chunks, "id", text_col), "terms") if tokens is None else tokens
        size = self.tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
        self.n, self.avgdl = size["n"], size["avgdl"] or 1.0
        self.df = materialize(self.tokens.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df") if df is None else df

    def idf(self) -> DataFrame:
        """(term, df, idf) of the whole vocabulary; negative values become FLOOR_SHARE times the mean."""
        raw = F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        out = self.df.withColumn("raw", raw)
        if not self.floor:
            return out.withColumnRenamed("raw", "idf")
        mean = out.agg(F.avg("raw")).first()[0]
        return out.select("term", "df", F.when(F.col("raw") < 0, FLOOR_SHARE * F.lit(mean)).otherwise(F.col("raw")).alias("idf"))

    def _in_turn(self, number: int) -> Column:
        return F.pmod(F.xxhash64("question_id"), F.lit(self.turns)) == number

    def _turns(self, numbers: range) -> list[tuple[Asked, DataFrame]]:
        """The questions of some turns, each with the chunks and what these questions ask of them."""
        rows = {i: self.questions.where(self._in_turn(i)).orderBy("question_id").collect() for i in numbers}
        words = Words()
        terms = sorted({t for turn in rows.values() for r in turn for t in words.counts(r["query"])[1]}) if self.lexical else []
        known = {t: i for i, t in enumerate(terms)}
        cut, positive = self._lexical(terms) if self.lexical else (spread(self.meta).select("*", F.array().cast("array<int>").alias("at"), F.array().cast("array<double>").alias("gain")), True)
        if self.vectors is None:
            cut = cut.withColumn("vector", F.lit(None).cast("array<float>"))
        else:
            cut = cut.join(self.vectors, "id", "left")
        cut = materialize(cut.select("id", "at", "gain", "vector", "family", F.coalesce("is_workflow", F.lit(False)).alias("is_workflow")), "asked")
        out = []
        for i, turn in rows.items():
            asked = Asked(turn, known if self.lexical else None)
            asked.number, asked.positive = i, positive
            out.append((asked, cut))
        return out

    def _lexical(self, terms_asked: list[str]) -> tuple[DataFrame, bool]:
        """The chunks with the asked terms that they have (places in ``terms_asked``) and what each is worth there; are all worth something?"""
        wanted = self.spark.createDataFrame(pd.DataFrame({"term": terms_asked}, dtype=object), "term string")
        held = dict(self.idf().join(F.broadcast(wanted), "term").select("term", "idf").toPandas().itertuples(index=False))  # terms of the stated set
        weight = np.array([*(held.get(t, 0.0) for t in terms_asked), 0.0])  # the last is that of all other terms
        avgdl = self.avgdl
        kind = self.tokens.schema["id"].dataType.simpleString()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(terms_asked, pa.string())
            for batch in (part for whole in batches for part in pieces(whole, 2)):
                ids, dl, terms, tfs = batch.columns
                offsets, counts = np.asarray(terms.offsets), np.asarray(tfs.flatten(), np.float64)
                at = pc.fill_null(pc.index_in(terms.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int32)
                length = np.repeat(dl.to_numpy(zero_copy_only=False), np.diff(offsets))
                keep = at >= 0
                gain = weight[at] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / avgdl))
                ends = np.concatenate([[0], np.cumsum(keep)])[offsets - offsets[0]].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[keep])) for x in (at, gain)]
                yield pa.RecordBatch.from_arrays([ids, *lists], ["id", "at", "gain"])

        return self.tokens.mapInArrow(run, f"id {kind}, at array<int>, gain array<double>").join(self.meta, "id"), all(x > 0 for x in held.values())

    def _each_turn(self, f: Callable[[Asked, DataFrame], DataFrame], only: np.ndarray | None = None) -> DataFrame:
        """What ``f`` makes of all questions, or of those whose ids are in ``only``; some of them are there."""
        if not hasattr(self, "_ready"):
            groups = [range(i, min(i + SHARED, self.turns)) for i in range(0, self.turns, SHARED)]
            self._ready = [turn for group in groups for turn in self._turns(group)]
        ready = self._ready
        if only is not None:
            ready = [(asked.only(np.flatnonzero(np.isin(asked.ids, only))), rows) for asked, rows in ready if np.isin(asked.ids, only).any()]
        return reduce(DataFrame.unionByName, [f(asked, rows) for asked, rows in ready])

    # --- reductions ---

    def _reduce(self, asked: Asked, rows: DataFrame, make: Callable[[], list], schema: str, few: bool = True) -> DataFrame:
        """A task's chunks go block by block, and a block's questions run by run, to ``add`` of what ``make`` makes; their ``rows`` are the task's.

        ``few``: what is made is by question, not by chunk, so there is some work for each core and no more tasks.
        """
        sent = self.spark.sparkContext.broadcast(asked)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            states, asked, any_rows = make(), sent.value, False
            n = len(asked.ids)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    any_rows = True
                    block = Block(batch.slice(at, BLOCK), asked)
                    for a in range(0, n, RUN):
                        scored = Scored(block, asked, a, min(a + RUN, n))
                        for state in states:
                            state.add(scored)
            for state in states if any_rows and n else ():
                yield from state.rows(asked)

        return (rows.coalesce(TASKS * self.spark.sparkContext.defaultParallelism) if few else rows).mapInArrow(run, schema)

    def _bounded(self, asked: Asked, rows: DataFrame, recipe: Recipe) -> Recipe:
        """``recipe`` with the bounds of both channels for these questions, if it fuses them; two numbers a question and channel are collected."""
        out = Recipe(recipe.start, recipe.boosts, recipe.dense_weight, recipe.routed, recipe.present)
        if out.start == "weighted":
            n = len(asked.ids)
            out.bounds = {c: (np.zeros(n), np.zeros(n)) for c in ("bm25", "dense")}
            part = self._reduce(asked, rows, lambda: [_Bounds(out, n)], "q int, name string, low double, high double")
            for r in part.groupBy("q", "name").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
                out.bounds[r["name"]][0][r["q"]], out.bounds[r["name"]][1][r["q"]] = r["low"], r["high"]
        return out

    def _raised(self, found: DataFrame, recipe: Recipe, n: int) -> DataFrame:
        """What :class:`_Best` has found, with boosts; ranges of classes are collected."""
        found = materialize(found, "classes")
        size = 1 << len(recipe.boosts)
        low, high = np.full((n, size), np.inf), np.full((n, size), -np.inf)
        for r in found.where("low is not null").groupBy("q", "class").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            low[r["q"], r["class"]], high[r["q"], r["class"]] = r["low"], r["high"]
        gains = recipe.gains(low, high)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, kind, fused = (batch.column(i).to_numpy(zero_copy_only=False) for i in (batch.schema.get_field_index(c) for c in ("q", "class", "fused")))
                for j, gain in enumerate(gains):
                    fused = _six(fused + np.where(kind >> j & 1, gain[q], 0.0))
                yield batch.set_column(batch.schema.get_field_index("fused"), "fused", pa.array(fused))

        return found.where("id is not null").mapInArrow(run, found.schema)

    def top(self, start: str, k: int, *, boosts: list[tuple[str, float]] | None = None, sides: bool = False, routed: bool = False, only_shared: bool = False) -> DataFrame:
        """(question_id, id, fused, bm25, dense, is_workflow, intent, rank): the k best by ``start`` (bm25, dense, weighted) and boosts.

        Order: fused, then bm25 if channels are fused, then the smaller id. ``sides``: the k best of diagrams and of prose
        each, with ranks among both. ``only_shared``: chunks without a common term are no candidates.
        """
        recipe = Recipe(start, boosts, routed=routed, present=self.present() if routed else None)

        def one(asked: Asked, rows: DataFrame) -> DataFrame:
            done = self._bounded(asked, rows, recipe)
            found = self._reduce(asked, rows, lambda: [_Best(done, k, sides, only_shared)], BEST)
            return (self._raised(found, done, len(asked.ids)) if done.boosts else found).drop("q", "class", "low", "high")

        found = self._each_turn(one)
        side = ["is_workflow"] if sides else []
        order = [F.desc("fused"), *([F.desc("bm25")] if start == "weighted" else []), F.col("id")]
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy("question_id", *side).orderBy(*order))).where(F.col("rank") <= k)
        if not sides:
            return best
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)))

    def _channels(self, m: int, sides: bool, routed: bool, only: np.ndarray | None = None) -> DataFrame:
        """(question_id, id, bm25, dense, is_workflow, intent): what is among the m best of a channel, found in one scan; of all questions or ``only`` some."""
        recipes = [Recipe(s, routed=routed, present=self.present() if routed else None) for s in ("bm25", "dense")]

        def one(asked: Asked, rows: DataFrame) -> DataFrame:
            return self._reduce(asked, rows, lambda: [_Best(r, m, sides, False, channel=i) for i, r in enumerate(recipes)], BEST)

        found = self._each_turn(one, only)
        of = ["question_id", "class", *(["is_workflow"] if sides else [])]
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("fused"), "id"))).where(F.col("rank") <= m)
        return best.groupBy("question_id", "id").agg(*[F.first(c).alias(c) for c in ("bm25", "dense", "is_workflow", "intent")])

    def present(self) -> set[str]:
        """The families that chunks have, a small dimension."""
        if not hasattr(self, "_present"):
            self._present = {r["family"] for r in self.meta.select("family").distinct().where("family is not null").collect()}
        return self._present

    def ranks(self, pairs: DataFrame, starts: list[str], routed: bool = False, only: np.ndarray | None = None) -> DataFrame:
        """``pairs`` (question_id, id, and perhaps their scores bm25 and dense) with ``<start>_rank`` for each of ``starts``:
        exact places among all chunks that may be found.

        A stated set of pairs, taken turn by turn: how many chunks are better is counted where they lie. ``only``: ids of the
        questions that ``pairs`` has, if these are not all.
        """
        present = self.present() if routed else None
        scored = {"bm25", "dense"} <= set(pairs.columns) and "weighted" not in starts

        def one(asked: Asked, rows: DataFrame) -> DataFrame:
            done = {s: self._bounded(asked, rows, Recipe(s, routed=routed, present=present)) for s in starts}
            mine = pairs.where(self._in_turn(asked.number)).select("question_id", "id", *(starts if scored else [])).distinct().toArrow()
            q, ids = (mine.column(c).to_numpy().astype(np.int64) for c in ("question_id", "id"))
            known = np.isin(q, asked.ids)
            q, ids = np.searchsorted(asked.ids, q[known]), ids[known]
            if scored:
                values = {s: mine.column(s).to_numpy()[known] for s in starts}
                lexical = np.zeros(len(q))
            else:
                own = self._reduce(asked, rows, lambda: [_Own(done, q, ids)], "pair int, start string, score double, bm25 double").toArrow()
                pair, start = own.column("pair").to_numpy(), np.array(own.column("start").to_pylist(), object)
                there = np.unique(pair)
                values, lexical = {s: np.zeros(len(q)) for s in starts}, np.zeros(len(q))
                for s in starts:
                    values[s][pair[start == s]] = own.column("score").to_numpy()[start == s]
                lexical[pair] = own.column("bm25").to_numpy()
                q, ids, lexical, values = q[there], ids[there], lexical[there], {s: x[there] for s, x in values.items()}
            wanted = _Wanted(q, ids, lexical, values, len(asked.ids))
            sent = self.spark.sparkContext.broadcast(wanted)
            counts = self._reduce(asked, rows, lambda: [_Better(done, sent.value)], "q int, " + ", ".join(f"{s} array<long>" for s in starts))
            add = lambda s: F.aggregate(F.collect_list(s), F.array_repeat(F.lit(0).cast("long"), F.size(F.first(s))), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias(s)
            counts = counts.groupBy("q").agg(*[add(s) for s in starts])
            names = asked.ids

            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for q, *n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        at = sent.value.of(q)
                        columns = [pa.array(np.full(at.stop - at.start, names[q])), pa.array(sent.value.ids[at])]
                        for s, x in zip(starts, n, strict=True):
                            placed = np.empty(len(x), np.int64)
                            placed[sent.value.order[s][at] - at.start] = x
                            columns.append(pa.array(placed.astype(np.int32) + 1, pa.int32()))
                        yield pa.RecordBatch.from_arrays(columns, ["question_id", "id", *(f"{s}_rank" for s in starts)])

            return counts.mapInArrow(run, "question_id long, id long, " + ", ".join(f"{s}_rank int" for s in starts))

        return self._each_turn(one, only)

    def rrf(self, k: int, c: int = RRF_K, *, sides: bool = False, routed: bool = False) -> DataFrame:
        """(question_id, id, fused, bm25, dense, is_workflow, intent, rank): the k best by the sum of reciprocal ranks of both channels.

        The first m = c + 2k of each channel are enough: what is in neither has less than
        2 / (2c + 2k + 1), and the first k of a channel have over 1 / (c + k) each. With ``sides`` the k best
        of diagrams and of prose are wanted, whose ranks among all may be anywhere: the first m of each
        population and channel are looked at, and twice as many, for the questions that need it, until its
        k-th best beats whatever comes after them in both channels. Ranks are among what may be found.
        """
        m, of = c + 2 * k, ["question_id", *(["is_workflow"] if sides else [])]
        place = lambda *order: F.row_number().over(Window.partitionBy(*of).orderBy(*order))
        best = [F.desc("fused"), F.desc("bm25"), F.col("id")]
        only, settled = None, []
        while True:
            found = materialize(self._channels(m, sides, routed, only), "channels")
            placed = found.join(self.ranks(found, ["bm25", "dense"], routed, only), ["question_id", "id"])
            placed = placed.withColumn("fused", F.round(1 / (c + F.col("bm25_rank")) + 1 / (c + F.col("dense_rank")), 6))
            placed = materialize(placed.withColumn("rank", place(*best)), "placed")
            if not sides:
                break
            last = placed.withColumn("_a", place("bm25_rank")).withColumn("_b", place("dense_rank")).groupBy(*of).agg(*[F.max(F.when(F.col(n) == at, F.col(v))).alias(o) for n, at, v, o in (("_a", m, "bm25_rank", "a"), ("_b", m, "dense_rank", "b"), ("rank", k, "fused", "kth"))])
            after = 1 / (c + F.col("a") + 1) + 1 / (c + F.col("b") + 1) + 1e-6  # scores are rounded
            open_ = last.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.coalesce("kth", F.lit(0.0)) <= after)).select("question_id").distinct().toArrow()  # of a stated set
            if not open_.num_rows:
                break
            only = open_.column(0).to_numpy()
            again = self.questions.sparkSession.createDataFrame(open_)
            settled.append(placed.join(F.broadcast(again), "question_id", "left_anti"))
            m *= 2
        placed = reduce(DataFrame.unionByName, [*settled, placed]).where(F.col("rank") <= k)
        if sides:
            placed = placed.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*best)))
        return placed.select("question_id", "id", "fused", "bm25", "dense", "is_workflow", "intent", "rank")

    def dense_sums(self) -> DataFrame:
        """(id, micro): a chunk's dense scores over all questions, in whole millionths."""
        parts = self._each_turn(lambda asked, rows: self._reduce(asked, rows, lambda: [_Sums()], "id long, micro long", few=False))
        return parts.groupBy("id").agg(F.sum("micro").alias("micro"))


#: Rows of :class:`_Best`: chunks that were found, and, where ``low`` is there, the range of a question and class.
BEST = "q int, class int, low double, high double, question_id long, id long, fused double, bm25 double, dense double, is_workflow boolean, intent boolean"


class _Bounds:
    """Ranges of both channels; rounding keeps the order, so the sums' bounds are rounded."""

    def __init__(self, recipe: Recipe, n: int):
        self.recipe = recipe
        self.found = {c: (np.full(n, np.inf), np.full(n, -np.inf)) for c in ("bm25", "dense")}

    def add(self, s: Scored) -> None:
        may = s.allowed(self.recipe)
        for name, (low, high) in self.found.items():
            for out, f, none in ((low, np.minimum, np.inf), (high, np.maximum, -np.inf)):
                x = f.reduce(s.raw(name), 1) if may is None else f.reduce(np.where(may, f.reduceat(s.raw(name), s.block.segments, 1), none), 1)
                f(out[s.a : s.b], x, out=out[s.a : s.b])

    def rows(self, asked: Asked) -> Iterator[pa.RecordBatch]:
        for name, (low, high) in self.found.items():
            there = np.flatnonzero(low <= high)
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([name] * len(there), pa.string()), pa.array(_six(low[there])), pa.array(_six(high[there]))], ["q", "name", "low", "high"])


class _Best:
    """Of each question and group (class, and side if ``sides``) the k best rows so far, and each class's range.

    With boosts, whose rounding may bring scores together that are one millionth apart, what is that near to the k-th
    best stays too. Rows wait until there are some thousand before they are put in order.
    """

    def __init__(self, recipe: Recipe, k: int, sides: bool, only_shared: bool, channel: int = 0):
        self.recipe, self.k, self.sides, self.only_shared, self.channel = recipe, k, sides, only_shared, channel
        self.classes = 1 << len(recipe.boosts)
        self.groups = self.classes * (2 if sides else 1)
        self.lexical = recipe.start == "weighted"
        self.margin = 1.5e-6 if recipe.boosts else 0.0
        self.runs: dict[int, dict] = {}

    def add(self, s: Scored) -> None:
        n, block = s.b - s.a, s.block
        held = self.runs.get(s.a)
        if held is None:
            held = self.runs[s.a] = {"n": n, "bars": np.full((n, self.groups), -np.inf), "ids": np.full((n, self.groups), np.iinfo(np.int64).max), "low": np.full((n, self.classes), np.inf), "high": np.full((n, self.classes), -np.inf), "rows": [], "count": 0, "room": 4096}
        x, may, kind = self.recipe.value(s), s.allowed(self.recipe), self.recipe.classes(s)
        if self.recipe.boosts:
            low, high = np.minimum.reduceat(x, block.segments, 1), np.maximum.reduceat(x, block.segments, 1)
            for c in range(self.classes):
                here = kind == c if may is None else (kind == c) & may
                np.minimum(held["low"][:, c], np.where(here, low, np.inf).min(1), out=held["low"][:, c])
                np.maximum(held["high"][:, c], np.where(here, high, -np.inf).max(1), out=held["high"][:, c])
        group = kind * 2 + block.kinds if self.sides else kind
        bars = np.take_along_axis(held["bars"], group, 1)
        if may is not None:
            bars = np.where(may, bars, np.inf)
        bars = s.spread(bars)
        if not self.lexical and not self.margin:  # of equal scores the smaller id comes first
            hit, equal = x > bars, x == bars
            if equal.any():
                equal &= block.ids < s.spread(np.take_along_axis(held["ids"], group, 1))
                hit |= equal
        else:
            hit = x >= bars
        if self.only_shared:
            hit &= s.shares()
        q, at = np.divmod(np.flatnonzero(hit), block.m)
        if not len(q):
            return
        group = group[q, block.segment[at]]
        held["rows"].append([q * self.groups + group, x[q, at], s.raw("bm25")[q, at], s.raw("dense")[q, at], block.ids[at], block.workflow[at]])
        held["count"] += len(q)
        if held["count"] > held["room"]:
            self._settle(held)

    def _settle(self, held: dict) -> list[np.ndarray]:
        key, x, bm25, dense, ids, workflow = both = [np.concatenate(c) for c in zip(*held["rows"], strict=True)]
        bm25 = _six(bm25)
        order = np.lexsort((ids, *([-bm25] if self.lexical else []), -x, key))
        key, x = key[order], x[order]
        place = np.arange(len(key))
        first = np.flatnonzero(np.diff(key, prepend=-1))
        counts = np.diff(np.append(first, len(key)))
        start = np.repeat(first, counts)
        keep = place - start < self.k
        full = counts >= self.k
        last = first[full] + self.k - 1
        held["bars"].reshape(-1)[key[last]] = x[last] - self.margin
        held["ids"].reshape(-1)[key[last]] = ids[order][last]
        if self.margin:
            same = np.flatnonzero(np.diff(key, prepend=-1).astype(bool) | np.diff(x, prepend=np.inf).astype(bool))
            among = place - np.repeat(same, np.diff(np.append(same, len(key))))
            keep |= (x >= held["bars"].reshape(-1)[key]) & (among < self.k)
        order = order[keep]
        held["rows"] = [[c[order] for c in both]]
        held["count"] = len(order)
        held["room"] = max(4096, 2 * len(order))
        return held["rows"][0]

    def rows(self, asked: Asked) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in BEST.split(", ")]
        for a, held in self.runs.items():
            if self.recipe.boosts:
                q, c = np.nonzero(held["low"] <= held["high"])
                nones = [pa.nulls(len(q), t) for t in (pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.bool_(), pa.bool_())]
                yield pa.RecordBatch.from_arrays([pa.array(q + a, pa.int32()), pa.array(c, pa.int32()), pa.array(held["low"][q, c]), pa.array(held["high"][q, c]), *nones], names)
            if held["rows"]:
                key, x, bm25, dense, ids, workflow = self._settle(held)
                q, kind = key // self.groups + a, key % self.groups // (2 if self.sides else 1) + self.channel
                none = pa.nulls(len(q), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(kind, pa.int32()), none, none, pa.array(asked.ids[q]), pa.array(ids), pa.array(x), pa.array(_six(bm25)), pa.array(_six(dense)), pa.array(workflow), pa.array(asked.intent[q])], names)


class _Own:
    """The scores of the stated pairs (places of questions, ids of chunks)."""

    def __init__(self, recipes: dict[str, Recipe], q: np.ndarray, ids: np.ndarray):
        self.recipes, self.out = recipes, []
        self.pairs = np.lexsort((ids, q))
        self.q, self.ids = q[self.pairs], ids[self.pairs]

    def add(self, s: Scored) -> None:
        lo, hi = np.searchsorted(self.q, [s.a, s.b])
        sorted_ids = s.block.ids[s.block.by_id]
        at = np.minimum(np.searchsorted(sorted_ids, self.ids[lo:hi]), s.block.m - 1)
        here = np.flatnonzero(sorted_ids[at] == self.ids[lo:hi])
        if not len(here):
            return
        q, col, pair = self.q[lo:hi][here] - s.a, s.block.by_id[at[here]], self.pairs[lo:hi][here]
        for name, recipe in self.recipes.items():
            self.out.append((pair, name, recipe.value(s)[q, col], s.six("bm25")[q, col]))

    def rows(self, asked: Asked) -> Iterator[pa.RecordBatch]:
        for pair, name, score, bm25 in self.out:
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array([name] * len(pair), pa.string()), pa.array(score), pa.array(bm25)], ["pair", "start", "score", "bm25"])


class _Wanted:
    """Stated pairs by question: ids, and by channel their scores from the least (``scores``), and whose these are (``order``)."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, lexical: np.ndarray, values: dict[str, np.ndarray], n: int):
        by = np.lexsort((ids, q))
        self.starts, self.ids, self.lexical = np.searchsorted(q[by], np.arange(n + 1)), ids[by], lexical[by]
        self.order = {s: np.lexsort((x[by], q[by])) for s, x in values.items()}
        self.scores = {s: x[by][self.order[s]] for s, x in values.items()}
        self.most = max([0.0, *(float(np.abs(x).max()) for x in self.scores.values() if len(x))]) * 1e6

    def of(self, q: int) -> slice:
        return slice(int(self.starts[q]), int(self.starts[q + 1]))


class _Better:
    """How many chunks of a task come before each of the stated pairs: a question's scores are sorted once a block.

    Of one channel a chunk's score and the place of its id are one whole number, and questions of a run follow each other,
    so that all pairs of a run are looked up at once, equal scores too.
    """

    def __init__(self, recipes: dict[str, Recipe], wanted: _Wanted):
        self.recipes, self.wanted = recipes, wanted
        self.n = {s: np.zeros(len(wanted.ids), np.int64) for s in recipes}

    def add(self, s: Scored) -> None:
        w = self.wanted
        if w.starts[s.a] == w.starts[s.b]:
            return
        for name, recipe in self.recipes.items():
            if name != "weighted" and self._count(s, name, s.allowed(recipe)):
                continue
            x, may = recipe.value(s), s.allowed(recipe)
            if may is not None:
                x = np.where(s.spread(may), x, -np.inf)
            ranked = np.sort(x, 1)
            for i in range(s.b - s.a):
                at = w.of(s.a + i)
                if at.start == at.stop:
                    continue
                scores, row = w.scores[name][at], ranked[i]
                left = row.searchsorted(scores)
                equal = row[np.minimum(left, s.block.m - 1)] == scores
                if not equal.any():
                    self.n[name][at] += s.block.m - left
                    continue
                self.n[name][at] += s.block.m - row.searchsorted(scores, "right")
                for tie in np.unique(scores[equal]).tolist():
                    self._ties(s, name, x[i], tie, slice(at.start + int(scores.searchsorted(tie)), at.start + int(scores.searchsorted(tie, "right"))))

    def _count(self, s: Scored, name: str, may: np.ndarray | None) -> bool:
        """All pairs of a run at once; False if scores are too large for that."""
        w, block, n = self.wanted, s.block, s.b - s.a
        at = slice(int(w.starts[s.a]), int(w.starts[s.b]))
        place = block.ids[block.by_id].searchsorted(w.ids[w.order[name][at]])
        if may is None and s.empty(name):  # smaller ids come first
            self.n[name][at] += np.select([w.scores[name][at] > 0, w.scores[name][at] < 0], [0, block.m], place)
            return True
        z = _millionths(s.raw(name))
        most = max(w.most, float(z.max()), -float(z.min())) + 1
        if not most < (1 << 62) / (2 * n * (block.m + 1)):
            return False
        span, places = 2 * int(most) + 2, block.m + 1
        np.subtract(most, z, out=z)
        if may is not None:
            z[~s.spread(may)] = span - 1
        keys = z.astype(np.int64)
        keys += np.arange(n)[:, None] * span
        keys *= places
        keys += block.id_place
        keys.sort(1)
        q = np.repeat(np.arange(n), np.diff(w.starts[s.a : s.b + 1]))
        own = (most - np.rint(w.scores[name][at] * 1e6)).astype(np.int64) + q * span
        own = own * places + place
        self.n[name][at] += keys.reshape(-1).searchsorted(own) - q * block.m
        return True

    def _ties(self, s: Scored, name: str, row: np.ndarray, tie: float, at: slice) -> None:
        """Of equal scores the smaller id comes first, after the better lexical score if channels are fused."""
        pairs, cols = self.wanted.order[name][at], s.block.by_id[row[s.block.by_id] == tie]
        ids = s.block.ids[cols]
        if name != "weighted":
            self.n[name][at] += ids.searchsorted(self.wanted.ids[pairs])
            return
        own = self.wanted.lexical[pairs][:, None]
        lexical = s.six("bm25")[np.flatnonzero((self.wanted.starts[s.a : s.b] <= pairs[0]) & (pairs[0] < self.wanted.starts[s.a + 1 : s.b + 1]))[0], cols][None, :]
        self.n[name][at] += ((lexical > own) | ((lexical == own) & (ids[None, :] < self.wanted.ids[pairs][:, None]))).sum(1)

    def rows(self, asked: Asked) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(self.wanted.starts)
        there = np.flatnonzero(sizes)
        ends = pa.array(np.append(0, np.cumsum(sizes[there])), pa.int32())
        table = pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *(pa.ListArray.from_arrays(ends, pa.array(n)) for n in self.n.values())], ["q", *self.n])
        for a in range(0, table.num_rows, 512):
            yield table.slice(a, 512)


class _Sums:
    def __init__(self):
        self.ids, self.sums = [], []

    def add(self, s: Scored) -> None:
        if s.a == 0:
            self.ids.append(s.block.ids)
            self.sums.append(np.zeros(s.block.m, np.int64))
        self.sums[-1] += np.rint(s.six("dense") * 1e6).astype(np.int64).sum(0)

    def rows(self, asked: Asked) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(self.ids)), pa.array(np.concatenate(self.sums))], ["id", "micro"])
