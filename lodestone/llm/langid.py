"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.text import parts
from lodestone.plans.scratch import materialize
from lodestone.plans.sizes import broadcast_if_small, spread

#: The training sample, of every language: so many documents a language at most and in all, each of so many characters
#: at most, and so many characters in all. Many languages share the sums; each has one document at least.
SAMPLE_DOCS = 400
SAMPLE_ALL = 25_600
SAMPLE_CHARS = 20_000
SAMPLE_ALL_CHARS = 40_000_000
HIDDEN = 12
STEPS = 300
BATCH = 384
#: Longest window; a longer token goes on in another one.
WINDOW = 48
#: Bytes of tokens that a worker remembers with their sums, and what a token costs besides its own bytes.
REMEMBERED = 40 << 20
TOKEN_BYTES = 200
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Characters of text whose tokens are made at once; what str.split() takes for white space.
PIECE = 1 << 20
_WHITE = re.compile("[" + "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) + "]")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that begin and end with whole tokens."""
    at = 0
    while at < len(text):
        white = _WHITE.search(text, at + size) if at + size < len(text) else None
        end = white.start() if white else len(text)
        yield text[at:end]
        at = end


def windows_of(token: str) -> list[bytes]:
    """The byte windows of a white-space token in lower case; none if it has no letter."""
    if not (token.isalpha() or _LETTER.search(token)):
        return []
    data = token.lower().encode()
    return [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class BiGru:
    """h' = (1 - z) * h + z * tanh(Wx + U(r * h)), in both directions; a softmax at every byte.

    Byte 256 marks both ends of a window: the white space around a token, however long.
    """

    NAMES = ("wf", "uf", "cf", "wb", "ub", "cb", "vf", "vb", "o")

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0] if shape[0] < 200 else 4)).astype(np.float32)
        self.classes, self.hidden = classes, hidden
        self.p = {"wf": draw(257, 3 * hidden), "wb": draw(257, 3 * hidden), "uf": draw(hidden, 2 * hidden), "ub": draw(hidden, 2 * hidden), "cf": draw(hidden, hidden), "cb": draw(hidden, hidden)}
        self.p |= {"vf": draw(hidden, len(classes)), "vb": draw(hidden, len(classes)), "o": np.zeros(len(classes), np.float32)}

    # One direction over a batch sorted by falling length; active[t] rows are still running at step t.

    def _run(self, codes: np.ndarray, active: list[int], d: str, keep: bool) -> tuple[list, list]:
        w, u, c, n = self.p["w" + d], self.p["u" + d], self.p["c" + d], self.hidden
        h = np.zeros((len(codes), n), np.float32)
        states, saved = [], []
        for t, rows in enumerate(active):
            x, before = w[codes[:rows, t]], h[:rows]
            gates = _sigmoid(x[:, : 2 * n] + before @ u)
            r, z = gates[:, :n], gates[:, n:]
            new = np.tanh(x[:, 2 * n :] + (r * before) @ c)
            h = before + z * (new - before)
            states.append(h)
            if keep:
                saved.append((before, r, z, new))
        return states, saved

    def _arrange(self, windows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
        length = np.array([len(w) + 2 for w in windows])
        order = np.argsort(-length, kind="stable")
        length = length[order]
        width = int(length[0])
        ahead = np.full((len(windows), width), 256, np.int64)
        for i, k in enumerate(order.tolist()):
            ahead[i, 1 : length[i] - 1] = np.frombuffer(windows[k], np.uint8)
        at = np.arange(width)
        back = np.take_along_axis(ahead, np.maximum(length[:, None] - 1 - at, 0), 1)
        active = [int(np.searchsorted(-length, -t, "left")) for t in range(width)]
        return order, length, ahead, back, active

    def _labels(self, forward: list, backward: list, length: np.ndarray, active: list[int]) -> list[np.ndarray]:
        """Probabilities of the classes at every byte: per step, of the rows that run there."""
        width, n = len(active), self.hidden
        back = np.zeros((width, len(length), n), np.float32)
        for t, h in enumerate(backward):
            back[t, : len(h)] = h
        out = []
        for t, h in enumerate(forward):
            rows = np.arange(len(h))
            logits = h @ self.p["vf"] + back[length[: len(h)] - 1 - t, rows] @ self.p["vb"] + self.p["o"]
            logits -= logits.max(1, keepdims=True)
            e = np.exp(logits)
            out.append(e / e.sum(1, keepdims=True))
        return out

    def sums(self, windows: list[bytes]) -> np.ndarray:
        """For each window the sum of the probabilities over its bytes, and at the end their number."""
        out = np.zeros((len(windows), len(self.classes) + 1), np.float32)
        for at in range(0, len(windows), 4096):
            part = windows[at : at + 4096]
            order, length, ahead, back, active = self._arrange(part)
            labels = self._labels(self._run(ahead, active, "f", False)[0], self._run(back, active, "b", False)[0], length, active)
            total = np.zeros((len(part), len(self.classes)), np.float32)
            for p in labels:
                total[: len(p)] += p
            out[at + order, :-1] = total
            out[at + order, -1] = length
        return out

    def _back(self, codes: np.ndarray, saved: list, dstates: list, d: str, grad: dict) -> None:
        u, c, n = self.p["u" + d], self.p["c" + d], self.hidden
        dw, du, dc = np.zeros_like(self.p["w" + d]), np.zeros_like(u), np.zeros_like(c)
        after = np.zeros((0, n), np.float32)
        for t in range(len(saved) - 1, -1, -1):
            before, r, z, new = saved[t]
            dh = dstates[t].copy()
            dh[: len(after)] += after
            dnew = dh * z * (1 - new * new)
            reset = dnew @ c.T
            dgates = np.concatenate([reset * before * r * (1 - r), dh * (new - before) * z * (1 - z)], 1)
            dc += (r * before).T @ dnew
            du += before.T @ dgates
            np.add.at(dw, codes[: len(before), t], np.concatenate([dgates, dnew], 1))
            after = dh * (1 - z) + reset * r + dgates @ u.T
        grad["w" + d], grad["u" + d], grad["c" + d] = dw, du, dc

    def step(self, windows: list[bytes], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all bytes, and its gradient by backpropagation through time."""
        order, length, ahead, back, active = self._arrange(windows)
        target = labels[order]
        f, saved_f = self._run(ahead, active, "f", True)
        b, saved_b = self._run(back, active, "b", True)
        labels_at = self._labels(f, b, length, active)
        total, loss = float(length.sum()), 0.0
        grad = {k: np.zeros_like(self.p[k]) for k in ("vf", "vb", "o")}
        df, db = [], [np.zeros_like(h) for h in b]
        for t, p in enumerate(labels_at):
            rows = np.arange(len(p))
            loss -= float(np.log(p[rows, target[: len(p)]] + 1e-9).sum())
            d = p.copy()
            d[rows, target[: len(p)]] -= 1
            d /= total
            grad["o"] += d.sum(0)
            grad["vf"] += f[t].T @ d
            df.append(d @ self.p["vf"].T)
            at = length[: len(p)] - 1 - t
            for s in np.unique(at).tolist():  # rows of a length are next to each other
                here = rows[at == s]
                grad["vb"] += b[s][here].T @ d[here]
                db[s][here] += d[here] @ self.p["vb"].T
        self._back(ahead, saved_f, df, "f", grad)
        self._back(back, saved_b, db, "b", grad)
        return loss / total, grad

    def fit(self, windows: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.01, seed: int = 11) -> "BiGru":
        """Adam over random batches in which every class has the same share."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(labels == k) for k in range(len(self.classes))]
        groups = [g for g in groups if len(g)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, steps + 1):
            pick = np.concatenate([rng.choice(g, max(1, batch // len(groups))) for g in groups])
            _, grad = self.step([windows[k] for k in pick.tolist()], labels[pick])
            now = rate * min(1.0, 2.0 * (1 - i / (steps + 1)))
            for k, g in grad.items():
                np.clip(g, -1, 1, out=g)
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] -= (now * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self


class Reader:
    """A model at work in one process; remembers the windows that it has labelled."""

    def __init__(self, model: BiGru):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.table = np.zeros((0, len(self.model.classes) + 1), np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if self.bytes > REMEMBERED:
            self._reset()
        known, docs, fresh = self.known, [], []
        for text in texts:
            parts = []  # (numbers of different tokens, how often each) of each piece of the text
            for piece in pieces(text or ""):
                tokens = piece.split()
                for token in dict.fromkeys(tokens):
                    if token not in known:
                        known[token] = len(known)
                        fresh.append(token)
                        self.bytes += TOKEN_BYTES + 4 * len(token)
                parts.append(np.unique(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)), return_counts=True))
            docs.append(parts)
        if fresh:
            windows, owner = [], []
            for i, token in enumerate(fresh):
                for w in windows_of(token):
                    windows.append(w)
                    owner.append(i)
            added = np.zeros((len(fresh), self.table.shape[1]), np.float32)
            if windows:
                distinct = {w: i for i, w in enumerate(dict.fromkeys(windows))}
                sums = self.model.sums(list(distinct))
                np.add.at(added, np.array(owner), sums[[distinct[w] for w in windows]])
            self.table = np.concatenate([self.table, added])
        out = []
        for text, parts in zip(texts, docs, strict=True):
            pooled = sum((times @ self.table[numbers].astype(np.float64) for numbers, times in parts), np.zeros(self.table.shape[1]))
            if not pooled[-1] or not _LETTER.search(text):
                out.append((UNKNOWN, 0.0))
                continue
            p = pooled[:-1] / pooled[-1]
            best = int(p.argmax())
            out.append((self.model.classes[best], float(min(1.0, p[best]))))
        return out


def held_out(doc_id: Column) -> Column:
    """Is crc32 of the id's text 2 modulo 4? A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """(lang, text): a bounded part of the documents of every language, none of them held out.

    Of l languages each gives SAMPLE_DOCS documents, or SAMPLE_ALL / l if that is less, but one at
    least, in a seeded order, while they have no more than SAMPLE_ALL_CHARS / l characters. Documents
    of over SAMPLE_CHARS characters are passed over, unless a language has no shorter one: then their
    first SAMPLE_CHARS characters are taken. Rows that are equal in id and text are one document.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    named = named.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")) & (F.length("text") > 0))
    named = named.select("lang", "id", F.left("text", F.lit(SAMPLE_CHARS)).alias("text"), (F.length("text") <= SAMPLE_CHARS).alias("whole"), F.xxhash64("id", "text").alias("h"))
    found = named.groupBy("lang", "whole").agg(F.approx_count_distinct("h").alias("fit"), F.min("h").alias("least"))
    best = F.max(F.struct("whole", "fit", "least")).alias("b")  # whole ones, if there are any
    found = materialize(found.groupBy("lang").agg(best).select("lang", "b.*"), "languages")
    n = max(1, found.count())
    most = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // n))
    # a language's documents are thinned by hash to some four times what is wanted before they are put in order
    draw = F.pmod("h", F.lit(1 << 30)) / (1 << 30)
    rows = named.join(broadcast_if_small(found), ["lang", "whole"]).where((draw * F.col("fit") < F.greatest(F.lit(4 * most), F.lit(40))) | (F.col("h") == F.col("least")))
    rows = rows.groupBy("lang", "id", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "h")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    rows = rows.withColumn("upto", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where((F.col("n") == 1) | (F.col("upto") <= SAMPLE_ALL_CHARS // n))
    return sorted((r["lang"], r["text"]) for r in rows.select("lang", "text").collect())


def train(rows: list[tuple[str, str]], *, steps: int = STEPS, hidden: int = HIDDEN) -> BiGru | None:
    """A model of the labelled texts; none if no label has a letter."""
    classes = sorted({lang for lang, text in rows if _LETTER.search(text)})
    if not classes:
        return None
    windows, labels = [], []
    for lang, text in rows:
        if lang in classes:
            for token in text.split():
                for w in windows_of(token):
                    windows.append(w)
                    labels.append(classes.index(lang))
    return BiGru(classes, hidden).fit(windows, np.array(labels), steps)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", steps: int = STEPS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The network learns from :func:`sample`, on the driver, and every whole text is labelled by
    Python workers: each white-space token is a window with a mark at either end for the white space
    around it, read in both directions; every byte and mark gets class probabilities, and a
    document's are their mean. No state crosses white space, so equal tokens have equal labels and
    are labelled once while a worker remembers them. Tokens without a letter (numbers, rules of
    dashes) name no language: they get no labels and no part in the mean. Only the text is an input.
    Null texts and texts without a letter are ``und`` with score 0, as are all texts if nothing could
    be learned. Rows that repeat an id are rows like others; other columns are ignored; an empty
    table gives an empty result. Texts of any length are read whole, a piece at a time.
    """
    model = train(sample(docs, id_col, text_col, lang_col), steps=steps)
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    readers: dict[int, Reader] = {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        reader = readers.setdefault(id(model), Reader(model)) if model else None
        for batch in parts(batches, 2):
            texts = batch.column(2).to_pylist()
            found = reader.predict(texts) if reader else [(UNKNOWN, 0.0)] * len(texts)
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return spread(rows).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, *, min_score: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", steps: int = STEPS) -> DataFrame:
    """The rows of ``docs`` whose language is told, with all their columns.

    Rejected are texts that are ``und`` and texts whose best language has a mean probability below
    ``min_score``; so all are rejected if nothing could be learned (no row has both a language and
    a text with letters). Rows are filtered where they are; none moves.
    """
    model = train(sample(docs, id_col, text_col, lang_col), steps=steps)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value) if sent.value else None
        for batch in parts(batches, at):
            if reader:
                found = reader.predict(batch.column(at).to_pylist())
                yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found]))

    return spread(docs).mapInArrow(run, docs.schema)
