"""Token counts under a unigram model, by forward scores kept in a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import parts
from lodestone.plans.sizes import spread

# Fixed value: the vocabulary's mark for the start of a word.
START = "▁"
#: Nodes of a task's trie, at about 200 bytes each.
NODES = 750_000
#: Bytes of words that a task remembers with their counts, what a word costs besides its own, and the longest.
REMEMBERED = 64 << 20
WORD_BYTES = 150
LONG = 256


def load_unigrams(path: str) -> dict[str, float]:
    """Piece -> log probability: Zipf's law over the rank of each piece in the public vocabulary.

    The file gives pieces in order of rank but no probabilities. Control and byte pieces are left out.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    whole = math.log(sum(1 / (r + 1) for r in range(len(names))))
    return {name: -math.log(r + 1) - whole for r, name in enumerate(names)}


class TrieCounter:
    """Numbers of tokens of the best segmentations of pre-tokens, kept in a trie of these.

    The node of a prefix holds the best score of the prefix and its number of tokens. It is made once,
    from the nodes above it, for all pre-tokens that begin so; the node where a pre-token ends holds
    its count. Ties go to fewer tokens. A character that no piece covers costs ``unknown`` and counts
    as its UTF-8 bytes. Beyond ``most`` nodes the trie starts anew.
    """

    def __init__(self, unigrams: dict[str, float], most: int = NODES):
        self.unigrams, self.most = unigrams, most
        self.unknown = min(unigrams.values()) - 10
        lengths: dict[str, set[int]] = {}
        for piece in unigrams:
            lengths.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: sorted(n) for c, n in lengths.items()}  # of pieces that end with c
        self._reset()

    def _reset(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]

    @property
    def nodes(self) -> int:
        return len(self.child)

    def count(self, word: str) -> int:
        if len(self.child) > self.most:
            self._reset()
        child, score, tokens, get, unknown = self.child, self.score, self.tokens, self.unigrams.get, self.unknown
        node, path = 0, [0]
        for end, c in enumerate(word, 1):
            below = child.get((node, c))
            if below is None:
                best, number = score[node] + unknown, tokens[node] + len(c.encode())
                for n in self.lengths.get(c, ()):
                    if n > end:
                        break
                    p = get(word[end - n : end])
                    if p is not None:
                        above = path[end - n]
                        s, k = score[above] + p, tokens[above] + 1
                        if s > best or (s == best and k < number):
                            best, number = s, k
                below = child[node, c] = len(score)
                score.append(best)
                tokens.append(number)
            path.append(below)
            node = below
        return tokens[node]

    def count_long(self, word: str) -> int:
        """The same by the last scores alone, for words too long to be worth nodes."""
        most = max(n for lengths in self.lengths.values() for n in lengths)
        score, tokens = [0.0], [0]  # of the last ``most`` prefixes
        for end, c in enumerate(word, 1):
            best, number = score[-1] + self.unknown, tokens[-1] + len(c.encode())
            for n in self.lengths.get(c, ()):
                if n > end:
                    break
                p = self.unigrams.get(word[end - n : end])
                if p is not None:
                    s, k = score[-n] + p, tokens[-n] + 1
                    if s > best or (s == best and k < number):
                        best, number = s, k
            score.append(best)
            tokens.append(number)
            if len(score) > 2 * most:
                del score[:-most], tokens[:-most]
        return tokens[-1]

    def counts(self, pretokens: Iterable[str]) -> dict[str, int]:
        return {word: self.count(word) for word in pretokens}


class _Words(dict):
    """Counts by word in UTF-8; a word that is not there yet goes through the trie."""

    def __init__(self, counter: TrieCounter):
        self.counter, self.bytes = counter, 0

    def __missing__(self, word: bytes) -> int:
        text = START + word.decode(errors="replace")
        if len(word) > LONG:
            return self.counter.count_long(text)
        found = self[word] = self.counter.count(text)
        self.bytes += WORD_BYTES + len(word)
        return found


def token_counts(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens of the whole text.

    A pre-token is a word between ASCII white space, with the mark of a word's start before it.
    Null and empty texts have no words. A task keeps one trie for all its documents, up to NODES
    nodes, and the counts of words of LONG bytes or less, up to REMEMBERED bytes; longer words get no
    nodes. Rows that repeat an
    id are rows like others; other columns are ignored; an empty table gives an empty result. No row
    leaves its partition.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(TrieCounter(load_unigrams(vocabulary_path)))
        for batch in parts(batches, 1):
            n_words, n_tokens = [], []
            for text in batch.column(1):
                if known.bytes > REMEMBERED:
                    known.clear()
                    known.bytes = 0
                words = text.as_buffer().to_pybytes().split()
                n_words.append(len(words))
                n_tokens.append(sum(map(known.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return spread(rows).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
