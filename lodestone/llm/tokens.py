"""Ids of a public word-BPE vocabulary, looked up word by word."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of words and their ids that a worker remembers, beyond which the memory starts anew; what a word costs besides
#: its own bytes, and the longest word that is remembered.
REMEMBERED = 80 << 20
WORD_BYTES = 150
LONG = 1024
# How the vocabulary's own pre-tokenizer cuts a lower-cased word.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Visible ASCII and Latin-1: normal form C and lower-casing act on each such character alone.
PLAIN = regex.compile(r"[!-~\xa1-\xff]+")
#: Runs of ids that are put in a row at a time.
RUNS = 1 << 15
#: Classes of characters in PIECES; words with an ODD one are no plain ones, or have an apostrophe.
ODD, LETTER, NUMBER, OTHER = range(4)


def _class(code: int) -> int:
    char = chr(code)
    if char == "'" or not PLAIN.fullmatch(char):
        return ODD
    return LETTER if regex.match(r"\p{L}", char) else NUMBER if regex.match(r"\p{N}", char) else OTHER


#: Class of each byte in UTF-8: alone, after the byte C2 and after C3; and each byte in lower case, alone and after C3.
ALONE = np.array([_class(b) if b < 128 else ODD for b in range(256)], np.uint8)
AFTER = [np.array([_class((lead & 3) << 6 | b & 63) if b >> 6 == 2 else ODD for b in range(256)], np.uint8) for lead in (0xC2, 0xC3)]
LOWER = np.array([b | 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
LOWER_C3 = np.array([b | 32 if 0x80 <= b <= 0x9E and b != 0x97 else b for b in range(256)], np.uint8)


def _byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Packed little-endian ids of texts, equal to ``encode(text, add_special_tokens=False)``.

    The vocabulary's normaliser and pre-tokenizer never join across ASCII white space, so a text's
    ids are its words' ids in a row. Words of plain characters go piece by piece to the library's
    BPE model; any other word goes through the library's whole ``encode``.
    """

    _loaded: dict[str, "WordBpe"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words = _Words(self)
        self.pieces: dict[str, bytes] = {}
        self.bytes = 0
        self.known, self.known_odd = Memory(REMEMBERED), Memory(REMEMBERED // 2)

    @classmethod
    def load(cls, path: str) -> "WordBpe":
        """One object per worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            shown = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
            if len(piece) <= LONG:
                self.pieces[piece] = found
                self.bytes += WORD_BYTES + len(piece) + len(found)
        return found

    def word(self, data: bytes) -> bytes:
        """Packed ids of one word in UTF-8."""
        word = data.decode(errors="replace")
        if word.isascii():  # nearly all words: letters, and perhaps a stop or comma
            if word.isalpha():
                return self._piece(word.lower())
            if word[-1] in ".," and word[:-1].isalpha():
                return self._piece(word[:-1].lower()) + self._piece(word[-1])
        if PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join([self._piece(p) for p in PIECES.findall(word.lower())])
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def packed(self, text: bytes) -> bytes:
        """Four bytes per id of a text in UTF-8 (split() of bytes splits at ASCII white space only)."""
        if self.bytes > REMEMBERED:
            self.words.clear()
            self.pieces.clear()
            self.bytes = 0
        return b"".join(map(self.words.__getitem__, text.split()))

    def packed_all(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (binary, no nulls) in a row, each followed by the id ``end``, and how many each has.

        The same ids as of :meth:`packed`. The different words of the texts are cut into pieces together,
        and pieces are looked up once while they are remembered.
        """
        if self.bytes > REMEMBERED:  # pieces of words that were looked up one by one
            self.words.clear()
            self.pieces.clear()
            self.bytes = 0
        texts = texts.cast(pa.binary())
        _, offsets, data = texts.buffers()
        # strings only by name: the split asks for no more than ASCII white space, and may give empty words
        lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), offsets, data, None, 0, texts.offset))
        found = lists.flatten().dictionary_encode()
        ids, sizes = self._words(found.dictionary.view(pa.binary()))
        ids, sizes = np.append(ids, np.frombuffer(end, "<u4")), np.append(sizes, 1)
        upto = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))  # words of the texts
        said = np.insert(found.indices.to_numpy(), upto[1:], len(sizes) - 1)
        of_texts, counts = _gather(ids, sizes, said)
        # a text has its words and its end id
        return of_texts, np.diff(np.cumsum(counts)[upto[1:] + np.arange(len(texts))], prepend=0)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row and how many each has: plain words are cut by classes of bytes, others one by one."""
        starts, lowered, odd = _cut(words)
        if odd.any():
            rest = self.known_odd.values(words.filter(pa.array(odd)).to_pylist(), lambda new: [self.word(w) for w in new])
            some, some_sizes = self._words(words.filter(pa.array(~odd)))
            ids = np.concatenate([some, np.frombuffer(b"".join(rest), "<u4")])
            sizes = np.concatenate([some_sizes, np.fromiter(map(len, rest), np.int64, len(rest)) >> 2])
            place = np.empty(len(words), np.int64)
            place[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(words))
            return _gather(ids, sizes, place)
        at = np.flatnonzero(starts)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(lowered)).astype(np.int32)), pa.py_buffer(lowered)]).dictionary_encode()
        found = self.known.values(pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), self._pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ids, counts = _gather(np.frombuffer(b"".join(found), "<u4"), sizes, pieces.indices.to_numpy())
        offsets = _offsets(words)
        upto = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(starts))[offsets - offsets[0]]]
        return ids, np.diff(upto)

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        tokenize, letters = self.model.tokenize, self.letters
        shown = [p.decode() if p.isascii() else "".join([letters[b] for b in p]) for p in pieces]
        ids = [[t.id for t in tokenize(s)] for s in shown]
        packed = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) << 2).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def _cut(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words' bytes: whether a piece begins there, and the bytes in lower case; of the words: whether one is odd."""
    offsets = _offsets(words)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    kind, lowered = ALONE[data], LOWER[data]
    follows = np.zeros(len(data), bool)
    if data.max(initial=0) > 127:
        for lead, after in zip((0xC2, 0xC3), AFTER, strict=True):
            at = np.flatnonzero(data[:-1] == lead)
            at = at[~first[at + 1]]
            kind[at] = kind[at + 1] = after[data[at + 1]]
            follows[at + 1] = True
            if lead == 0xC3:
                lowered[at + 1] = LOWER_C3[data[at + 1]]
    bad = kind == ODD
    bad[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    odd = np.zeros(len(words), bool)
    odd[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = True
    starts = first | ((kind == NUMBER) & ~follows)
    starts[1:] |= kind[1:] != kind[:-1]
    return starts, lowered, odd


def _gather(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``ids`` (of such sizes, in a row) in the order of ``which``, and the sizes of those; some runs at a time."""
    counts = sizes.take(which)
    ends, begins = np.cumsum(counts), np.cumsum(sizes) - sizes
    out = np.empty(int(ends[-1]) if len(ends) else 0, ids.dtype)
    for first in range(0, len(which), RUNS):
        rows = slice(first, first + RUNS)
        start, end = int(ends[first] - counts[first]), int(ends[rows][-1])
        at = np.repeat(begins.take(which[rows]) - ends[rows] + counts[rows] + start, counts[rows])
        at += np.arange(end - start)
        ids.take(at, out=out[start:end], mode="clip")
    return out, counts


class Memory:
    """Values by key in some ``limit`` bytes; what has not been asked for while half of them came in is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.bytes = limit, 0
        self.new: dict = {}
        self.old: dict = {}

    def values(self, keys: list, make: Callable[[list], list]) -> list:
        """The values of different keys; ``make`` gives those of keys that are not remembered."""
        if self.bytes > self.limit // 2:
            self.old, self.new, self.bytes = self.new, {}, 0
        out = list(map(self.new.get, keys))
        rest = [i for i, v in enumerate(out) if v is None]
        asked = [keys[i] for i in rest]
        values = list(map(self.old.get, asked))
        gone = [i for i, v in enumerate(values) if v is None]
        if gone:
            for i, v in zip(gone, make([asked[i] for i in gone]), strict=True):
                values[i] = v
        for i, key, value in zip(rest, asked, values, strict=True):
            out[i] = value
            if len(key) <= LONG:
                self.new[key] = value
                self.bytes += WORD_BYTES + len(key) + len(value)
        return out


class _Words(dict):
    """Packed ids by word; a word that is not there yet is looked up."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe

    def __missing__(self, word: bytes) -> bytes:
        found = self.bpe.word(word)
        if len(word) <= LONG:
            self[word] = found
            self.bpe.bytes += WORD_BYTES + len(word) + len(found)
        return found
