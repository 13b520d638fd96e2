"""Secret scans: fixed patterns, and windows of high entropy in candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import parts
from lodestone.plans.sizes import spread

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")

#: Candidate strings: unbroken runs of key characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: (kind, characters, window in characters, bits a character at least). A window's entropy is at most log2 of
#: its length; random characters of a class come close to it, words and numbers stay below. The last four are
#: alphabets in which a key is written whole; their bits are what about 98 of 100 random windows of the least
#: alphabet reach: lower case and digits, base32, both cases. Letters alone have the same bits as both cases.
CLASSES = (
    ("entropy_hex", frozenset("0123456789abcdefABCDEF"), 24, 3.0),
    ("entropy_key", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 20, 3.9),
    ("entropy_lower", frozenset("abcdefghijklmnopqrstuvwxyz0123456789"), 20, 3.44),
    ("entropy_upper", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20, 3.4),
    ("entropy_mixed", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 20, 3.62),
    ("entropy_letters", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), 20, 3.62),
)
#: Strings that are no secrets although they look random.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # identifiers
    re.compile(r"[0-9_+/=-]+"),  # numbers, dates, rules
    re.compile(r"[A-Za-z_+/=-]+"),  # words and paths without a digit
    re.compile(r"(?i)[a-z]+([-_/][a-z]+)*[-_/]?[0-9]{1,4}"),  # a name with a number
)
#: Part of a name in camel case: two small letters or more after each capital but the last, or a short word.
CAMEL = re.compile(r"[a-z]*([A-Z]+[a-z]{2,}|As|At|By|Do|If|In|Is|It|No|Of|On|Or|To|Up)*[A-Z]*[a-z]*")
#: Marks of samples: what goes is the piece between joining characters that holds one, not a key next to it.
FILLER = re.compile(r"(?i)example|sample|placeholder|your(?=[_-])|dummy|xxxx|0123456789|abcdefgh")
#: Characters of a piece on either side of a mark that go with it; in longer pieces marks occur by chance.
REACH = 40


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; leftmost and not overlapping within a kind."""
    out = []
    folded = text.lower()
    if any(w in folded for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX_LONG.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def high_windows(text: str, characters: frozenset, window: int, least: float) -> list[tuple[int, int]]:
    """Unions of the windows, all of one class, whose Shannon entropy is ``least`` bits or more.

    The counts of the window change by one character in and one out, and with them the sum of
    c log2 c from which the entropy follows.
    """
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    spans: list[tuple[int, int]] = []
    start, total, whole = 0, 0.0, math.log2(window)
    for i, c in enumerate(text):
        if c not in characters:
            counts, start, total = {}, i + 1, 0.0
            continue
        if i - start == window:
            gone = text[start]
            n = counts[gone]
            counts[gone] = n - 1
            total += term[n - 1] - term[n]
            start += 1
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += term[n + 1] - term[n]
        if i - start == window - 1 and whole - total / window >= least - 1e-9:
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def _without_fillers(run: str) -> str:
    """The run with blanks for each mark of samples, its piece about it, and the joining character behind that."""
    kept, end = [], 0
    for m in FILLER.finditer(run):
        if m.start() < end:
            continue
        start, stop = m.span()
        while start > max(end, m.start() - REACH) and run[start - 1].isalnum():
            start -= 1
        while stop < min(len(run), m.end() + REACH) and run[stop].isalnum():
            stop += 1
        stop += run[stop : stop + 1] in ("/", "_", "=", "-")
        kept += [run[end:start], " " * (stop - start)]
        end = stop
    return "".join(kept) + run[end:]


def _is_key(kind: str, span: str) -> bool:
    """Does a span of this class count, whatever string it is a part of?"""
    one_case = span.islower() or span.isupper()
    if kind == "entropy_letters":
        return one_case or not CAMEL.fullmatch(span)
    if kind == "entropy_mixed" and one_case:
        return False  # lower and upper have it, with fewer bits
    return kind in ("entropy_hex", "entropy_key") or not any(a.fullmatch(span) for a in ALLOWED)


def added_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) that the entropy method finds."""
    out = []
    for run in CANDIDATE.finditer(text):
        for m in CANDIDATE.finditer(_without_fillers(run.group())):
            string, at = m.group(), run.start() + m.start()
            allowed = string.isalpha() or any(a.fullmatch(string) for a in ALLOWED)
            for kind, characters, window, least in CLASSES:
                if kind == "entropy_letters" or not allowed:
                    spans = high_windows(string, characters, window, least)
                    out += [(at + a, at + b, kind) for a, b in spans if _is_key(kind, string[a:b])]
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(text: str) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, base_sha256, spans."""
    base = base_spans(text)
    order = [*KINDS, *(c[0] for c in CLASSES)]
    every = sorted([*base, *added_spans(text)], key=lambda s: (s[0], order.index(s[2])))
    n = [sum(s[2] == kind for s in base) for kind in KINDS]
    return *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Whole texts are read; null is empty, and has no span. Spans count code points, their end is
    exclusive. ``spans`` has the base spans, all of them, and those of the entropy method, which may
    overlap them. Rows that repeat an id are rows like others; other columns are ignored; an empty
    table gives an empty result. No row leaves its partition.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            found = [scan(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([f[i] for f in found], pa.int64() if i < 3 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return spread(rows).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
