"""Scalar text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results.
FAMILY_HINTS = {
    "PSE": ["self-execution", "self execution", "sem", "selfexecution"],
    "PQD": ["quality", "inspection", "testing", "itp", "pqp", "qc", "hold point"],
    "PCM": ["customer", "satisfaction", "branding", "marketing", "survey", "commercial"],
    "PTN": ["tender", "tendering", "initiation", "launching", "bid submission", "loa", "handover"],
    "PVMO": ["vendor", "procurement", "purchase", "rfq", "quotation", "sourcing", "supplier"],
    "PCN": ["subcontract", "subcontractor", "contract", "agreement", "btb", "back-to-back"],
}
WORKFLOW_HINTS = (
    "workflow", "work flow", "flow chart", "flowchart", "diagram",
    "approval chain", "approval cycle", "approval flow", "approval route",
    "who approves", "who signs", "who authorises", "who authorizes",
    "sign off", "signs off", "signature matrix", "signatory",
    "next step", "what happens after", "what happens next", "goes to",
    "sequence", "order of approval", "routed", "routing", "escalate",
    "escalation", "sent back", "rejected", "cycle", "steps in",
)
DASHES = "‐‑‒–—−"
DASH = "[-‐‑‒–—−]"
FORM = rf"(?i)\bF\s*{DASH}\s*([A-Z])\s*{DASH}\s*([A-Z]{{1,5}})\s*{DASH}\s*(\d{{1,3}})\s*{DASH}\s*(\d{{1,3}})\b"
DOC_CODE = rf"(?i)\b([PM])\s*{DASH}\s*([A-Z]{{1,5}})\s*{DASH}\s*(\d{{1,3}})\b"
MONEY = r"(?i)\b\d[\d,\.]*\s*(?:K|M|EGP|LE)\b"
LOOP_WORDS = ("not approved", "rejected", "reject", "return", "revise", "مرفوض")
REFUSAL_MARKS = (
    "not specified", "not covered", "does not", "no information",
    "isn't in the context", "not in the context", "لا يوجد", "غير محدد",
    "لم يتم", "غير مذكور",
)
FULL_CODE = r"^[A-Za-z]-[A-Za-z]-[A-Za-z]{2}-[\d-]+$"
FIGURE = r"\d+(?:[.,]\d+)?%?"


def singular(word: Column) -> Column:
    """Without a final s, if longer than three and not ending in ss, us or is."""
    plural = (F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us") & ~word.endswith("is")
    return F.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def tokenize(text: Column) -> Column:
    """Lower-case ASCII words and numbers, each in its singular."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), singular)


def embed_text(title: Column, section: Column, text: Column) -> Column:
    e = F.lit("")
    return F.concat(F.coalesce(title, e), F.lit(" | "), F.coalesce(section, e), F.lit("\n"), F.coalesce(text, e))


def doc_family(code: Column, filename: Column) -> Column:
    """The family of a document code, or of a file name where there is none; null if neither has one."""
    named = F.upper(F.when(F.coalesce(code, F.lit("")) != "", code).otherwise(filename))
    pattern = r"^(?:F-)?([PM])-?([A-Z]{2,4})-?\d"
    return F.nullif(F.concat(F.regexp_extract(named, pattern, 1), F.regexp_extract(named, pattern, 2)), F.lit(""))


def route_families(query: Column) -> Column:
    """Families whose codes the question spells out, in order, once each."""
    pattern = r"\bF?-?([PM])-([A-Z]{2,3})-\d"
    q = F.upper(query)
    letters, names = F.regexp_extract_all(q, F.lit(pattern), F.lit(1)), F.regexp_extract_all(q, F.lit(pattern), F.lit(2))
    return F.array_sort(F.array_distinct(F.zip_with(letters, names, lambda a, b: F.concat(a, b))))


def hinted_families(query: Column, hints: dict[str, list[str]] = FAMILY_HINTS) -> Column:
    """Spelt-out families, or else those that a hint names."""
    q = F.lower(query)
    named = F.array_compact(F.array(*[F.when(contains_any(q, words), F.lit(f)) for f, words in hints.items()]))
    explicit = route_families(query)
    return F.when(F.size(explicit) > 0, explicit).otherwise(F.array_sort(named))


def contains_any(text: Column, parts: tuple | list) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def workflow_intent(query: Column) -> Column:
    """Does the question ask for a route or approval chain?"""
    return contains_any(F.lower(F.coalesce(query, F.lit(""))), WORKFLOW_HINTS)


def normal_code(code: Column) -> Column:
    """Without white space, upper case, every dash an ASCII hyphen."""
    return F.translate(F.upper(F.regexp_replace(code, r"\s+", "")), DASHES, "-" * len(DASHES))


def form_codes(text: Column) -> Column:
    """Form numbers in order of first mention, normalised."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FORM), F.lit(0)), normal_code))


def doc_codes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DOC_CODE), F.lit(0)), normal_code)


def uncited_doc_codes(text: Column, cited: Column) -> Column:
    """Document codes that are no part of a cited form number."""
    return F.filter(doc_codes(text), lambda c: ~F.exists(cited, lambda f: F.contains(f, c)))


def share_of(text: Column, inside: str, among: str = r"\p{L}") -> Column:
    """Characters matching ``inside`` as a share of those matching ``among``; null if there are none."""
    n = lambda p: F.length(F.regexp_replace(text, f"[^{p}]", ""))
    return n(inside) / F.nullif(n(among), F.lit(0))


def arabic_share(text: Column) -> Column:
    """Letters of the Arabic blocks among all letters; signs and digits count nowhere. Null without letters."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return share_of(letters, r"؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿")


def is_arabic(text: Column, least: float = 0.2) -> Column:
    return F.coalesce(arabic_share(text) >= least, F.lit(False))


def text_quality_ok(text: Column) -> Column:
    """At least 20 characters when trimmed, and over two fifths of all characters letters."""
    t = F.coalesce(text, F.lit(""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return (F.length(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")) >= 20) & (letters / F.greatest(F.length(t), F.lit(1)) > 0.4)


def strip_reasoning(text: Column) -> Column:
    """Without <think> parts; what stands before one that never closes stays."""
    closed = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(closed, r"(?is)<think>.*", ""))


def summarize(answer: Column, most: int = 200) -> Column:
    """The first sentence in one line, of 200 characters at most."""
    line = F.trim(F.regexp_replace(answer, r"\s+", " "))
    return F.rtrim(F.left(F.regexp_extract(line, r"^(.*?[.!?](?=\s)|.*)", 1), F.lit(most)))


def eastern_digits(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[٠-٩۰-۹]"), F.lit(0))))


def normal_filename(name: Column) -> Column:
    """Hyphens and brackets go, other signs become one underscore, and the suffix is .pdf."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[-()]", "")
    return F.concat(F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""), F.lit(".pdf"))


def repetition_key(line: Column) -> Column:
    return F.regexp_replace(line, r"\d+", "#")


def normal_heading(heading: Column) -> Column:
    """Without a leading number; upper-case letters and spaces only."""
    bare = F.upper(F.regexp_replace(heading, r"^\s*\d{1,2}(?:\.\d{1,2}){0,3}\.?\s*", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^A-Z ]", " "), r"\s+", " "))


def slug(text: Column, most: int = 40) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit("node"))), r"[^a-z0-9]+", "_")
    short = F.left(F.regexp_replace(bare, r"^_+|_+$", ""), F.lit(most))
    return F.when(short == "", F.lit("node")).otherwise(short)


def unique_slugs(slugs: Column) -> Column:
    """An array of slugs with a number, from _2, behind those that were there before; a name so made is taken too."""
    def free(taken: Column, s: Column) -> Column:
        made = F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda n: F.concat_ws("_", s, n.cast("string")))
        return F.when(F.array_contains(taken, s), F.filter(made, lambda m: ~F.array_contains(taken, m))[0]).otherwise(s)

    return F.aggregate(slugs, F.array().cast("array<string>"), lambda taken, s: F.array_append(taken, free(taken, s)))


def display_name(filename: Column) -> Column:
    """A file's name for readers: no suffix, underscores as blanks, a leading PCN01 as P-CN-01."""
    stem = F.translate(F.regexp_replace(filename, r"(?i)\.pdf$", ""), "_", " ")
    return F.trim(F.regexp_replace(stem, r"^([PM])([A-Z]{2,3})(\d{2})\b", "$1-$2-$3"))


def normal_label(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def family_and_variant(filename: Column) -> Column:
    """struct(family, variant): the stem split once at ' - '."""
    parts = F.split(F.regexp_replace(filename, r"\.[^.]*$", ""), " - ", 2)
    return F.struct(F.trim(parts[0]).alias("family"), F.trim(F.try_element_at(parts, F.lit(2))).alias("variant"))


def refused(answer: Column) -> Column:
    return contains_any(F.lower(answer), REFUSAL_MARKS)


def refused_with(answer: Column, refusal: Column | str, chars: int = 28) -> Column:
    """Does an answer hold the beginning of this refusal?"""
    start = F.left(F.lower(F.lit(refusal) if isinstance(refusal, str) else refusal), F.lit(chars))
    return F.contains(F.lower(F.coalesce(answer, F.lit(""))), start)


def target_tokens(target: Column) -> Column:
    """What survives translation: a code as a whole, or else the figures."""
    return F.when(F.trim(target).rlike(FULL_CODE), F.array(F.trim(target))).otherwise(F.regexp_extract_all(target, F.lit(FIGURE), F.lit(0)))


def amounts(text: Column) -> Column:
    """Money amounts, upper case without spaces, once each."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MONEY), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.upper(F.replace(x, F.lit(" "), F.lit("")))))


def is_loop(condition: Column) -> Column:
    """Does an edge lead back after a rejection?"""
    return contains_any(F.lower(F.coalesce(condition, F.lit(""))), LOOP_WORDS)


def doc_metadata(text: Column, filename: Column) -> Column:
    """struct(doc_code, title) of a document control block."""
    code = F.nullif(F.regexp_extract(text, r"(?i)Doc\.?\s*No\.?:?\s*([A-Z\-\d]+)", 1), F.lit(""))
    title = F.nullif(F.trim(F.regexp_extract(text, r"(?m)^(.*?)(?:\r?\n)Effective Date", 1)), F.lit(""))
    return F.struct(code.alias("doc_code"), F.coalesce(title, F.regexp_replace(filename, r"\.[^.]*$", "")).alias("title"))


def workflow_steps(text: Column) -> Column:
    """Ordered steps of a rendered workflow: lines '  1. label'."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s+\d+\.\s+(.+)$"), F.lit(1))


def workflow_routes(text: Column) -> Column:
    """array of struct(src, dst, condition) from lines '  - a -> b [c]'."""
    line = r"(?m)^\s+- (.+?) -> (.+?)(?: \[(.+)\])?$"
    part = lambda g: F.regexp_extract_all(text, F.lit(line), F.lit(g))
    return F.transform(F.arrays_zip(part(1).alias("src"), part(2).alias("dst"), part(3).alias("condition")), lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst"), F.nullif(x["condition"], F.lit("")).alias("condition")))
