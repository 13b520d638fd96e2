"""Sessions: the last turns, and whether a message leans on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_TURNS = 4
# Word lists of the gate.
FRAGMENT_STARTS = (
    "in the", "in ", "for the", "and for", "and in", "and the", "and ",
    "what about", "how about", "what if", "which one", "which of",
    "same for", "same in", "also for", "also in", "or the", "or ",
    "but the", "but ", "then ", "ok and", "okay and",
)
WH_WORDS = ("who", "what", "when", "where", "why", "which", "how", "whose", "whom")
AUX = (
    "is", "are", "was", "were", "be", "am", "does", "do", "did", "can", "could",
    "should", "shall", "must", "will", "would", "has", "have", "had", "may",
    "might",
)
IMPERATIVES = (
    "approve", "sign", "send", "use", "require", "need", "prepare", "issue",
    "submit", "list", "define", "give", "show", "tell", "name", "add",
    "continue", "finish", "complete", "keep", "repeat", "redo", "carry",
    "provide", "include", "expand", "elaborate", "check", "go", "state",
)
ANAPHORA = ("it", "its", "that", "this", "those", "these", "them", "they", "he", "she", "his", "her", "there", "one", "ones", "same")
RESIDUAL = (
    "rest", "remainder", "remaining", "else", "other", "others", "another",
    "more", "further", "additional", "extra", "leftover", "besides",
)
DISCOURSE = (
    "you", "your", "yours", "youre", "youve", "u", "ur",
    "answer", "answers", "answered", "response", "reply", "replied",
    "said", "says", "told", "listed", "mentioned", "gave", "wrote", "output",
    "earlier", "previously", "already",
    "missed", "missing", "incomplete", "forgot", "forgotten", "skipped",
    "omitted", "truncated", "halfway", "wrong",
)
DETERMINERS = ("this", "that", "these", "those")
EXISTENTIAL_FOLLOWERS = ("is", "are", "was", "were", "has", "have", "had", "will", "would", "s", "re")
NEGATIONS = ("not", "n't", "never", "nt")
SEQUENCE_PREPOSITIONS = ("after", "before", "following", "since", "given", "besides", "beyond", "past", "until", "till")
HEAD_WORDS = 6
LOCAL_WORDS = 6
STANDALONE_WORDS = 3


def last_turns(turns: DataFrame, session: str = "session_id", order: str = "turn", n: int = MAX_TURNS) -> DataFrame:
    """The last n turns of each session, with ``back`` from 1 for the latest."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def with_previous(turns: DataFrame, columns: list[str], session: str = "session_id", order: str = "turn") -> DataFrame:
    """``turns`` with ``previous_<column>`` of the turn before in the session, null for the first."""
    w = Window.partitionBy(session).orderBy(order)
    return turns.select("*", *[F.lag(c).over(w).alias(f"previous_{c}") for c in columns])


def _words(q: Column) -> Column:
    return F.regexp_extract_all(q, F.lit("[a-z0-9']+"), F.lit(0))


def _stem(w: Column) -> Column:
    return F.split(w, "'")[0]


def _in(w: Column, words: tuple) -> Column:
    return w.isin(*words)


def back_references(words: Column, acronyms: Column) -> Column:
    """Words among the first six that point backwards out of their own sentence, sorted.

    'there' before a verb, determiners before a noun and capitalised abbreviations do not.
    """

    def hit(w: Column, i: Column) -> Column:
        stem, short = _stem(w), F.contains(w, F.lit("'"))
        after = F.coalesce(_stem(F.try_element_at(words, i + 2)), F.lit(""))
        before = F.when(i > 0, _stem(F.try_element_at(words, F.greatest(i, F.lit(1))))).otherwise("")
        exists = ~short & ~_in(after, EXISTENTIAL_FOLLOWERS)
        pronoun = short | _in(after, AUX) | _in(after, NEGATIONS) | (_in(before, AUX) & (after != "")) | _in(before, SEQUENCE_PREPOSITIONS)
        points = F.when(stem == "there", exists).when(_in(stem, DETERMINERS), pronoun).otherwise(_in(stem, ANAPHORA))
        return F.when(points & ~F.array_contains(acronyms, stem), stem)

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.slice(words, 1, LOCAL_WORDS), hit))))


def followup_gate(messages: DataFrame, query: str = "query", has_history: str = "has_history") -> DataFrame:
    """Adds ``is_followup`` and ``reasons``.

    A message stands alone only if it has more than three words, opens with a question word or
    auxiliary, and names nothing that it does not itself explain; all others lean on the session.
    """
    raw = F.coalesce(F.col(query), F.lit(""))
    out = messages.withColumn("_q", F.trim(F.regexp_replace(F.lower(raw), r"\s+", " "))).withColumn("_w", _words(F.col("_q")))
    acronyms = F.transform(F.regexp_extract_all(raw, F.lit(r"\b[A-Z]{2,}\b"), F.lit(0)), F.lower)
    vocab = F.array_union("_w", F.transform(F.filter("_w", lambda w: F.contains(w, F.lit("'"))), _stem))
    listed = lambda words: F.array_sort(F.array_intersect(vocab, F.array(*[F.lit(w) for w in words])))
    clauses = F.slice(F.split("_q", "[,;.]"), F.lit(2), F.size(F.split("_q", "[,;.]")))
    heads = F.concat(F.slice("_w", 1, HEAD_WORDS), F.array_compact(F.transform(clauses, lambda c: F.try_element_at(_words(c), F.lit(1)))))
    fragment = F.lit(False)
    for start in FRAGMENT_STARTS:
        fragment = fragment | F.col("_q").startswith(start)
    out = out.withColumn("_back", back_references(F.col("_w"), acronyms)).withColumn("_rest", listed(RESIDUAL)).withColumn("_talk", listed(DISCOURSE))
    out = out.withColumn("_fragment", fragment).withColumn("_opens", F.exists(heads, lambda w: _in(w, WH_WORDS + AUX))).withColumn("_n", F.size("_w"))
    named = lambda text, c: F.when(F.size(c) > 0, F.concat(F.lit(text + " ("), F.array_join(c, ", "), F.lit(")")))
    first = F.coalesce(F.try_element_at("_w", F.lit(1)), F.lit(""))
    opener = F.when(_in(first, IMPERATIVES), F.concat(F.lit("imperative opener ("), first, F.lit(")"))).otherwise("does not open like a standalone question")
    reasons = F.array_compact(F.array(
        F.when(F.col("_fragment"), "starts with a fragment opener"),
        named("back-reference", "_back"),
        named("refers to a remainder", "_rest"),
        named("refers to the conversation", "_talk"),
        F.when(~F.col("_opens"), opener),
        F.when(F.col("_n") <= STANDALONE_WORDS, F.concat(F.lit("very short ("), F.col("_n").cast("string"), F.lit(" words)"))),
    ))
    alone = F.array(F.lit("opens like a standalone question, nothing to resolve against history"))
    said = F.when(~F.col(has_history), F.array(F.lit("no history"))).when(F.col("_q") == "", F.array(F.lit("empty query"))).when(F.size(reasons) == 0, alone).otherwise(reasons)
    fires = F.col(has_history) & (F.col("_q") != "") & (F.size(reasons) > 0)
    return out.withColumn("is_followup", fires).withColumn("reasons", said).drop("_q", "_w", "_back", "_rest", "_talk", "_fragment", "_opens", "_n")


def resolve(messages: DataFrame, label: Column, rewritten: Column, has_hits: Column) -> DataFrame:
    """Adds mode (new, followup, continuation) and query_used after :func:`followup_gate`.

    ``label`` is a classifier's word: only CONTINUATION with earlier hits continues; anything else,
    and any failure (null), is a follow-up. A null or blank rewriting leaves the message as it is.
    """
    goes_on = F.col("is_followup") & F.coalesce(F.upper(F.trim(label)) == "CONTINUATION", F.lit(False)) & has_hits
    mode = F.when(goes_on, "continuation").when(F.col("is_followup"), "followup").otherwise("new")
    better = F.coalesce(F.nullif(F.trim(rewritten), F.lit("")), F.col("query"))
    return messages.withColumn("mode", mode).withColumn("query_used", F.when(F.col("mode") == "followup", better).otherwise(F.col("query")))


def clean_label(text: Column) -> Column:
    """CONTINUATION or FOLLOWUP: what the first line that names a label says, FOLLOWUP if it names both or none does."""
    words = lambda line: F.array_distinct(F.filter(F.regexp_extract_all(F.upper(line), F.lit("[A-Z]+"), F.lit(0)), lambda w: w.isin("FOLLOWUP", "CONTINUATION")))
    named = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), words), lambda w: F.size(w) > 0)
    first = F.get(named, F.lit(0))
    return F.when(F.size(first) == 1, first[0]).otherwise(F.lit("FOLLOWUP"))


def clean_rewrite(text: Column, fallback: Column) -> Column:
    """The first line that says something, without preamble and quotes; else, or if under three words or over 300 characters, ``fallback``."""
    line = F.try_element_at(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim), lambda x: x != ""), F.lit(1))
    bare = F.trim(F.regexp_replace(F.regexp_replace(line, r"(?i)^(?:sure[,!.]?\s*)?(?:here(?:'s| is)[^:]*:|(?:rewritten|standalone|question|query)[^:]*:)\s*", ""), "^[\"'“”`]+|[\"'“”`]+$", ""))
    fits = (F.size(F.split(bare, r"\s+")) >= 3) & (F.char_length(bare) <= 300)
    return F.when(F.coalesce(fits, F.lit(False)), bare).otherwise(fallback)


def format_history(turns: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, history): Q/A lines of (session, turn, query, answer_summary), oldest first."""
    line = F.concat(F.lit("Q: "), F.col("query"), F.lit("\nA: "), F.coalesce("answer_summary", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy(session).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("history"))
