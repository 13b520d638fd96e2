"""From questions to checked answers; text generation and encoding are callables that the caller gives."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.masking import masked_for_translation, unmasked_translation
from lodestone.functions.text import eastern_digits, is_arabic, strip_reasoning, workflow_intent
from lodestone.operators.conversation import clean_label, clean_rewrite, followup_gate
from lodestone.operators.retrieval import context_budget
from lodestone.operators.validation import format_context, validate, variant_conflicts
from lodestone.plans.scratch import materialize
from lodestone.plans.sizes import PIECE

Generator = Callable[[str], str]

WORKFLOW_FORMAT = """The context has an approval diagram. Begin with 'The workflow begins with', then number the steps in order. Where a step branches, write
'A decision is made:' and a bullet for each of its own routes, 'If [condition], it moves to [step]' or 'it returns to [step]'. Tell every line of Routing once,
use no condition of another step, end with who closes the workflow, and list under 'Returns and loops:' each route that goes back."""
VARIANT_RULE = """The context holds several versions of one process. Answer from one version only, that which the question names or else the first; say first which
one it is, mix no steps, approvers or amounts of others, and name the others at the end."""
ARABIC_RULE = "Answer in Modern Standard Arabic; keep file names, codes and form numbers in Latin script and digits."
SOURCE_RULE = "Name the source document once, on a last line of its own."
LABEL_TASK = "Is the new message a FOLLOWUP, which asks something that needs the conversation to be understood, or a CONTINUATION, which says that the last answer is incomplete or wrong? One word."
REWRITE_TASK = "Write the new message as one question that stands alone; keep every name that it uses."


class BadRequest(ValueError):
    """The server does not take the request as it is (status 400), perhaps because of an option."""


ERRORS = {TimeoutError: "timeout", ConnectionError: "unreachable", ValueError: "bad_response", KeyError: "no_model"}


def build_prompt(question: Column, context: Column, has_variants: Column, workflow: Column | None = None, answer_in: Column | None = None) -> Column:
    """The rules that apply, the context, and the question; ``answer_in`` tells whether the answer is to be Arabic, if not the question."""
    wf = workflow_intent(question) if workflow is None else workflow
    rule = lambda when, text: F.when(F.coalesce(when, F.lit(False)), F.lit(text))
    return F.concat_ws("\n\n", F.lit("Answer from the context only. " + SOURCE_RULE), rule(wf, WORKFLOW_FORMAT), rule(has_variants, VARIANT_RULE), rule(is_arabic(question) if answer_in is None else answer_in, ARABIC_RULE), F.concat(F.lit("Context:\n"), context), F.concat(F.lit("Question: "), question))


def continuation_prompt(question: Column, context: Column, previous: Column, has_variants: Column | None = None) -> Column:
    """A second pass over the same context, which leaves out what the first one said."""
    rules = [F.when(F.coalesce(has_variants, F.lit(False)), F.lit(VARIANT_RULE))] if has_variants is not None else []
    return F.concat_ws("\n\n", F.lit("Go on with the answer; repeat nothing, and say so if nothing is left. " + SOURCE_RULE), *rules, F.when(is_arabic(question), F.lit(ARABIC_RULE)), F.concat(F.lit("Context:\n"), context), F.concat(F.lit("Answer so far:\n"), previous), F.concat(F.lit("Request: "), question))


def generate(prompts: DataFrame, generator: Generator, prompt: str = "prompt", plain: Generator | None = None) -> DataFrame:
    """``prompts`` with response and error_type; a failure is a value of its row, not of the run.

    A request that is refused as bad is made once more, by ``plain`` if there is one.
    """

    def ask(text: str) -> str:
        try:
            return generator(text)
        except BadRequest:
            return (plain or generator)(text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said, errors = [], []
            for p in batch[prompt]:
                try:
                    said.append(ask(p))
                    errors.append(None)
                except Exception as e:
                    said.append(None)
                    errors.append(next((name for kind, name in ERRORS.items() if isinstance(e, kind)), "failed"))
            yield batch.assign(response=pd.Series(said, dtype=object, index=batch.index), error_type=pd.Series(errors, dtype=object, index=batch.index))

    schema = prompts.withColumn("response", F.lit(None).cast("string")).withColumn("error_type", F.lit(None).cast("string")).schema
    out = prompts.mapInPandas(run, schema)
    return out.withColumn("response", strip_reasoning(F.col("response")))


def _told(messages: DataFrame, generator: Generator, task: str, out: str, clean) -> DataFrame:
    parts = [F.lit(task), F.concat(F.lit("Conversation:\n"), F.coalesce("history", F.lit(""))), F.concat(F.lit("New message: "), F.col("query"))]
    said = generate(messages.withColumn("_p", F.concat_ws("\n\n", *parts)), generator, "_p")
    return said.withColumn(out, clean(F.col("response"))).drop("_p", "response", "error_type")


def classify(messages: DataFrame, generator: Generator) -> DataFrame:
    """``messages`` (query, history, is_followup) with ``label``; a failure or anything unclear is FOLLOWUP. Only what fires is asked."""
    fires = F.col("is_followup")
    told = _told(messages.where(fires), generator, LABEL_TASK, "label", clean_label)
    return told.unionByName(messages.where(~fires).withColumn("label", F.lit("FOLLOWUP")))


def rewrite(messages: DataFrame, generator: Generator) -> DataFrame:
    """``messages`` (query, history, mode) with ``rewritten``: follow-ups as questions that stand alone, as they are where that fails."""
    fires = F.col("mode") == "followup"
    told = _told(messages.where(fires), generator, REWRITE_TASK, "rewritten", lambda r: clean_rewrite(r, F.col("query")))
    return told.unionByName(messages.where(~fires).withColumn("rewritten", F.col("query")))


def translate(rows: DataFrame, generator: Generator, *, to_english: bool, text: str = "text", out: str = "translated") -> DataFrame:
    """``rows`` with ``out``: the text in the other language, codes and glossary terms kept by masks.

    Where the generator fails the text stays as it is and ``error_type`` says why.
    """
    asked = rows.withColumn("_m", masked_for_translation(F.col(text), to_english)).withColumn("_prompt", F.col("_m.prompt"))
    said = generate(asked, generator, "_prompt")
    back = unmasked_translation(F.col("response"), F.col("_m.codes"), F.col("_m.terms"))
    return said.withColumn(out, F.when(F.col("error_type").isNull(), back).otherwise(F.col(text))).drop("_m", "_prompt", "response")


def arabic_items(items: DataFrame, generator: Generator, done: DataFrame | None = None) -> DataFrame:
    """Evaluation items (id, question, ...) in Arabic: question, question_en and review 'machine', for nobody has read them yet.

    Items that ``done`` has, with a question_en, are taken from there and not translated again.
    """
    held = done.where("question_en is not null") if done is not None else None
    todo = items if held is None else items.join(held.select("id"), "id", "left_anti")
    made = translate(todo.withColumnRenamed("question", "question_en"), generator, to_english=False, text="question_en", out="question").drop("error_type")
    made = made.withColumn("review", F.lit("machine"))
    return made if held is None else held.join(items.select("id"), "id", "left_semi").unionByName(made, allowMissingColumns=True)


def answer(questions: DataFrame, hits: DataFrame, generator: Generator, whitelist: DataFrame, budget: int = 18_000) -> DataFrame:
    """Checked answers to (answer_id, question) from ranked hits (answer_id, rank, filename, section, label, text, n_chars)."""
    size = (F.col("n_chars") + F.char_length("filename") + 16).cast("long")
    kept = context_budget(hits.withColumnRenamed("answer_id", "question_id"), size, budget).withColumnRenamed("question_id", "answer_id")
    context = format_context(kept)
    prompts = questions.join(context, "answer_id").withColumn("prompt", build_prompt(F.col("question"), F.col("context"), F.contains("context", F.lit("different versions of this process"))))
    said = generate(prompts, generator).withColumn("answer", F.coalesce("response", F.lit("")))
    return validate(said, whitelist, kept.select("answer_id", "text"))


def ask(messages: DataFrame, find: Callable[[DataFrame], DataFrame], generator: Generator, whitelist: DataFrame, *, budget: int = 18_000, policy: str = "flag", repair: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Answers to messages (answer_id, question, history, previous_answer, previous_hits), each with what it came from.

    Arabic messages are translated first, so that gate, rewriting and retrieval see English. The gate
    decides which messages lean on the session; of these, continuations are answered again from
    ``previous_hits`` (array of struct(rank, filename, section, family, variant, text)), and follow-ups
    are rewritten. ``repair`` mends spelling of (query_id, query); ``find`` gives ranked hits (answer_id,
    rank, filename, section, family, variant, text) for (answer_id, query). Verdicts are against
    ``whitelist`` and the hits; only a withheld answer is translated back. ``recorded`` is what the session
    should keep: all that was said so far, if an answer went on.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    m = messages.withColumn("arabic", is_arabic(F.col("question")))
    english = translate(m.where("arabic"), generator, to_english=True, text="question", out="query").drop("error_type")
    m = materialize(english.unionByName(m.where("not arabic").withColumn("query", F.col("question"))), "messages")
    m = followup_gate(m.withColumn("has_history", text("history") != ""))
    m = classify(m, generator)
    goes_on = F.col("is_followup") & (F.col("label") == "CONTINUATION") & (F.size(F.coalesce("previous_hits", F.array().cast(m.schema["previous_hits"].dataType))) > 0)
    m = m.withColumn("mode", F.when(goes_on, "continuation").when(F.col("is_followup"), "followup").otherwise("new"))
    m = materialize(rewrite(m, generator), "resolved")
    searched = m.where("mode <> 'continuation'").select("answer_id", F.col("rewritten").alias("query"))
    if repair is not None:
        fixed = repair(searched.withColumnRenamed("answer_id", "query_id")).select(F.col("query_id").alias("answer_id"), F.col("repaired").alias("query"))
        searched = materialize(fixed, "repaired")
    columns = ["answer_id", "rank", "filename", "section", "family", "variant", "text"]
    replayed = m.where("mode = 'continuation'").select("answer_id", F.explode("previous_hits").alias("h")).select("answer_id", *[F.col(f"h.{c}").alias(c) for c in columns[1:]])
    size = (F.char_length("text") + F.char_length("filename") + 16).cast("long")
    fresh = context_budget(find(searched).select(*columns).withColumnRenamed("answer_id", "question_id"), size, budget).withColumnRenamed("question_id", "answer_id")
    hits = materialize(fresh.select(*columns).unionByName(replayed), "hits")
    several = variant_conflicts(hits).select("answer_id").distinct().withColumn("several", F.lit(True))
    context = format_context(hits.withColumn("label", F.lit(None).cast("string")))
    asked = m.join(searched.withColumnRenamed("query", "searched"), "answer_id", "left").join(context, "answer_id", "left").join(several, "answer_id", "left")
    said = F.coalesce("searched", "query")
    again = continuation_prompt(F.col("question"), text("context"), text("previous_answer"), F.col("several"))
    asked = asked.withColumn("query_used", said).withColumn("prompt", F.when(F.col("mode") == "continuation", again).otherwise(build_prompt(said, text("context"), F.col("several"), answer_in=F.col("arabic"))))
    out = generate(asked, generator).withColumn("answer", text("response"))
    keep = ["answer_id", "question", "arabic", "mode", "query_used", "reasons", "previous_answer", "answer", "error_type"]
    checked = materialize(validate(out.select(*keep), whitelist, hits.select("answer_id", "text"), policy=policy), "checked")
    back = F.col("arabic") & (F.col("verdict") == "blocked")
    arabic = translate(checked.where(back).drop("error_type"), generator, to_english=False, text="display_answer", out="display_answer").unionByName(checked.where(~back))
    both = F.trim(F.concat(text("previous_answer"), F.lit("\n\n"), F.col("answer")))
    return arabic.withColumn("arabic_digits", eastern_digits(F.col("answer"))).withColumn("recorded", F.when(F.col("mode") == "continuation", both).otherwise(F.col("answer")))


def hashing_encoder(dim: int = 64) -> Callable[[pd.Series], pd.Series]:
    """A deterministic stand-in for an embedding model: signed hashes of character trigrams, normalised.

    Where all signs of a text cancel out, as they can in short ones, trigrams count without them, so that no text is left
    without a direction. It says nothing about meaning; it stands in for a model where none is given.
    """

    known: dict[int, int] = {}

    def place(key: int) -> int:
        """Where a trigram counts, and from ``dim`` on where it counts against; it is hashed once while it is remembered."""
        at = known.get(key)
        if at is None:
            word = "".join(chr(key >> bits & 0x1FFFFF) for bits in (42, 21, 0))
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            at = known[key] = h % dim + (0 if h >> 63 else dim)
        return at

    def part(texts: list[str]) -> list[np.ndarray]:
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(t) for t in texts])
        row = np.repeat(np.arange(len(texts)), sizes)
        whole = np.flatnonzero(row[2:] == row[:-2])
        keys = pa.array(code[whole] << 42 | code[whole + 1] << 21 | code[whole + 2]).dictionary_encode()
        if len(known) > 200_000:
            known.clear()
        at = np.array([place(k) for k in keys.dictionary.to_pylist()], np.int64)[keys.indices.to_numpy()]
        counts = np.bincount(row[whole] * 2 * dim + at, minlength=len(texts) * 2 * dim).reshape(len(texts), 2, dim)
        v = (counts[:, 0] - counts[:, 1]).astype(np.float64)
        none = ~v.any(1)
        v[none] = counts[none].sum(1)
        return [x / (float((x * x).sum()) ** 0.5 or 1.0) for x in v]

    def encode(texts: pd.Series) -> pd.Series:
        out, held, size = [], [], 0
        for t in texts:
            held.append(f"  {t or ''} ".lower())
            size += len(held[-1])
            if size > PIECE:
                out += part(held)
                held, size = [], 0
        return pd.Series(out + part(held) if held else out, dtype=object)

    return encode
