"""Scores, sessions, spelling, masking and resuming."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.masking import mask_codes, unmask_codes
from lodestone.functions.text import summarize
from lodestone.operators import conversation as S
from lodestone.operators import evaluation as E
from lodestone.operators import retrieval as R
from lodestone.operators.search import Search
from lodestone.operators.spelling import repair_queries
from lodestone.plans.scratch import folder, materialize
from lodestone.queries.registry import query
from lodestone.queries.retrieval import ASKED, BM25, RANKED, TOP, WEIGHTED, ranked, search
from lodestone.sources.files import answer_log as log_lines
from lodestone.sources.files import append_new
from lodestone.sources.tables import chunks, questions, table

GOLD_SQL = "gold AS (SELECT item_id AS question_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _gold(spark, sf_dir):
    return E.gold_pairs(questions(spark, sf_dir), chunks(spark, sf_dir))


def _bm25_hits(spark, sf_dir):
    top = Search(chunks(spark, sf_dir).select("id", "text"), questions(spark, sf_dir)).top("bm25", 5, only_shared=True)
    return E.hits(top, _gold(spark, sf_dir), [1, 3, 5])


_HIT_SQL = f"""{BM25}, {GOLD_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, id) AS rank FROM bm),
hb AS (SELECT g.question_id, min(rank) AS best FROM gold g LEFT JOIN rk USING (question_id, id) GROUP BY g.question_id),
ht AS (SELECT question_id, coalesce(best <= 1, false) AS hit_1, coalesce(best <= 3, false) AS hit_3, coalesce(best <= 5, false) AS hit_5 FROM hb)"""


@query(f"WITH {_HIT_SQL} SELECT * FROM ht")
def retrieval_eval(spark, sf_dir):
    return _bm25_hits(spark, sf_dir)


@query(f"WITH {_HIT_SQL} SELECT question_id % 3 AS type, count(*) AS n, count(*) FILTER (hit_1) AS hits_1, count(*) FILTER (hit_3) AS hits_3, count(*) FILTER (hit_5) AS hits_5 FROM ht GROUP BY type")
def eval_by_type(spark, sf_dir):
    return E.accuracy(_bm25_hits(spark, sf_dir).withColumn("type", F.col("question_id") % 3), [1, 3, 5], "type")


@query(f"WITH {_HIT_SQL} SELECT CASE WHEN hit_3 AND question_id % 5 < 4 THEN 'ok' WHEN NOT hit_3 AND question_id % 5 < 4 THEN 'lucky' WHEN hit_3 THEN 'wrong' ELSE 'blocked' END AS cell, count(*) AS n FROM ht GROUP BY cell")
def eval_confusion(spark, sf_dir):
    return E.confusion(_bm25_hits(spark, sf_dir), F.col("hit_3"), F.col("question_id") % 5 < 4)


@query(f"""WITH {RANKED}, k AS (SELECT * FROM r WHERE rank <= 6),
c AS (SELECT k.*, rel, first_value(fused) OVER (PARTITION BY question_id, rel ORDER BY rank) * rel AS bar FROM k, (VALUES (0.0), (0.55), (0.7)) p(rel)),
n AS (SELECT *, count(*) FILTER (fused >= bar) OVER (PARTITION BY question_id, rel) AS strong FROM c)
SELECT CAST(rel AS DOUBLE) AS rel, count(*) AS returned, count(DISTINCT question_id) AS questions, count(*) FILTER (is_workflow) AS workflow FROM n WHERE CASE WHEN strong >= 3 THEN fused >= bar ELSE rank <= 3 END GROUP BY rel""")
def sweep_grid(spark, sf_dir):
    top = materialize(ranked(spark, sf_dir, 6), "ranked")
    out = None
    for rel in (0.0, 0.55, 0.7):
        one = R.cutoff(top, rel).withColumn("rel", F.lit(rel))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("rel").agg(F.count(F.lit(1)).alias("returned"), F.countDistinct("question_id").alias("questions"), F.count_if("is_workflow").alias("workflow"))


@query(f"""WITH {WEIGHTED}, q AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, id) AS bm25_rank, row_number() OVER (PARTITION BY question_id ORDER BY dense DESC, id) AS dense_rank, {TOP} AS fused_rank FROM fu)
SELECT question_id, id, CAST(bm25_rank AS INTEGER) AS bm25_rank, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(fused_rank AS INTEGER) AS fused_rank FROM q WHERE id = question_id""")
def channel_ranks(spark, sf_dir):
    own = questions(spark, sf_dir).select("question_id", F.col("question_id").alias("id"))
    out = search(spark, sf_dir).ranks(own, ["bm25", "dense", "weighted"])
    return out.withColumnRenamed("weighted_rank", "fused_rank")


@query("""WITH t AS (SELECT item_id, 'doc_' || (item_id * 3) AS doc, lower(text) AS target FROM benchmark), d AS (SELECT 'doc_' || doc_id AS doc, lower(text) AS body FROM documents)
SELECT item_id, t.doc, target, CASE WHEN body IS NULL THEN 'no such document' ELSE 'target not in document' END AS problem FROM t LEFT JOIN d USING (doc) WHERE body IS NULL OR NOT contains(body, target)""")
def verify_eval_items(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("doc_"), (F.col("item_id") * 3).cast("string")).alias("doc"), F.lower("text").alias("target"))
    return E.verify_items(t, chunks(spark, sf_dir))


@query("""SELECT event_type, count(*) AS n, max(value) AS slowest, list_sort(list(value))[len(list(value)) // 2 + 1] AS median FROM events GROUP BY event_type""")
def latency_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("slowest"), E.upper_median("value").alias("median"))


@query("""WITH g AS (SELECT DISTINCT user_id, event_type AS a FROM events WHERE event_id % 2 = 0), i AS (SELECT DISTINCT user_id, event_type AS a FROM events WHERE event_id % 3 = 0)
SELECT coalesce(g.user_id, i.user_id) AS user_id, count(g.a) AS gold, count(*) FILTER (g.a IS NOT NULL AND i.a IS NOT NULL) AS covered, count(*) FILTER (i.a IS NULL) AS missing, count(*) FILTER (g.a IS NULL) AS asserted
FROM g FULL JOIN i ON g.user_id = i.user_id AND g.a = i.a GROUP BY 1""")
def route_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("a"), "event_id")
    return E.coverage(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), ["user_id", "a"])


@query("WITH r AS (SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back FROM conversations) SELECT * FROM r WHERE back <= 4")
def session_last4(spark, sf_dir):
    return S.last_turns(table(spark, sf_dir, "conversations"), "conv_id").select("conv_id", "turn", "role", "back")


#: Turns of conversations, some with the openings of a follow-up before them or the words of one behind.
_Q = """m AS (
  SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN 'and for the ' || text WHEN 1 THEN 'Who approves the rest of ' || text WHEN 2 THEN 'Which form does that need? ' || text WHEN 3 THEN 'is there ' || text WHEN 4 THEN 'list ' || conv_id
    WHEN 5 THEN 'Does IT sign, or who else; you said it' WHEN 6 THEN 'What follows after this, ' || conv_id ELSE text END AS query, turn > 0 AS has_history FROM conversations)"""


def _messages(spark, sf_dir):
    t, k = F.col("turn"), F.col("conv_id").cast("string")
    before = lambda s, c: F.concat(F.lit(s), c)
    said = F.when(t % 8 == 0, before("and for the ", F.col("text"))).when(t % 8 == 1, before("Who approves the rest of ", F.col("text"))).when(t % 8 == 2, before("Which form does that need? ", F.col("text"))).when(t % 8 == 3, before("is there ", F.col("text")))
    said = said.when(t % 8 == 4, before("list ", k)).when(t % 8 == 5, F.lit("Does IT sign, or who else; you said it")).when(t % 8 == 6, before("What follows after this, ", k)).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("query"), (t > 0).alias("has_history"))


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _stem(w: str) -> str:
    return f"string_split({w}, '''')[1]"


#: Words with their neighbours, then one flag for each reason.
GATE_SQL = rf"""{_Q},
q AS (SELECT *, trim(regexp_replace(lower(coalesce(query, '')), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS q, list_transform(regexp_extract_all(coalesce(query, ''), '\b[A-Z]{{2,}}\b'), lambda x: lower(x)) AS caps FROM m),
w AS (SELECT *, regexp_extract_all(q, '[a-z0-9'']+') AS w FROM q),
p AS (SELECT conv_id, turn, caps, unnest(w) AS x, generate_subscripts(w, 1) AS i, w FROM w),
n AS (SELECT *, {_stem('x')} AS stem, contains(x, '''') AS short, coalesce({_stem('w[i + 1]')}, '') AS after, CASE WHEN i > 1 THEN {_stem('w[i - 1]')} ELSE '' END AS before FROM p WHERE i <= 6),
b AS (
  SELECT conv_id, turn, list_sort(list(DISTINCT stem)) AS back FROM n
  WHERE NOT list_contains(caps, stem) AND CASE
    WHEN stem = 'there' THEN NOT short AND NOT list_contains({_listed(S.EXISTENTIAL_FOLLOWERS)}, after)
    WHEN list_contains({_listed(S.DETERMINERS)}, stem) THEN short OR list_contains({_listed(S.AUX)}, after) OR list_contains({_listed(S.NEGATIONS)}, after) OR (list_contains({_listed(S.AUX)}, before) AND after <> '') OR list_contains({_listed(S.SEQUENCE_PREPOSITIONS)}, before)
    ELSE list_contains({_listed(S.ANAPHORA)}, stem) END GROUP BY conv_id, turn),
v AS (SELECT *, list_distinct(list_concat(w, list_transform(list_filter(w, lambda x: contains(x, '''')), lambda x: {_stem('x')}))) AS vocab, list_concat(w[1:6], list_transform(regexp_split_to_array(q, '[,;.]')[2:], lambda c: regexp_extract(c, '[a-z0-9'']+'))) AS heads FROM w),
g AS (
  SELECT v.*, coalesce(back, []) AS back, list_sort(list_filter(vocab, lambda x: list_contains({_listed(S.RESIDUAL)}, x))) AS rest, list_sort(list_filter(vocab, lambda x: list_contains({_listed(S.DISCOURSE)}, x))) AS talk,
         list_bool_or(list_transform({_listed(S.FRAGMENT_STARTS)}, lambda s: starts_with(q, s))) AS fragment, coalesce(list_bool_or(list_transform(heads, lambda x: list_contains({_listed(S.WH_WORDS + S.AUX)}, x))), false) AS opens
  FROM v LEFT JOIN b ON b.conv_id = v.conv_id AND b.turn = v.turn),
r AS (
  SELECT *, concat_ws('; ', CASE WHEN fragment THEN 'starts with a fragment opener' END, CASE WHEN len(back) > 0 THEN 'back-reference (' || array_to_string(back, ', ') || ')' END,
    CASE WHEN len(rest) > 0 THEN 'refers to a remainder (' || array_to_string(rest, ', ') || ')' END, CASE WHEN len(talk) > 0 THEN 'refers to the conversation (' || array_to_string(talk, ', ') || ')' END,
    CASE WHEN NOT opens THEN CASE WHEN list_contains({_listed(S.IMPERATIVES)}, w[1]) THEN 'imperative opener (' || w[1] || ')' ELSE 'does not open like a standalone question' END END,
    CASE WHEN len(w) <= 3 THEN 'very short (' || len(w) || ' words)' END) AS said FROM g)"""


@query(f"""WITH {GATE_SQL}
SELECT conv_id, turn, has_history AND q <> '' AND said <> '' AS is_followup, CASE WHEN NOT has_history THEN 'no history' WHEN q = '' THEN 'empty query' WHEN said = '' THEN 'opens like a standalone question, nothing to resolve against history' ELSE said END AS reasons FROM r""")
def followup_gate(spark, sf_dir):
    return S.followup_gate(_messages(spark, sf_dir)).select("conv_id", "turn", "is_followup", F.array_join("reasons", "; ").alias("reasons"))


@query("""WITH h AS (SELECT conv_id, turn, text, turn > 0 AS fires, CASE turn % 3 WHEN 0 THEN 'CONTINUATION' WHEN 1 THEN 'FOLLOWUP' END AS label FROM conversations)
SELECT conv_id, turn, CASE WHEN fires AND coalesce(label = 'CONTINUATION', false) THEN 'continuation' WHEN fires THEN 'followup' ELSE 'new' END AS mode FROM h""")
def session_modes(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("query"), (F.col("turn") > 0).alias("is_followup"))
    label = F.when(F.col("turn") % 3 == 0, "CONTINUATION").when(F.col("turn") % 3 == 1, "FOLLOWUP")
    return S.resolve(m, label, F.lit(None).cast("string"), F.lit(True)).select("conv_id", "turn", "mode")


@query("""SELECT conv_id, string_agg('Q: ' || role || chr(10) || 'A: ' || turn, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id""")
def session_history(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("query"), F.col("turn").cast("string").alias("answer_summary"))
    return S.format_history(t, "conv_id")


@query(r"""WITH l AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS x FROM conversations)
SELECT conv_id, turn, rtrim(left(coalesce(nullif(regexp_extract(x, '^(.*?[.!?]) ', 1), ''), x), 200)) AS summary FROM l""")
def answer_summaries(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", summarize(F.col("text")).alias("summary"))


@query("""WITH prev AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role FROM conversations) SELECT * FROM prev""")
def previous_turn(spark, sf_dir):
    return S.with_previous(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["turn", "role"], "conv_id").drop("role")


@query()
def spelling_repair(spark, sf_dir):
    asked = questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), F.regexp_replace("query", "([a-z]{4})([a-z])([a-z]{6})", "$1$2$2$3").alias("query"))
    out = repair_queries(asked, R.vocabulary(table(spark, sf_dir, "documents")))
    return out.select("query_id", "query", "repaired", F.size("repairs").alias("n_repairs"))


@query("SELECT conv_id, turn, text || ' P-CM-01 and F-P-TN-02-04' AS restored, 2 AS n_codes FROM conversations")
def mask_roundtrip(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" P-CM-01 and F-P-TN-02-04")).alias("text"))
    m = c.withColumn("m", mask_codes(F.col("text")))
    return m.select("conv_id", "turn", unmask_codes(F.col("m.masked"), F.col("m.found")).alias("restored"), F.size("m.found").alias("n_codes"))


@query("""SELECT 'first' AS run, count(*) FILTER (doc_id % 3 = 0) AS written, count(*) FILTER (doc_id % 3 = 0) AS held FROM documents
UNION ALL SELECT 'second', count(*) FILTER (doc_id % 3 <> 0), count(*) FROM documents UNION ALL SELECT 'third', 0, count(*) FROM documents""")
def resume_anti_join(spark, sf_dir):
    """A sink that stopped after a third of the documents goes on with the others, and then has nothing left to do."""
    d, path = table(spark, sf_dir, "documents").select("doc_id", "source"), folder(spark, "resumed")
    rows = []
    for run, part in (("first", d.where("doc_id % 3 = 0")), ("second", d), ("third", d)):
        rows.append((run, append_new(part, path), spark.read.parquet(path).select("doc_id").distinct().count()))
    return spark.createDataFrame(rows, "run string, written long, held long")


@query("""SELECT source, CAST(min(n_chars) AS BIGINT) AS least FROM documents GROUP BY source ORDER BY least, source LIMIT 10""")
def worst_sources(spark, sf_dir):
    return E.worst(table(spark, sf_dir, "documents"), "source", F.col("n_chars"), 10)


@query(f"WITH {ASKED} SELECT question_id % 4 AS k, count(*) AS n FROM asked GROUP BY k ORDER BY n DESC, k LIMIT 3")
def most_common(spark, sf_dir):
    return E.most_common(questions(spark, sf_dir).select((F.col("question_id") % 4).alias("k")), "k", 3)


@query("""SELECT 'user_id=' || user_id || ' event_type=' || event_type || ' event_id=' || event_id || ' answer_chars=' || length(props) AS value FROM events""")
def answer_log(spark, sf_dir):
    """Contents (question, answer) stay out of the log."""
    e = table(spark, sf_dir, "events")
    return log_lines(e.select("user_id", "event_type", F.col("props").alias("question"), "event_id", F.char_length("props").alias("answer_chars")))
