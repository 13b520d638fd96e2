"""Tokens, statistics, lexical, dense and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import FAMILY_HINTS, embed_text, route_families, singular, tokenize, workflow_intent
from lodestone.operators import retrieval as R
from lodestone.operators.index import InvertedIndex
from lodestone.operators.search import Search
from lodestone.plans.scratch import folder
from lodestone.queries.registry import query
from lodestone.sources.tables import chunks, questions, table, vectors


def tok(text: str) -> str:
    """SQL for the tokens of a text."""
    return f"""list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda w:
      CASE WHEN length(w) > 3 AND w LIKE '%s' AND NOT (w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is') THEN left(w, length(w) - 1) ELSE w END)"""


ASKED = """asked AS (SELECT item_id AS question_id, text AS query, text AS passage FROM benchmark)"""
BM25 = f"""{ASKED},
t AS (SELECT doc_id AS id, {tok('text')} AS t FROM documents),
dl AS (SELECT id, len(t) AS dl FROM t),
av AS (SELECT avg(dl) AS avgdl, count(*) AS n FROM dl),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM t) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, av),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT question_id, term, count(*) AS times FROM (SELECT question_id, unnest({tok('query')}) AS term FROM asked) GROUP BY question_id, term),
bm AS (
  SELECT question_id, tf.id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * times), 6) AS bm25
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.id = tf.id, av GROUP BY question_id, tf.id)"""
#: Every question with every document; what has no vector has dense scores of 0.
PAIRS = f"""{BM25},
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ch AS (
  SELECT a.question_id, d.doc_id AS id, d.source AS family, d.doc_id % 8 = 0 AS is_workflow, a.query,
         coalesce(round(list_inner_product(c.v, q.v), 6), 0.0) AS dense, coalesce(bm25, 0) AS bm25
  FROM asked a CROSS JOIN documents d LEFT JOIN v q ON q.id = a.question_id LEFT JOIN v c ON c.id = d.doc_id
  LEFT JOIN bm ON bm.question_id = a.question_id AND bm.id = d.doc_id)"""


def span(c: str) -> str:
    low, high = f"min({c}) OVER (PARTITION BY question_id)", f"max({c}) OVER (PARTITION BY question_id)"
    return f"(({c} - {low}) / CASE WHEN {high} = {low} THEN 1.0 ELSE {high} - {low} END)"


def boosted(name: str, before: str, member: str, share: float) -> str:
    """SQL for ``before`` with members raised by a share of the range."""
    return f"""{name}_s AS (SELECT *, max(fused) OVER w - min(fused) OVER w AS sp FROM {before} WINDOW w AS (PARTITION BY question_id)),
{name} AS (SELECT * EXCLUDE (sp) REPLACE (round(fused + CASE WHEN {member} THEN {share} * CASE WHEN sp = 0 THEN 1.0 ELSE sp END ELSE 0.0 END, 6) AS fused) FROM {name}_s)"""


WEIGHTED = f"""{PAIRS},
fu AS (SELECT *, round((1 - 0.4) * {span('bm25')} + 0.4 * {span('dense')}, 6) AS fused FROM ch)"""
TOP = "row_number() OVER (PARTITION BY question_id ORDER BY fused DESC, bm25 DESC, id)"
RANKED = f"""{WEIGHTED},
r AS (SELECT *, CAST({TOP} AS INTEGER) AS rank FROM fu)"""
OWN_FAMILY = "coalesce(family = 'src' || (question_id % 20), false)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions with their vectors and the family each is boosted by."""
    q = F.col("question_id")
    vec = vectors(spark, sf_dir).withColumnRenamed("id", "question_id")
    return questions(spark, sf_dir).join(vec, "question_id", "left").withColumn("boost_family", F.concat(F.lit("src"), (q % 20).cast("string")))


def search(spark: SparkSession, sf_dir: str, asked_by: DataFrame | None = None, **kw) -> Search:
    c = chunks(spark, sf_dir).select("id", "family", "is_workflow", "text")
    return Search(c, asked(spark, sf_dir) if asked_by is None else asked_by, vectors(spark, sf_dir), **kw)


def ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return search(spark, sf_dir).top("weighted", k)


@query(f"SELECT doc_id, array_to_string({tok('text')}, ' ') AS tokens, len({tok('text')}) AS n_tokens FROM documents")
def tokenize_docs(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n_tokens"))


@query(f"SELECT term, count(*) AS freq FROM (SELECT unnest({tok('text')}) AS term FROM documents) GROUP BY term")
def vocab_counts(spark, sf_dir):
    return R.vocabulary(table(spark, sf_dir, "documents"))


@query(f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf_table(spark, sf_dir):
    none = questions(spark, sf_dir).limit(0)
    return Search(chunks(spark, sf_dir).select("id", "text"), none).idf().select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, id) AS INTEGER) AS rank FROM bm) SELECT question_id, rank, id, bm25 FROM r WHERE rank <= 3")
def bm25_topk(spark, sf_dir):
    found = Search(chunks(spark, sf_dir).select("id", "text"), questions(spark, sf_dir)).top("bm25", 3, only_shared=True)
    return found.select("question_id", "rank", "id", "bm25")


#: What is left of the documents after the changes of :func:`kept_index`.
LEFT = BM25.replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 7)")
assert LEFT != BM25


def kept_index(spark, sf_dir):
    """An index in three changes: two thirds of the documents, some with a text that is not theirs; the others, with these anew; some deleted."""
    index, docs = InvertedIndex(spark, folder(spark, "index")), chunks(spark, sf_dir).select("id", "text")
    wrong = F.when(F.col("id") % 6 == 1, F.lit("a text that will be replaced")).otherwise(F.col("text"))
    index.add(docs.where("id % 3 <> 0").withColumn("text", wrong))
    index.add(docs.where("id % 3 = 0 or id % 6 = 1"))
    index.remove(docs.where("id % 10 = 7").select("id"))
    return index


@query(f"WITH {LEFT}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, id) AS INTEGER) AS rank FROM bm) SELECT question_id, rank, id, bm25 FROM r WHERE rank <= 3")
def bm25_index_topk(spark, sf_dir):
    return kept_index(spark, sf_dir).top(questions(spark, sf_dir), 3).select("question_id", "rank", "id", "bm25")


@query(f"WITH {LEFT} SELECT term, df FROM df")
def index_terms(spark, sf_dir):
    index = kept_index(spark, sf_dir)
    index.compact()
    return index.frequencies()


@query(f"WITH {PAIRS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY dense DESC, id) AS INTEGER) AS rank FROM ch) SELECT question_id, rank, id, dense FROM r WHERE rank <= 5")
def dense_topk(spark, sf_dir):
    return search(spark, sf_dir, lexical=False).top("dense", 5).select("question_id", "rank", "id", "dense")


@query(f"WITH {RANKED} SELECT question_id, rank, id, fused FROM r WHERE rank <= 6")
def hybrid_weighted(spark, sf_dir):
    return ranked(spark, sf_dir, 6).select("question_id", "rank", "id", "fused")


@query(f"""WITH {PAIRS},
k AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, id) AS a,
         row_number() OVER (PARTITION BY question_id ORDER BY dense DESC, id) AS b FROM ch),
fu AS (SELECT *, round(1 / (60 + a) + 1 / (60 + b), 6) AS fused FROM k),
r AS (SELECT *, CAST({TOP} AS INTEGER) AS rank FROM fu)
SELECT question_id, rank, id, fused FROM r WHERE rank <= 6""")
def hybrid_rrf(spark, sf_dir):
    return search(spark, sf_dir).rrf(6).select("question_id", "rank", "id", "fused")


_ROUTED = """rt AS (
  SELECT item_id AS question_id, CASE WHEN item_id % 3 = 0 THEN ['src' || (item_id % 20)] WHEN item_id % 3 = 1 THEN ['none'] ELSE [] END AS routes FROM benchmark)"""


@query(f"""WITH {PAIRS}, {_ROUTED},
kn AS (SELECT list(DISTINCT source) AS known FROM documents),
c AS (SELECT ch.*, list_intersect(routes, known) AS named FROM ch JOIN rt USING (question_id), kn),
o AS (SELECT * FROM c WHERE len(named) = 0 OR family IS NULL OR list_contains(named, family)),
f AS (SELECT *, round((1 - 0.4) * {span('bm25')} + 0.4 * {span('dense')}, 6) AS fused FROM o),
r AS (SELECT *, CAST({TOP} AS INTEGER) AS rank FROM f)
SELECT question_id, rank, id, fused FROM r WHERE rank <= 6""")
def route_filter(spark, sf_dir):
    """Routing takes candidates away before scores are scaled; statistics stay those of the whole corpus."""
    q = F.col("question_id")
    routes = F.when(q % 3 == 0, F.array(F.concat(F.lit("src"), (q % 20).cast("string")))).when(q % 3 == 1, F.array(F.lit("none"))).otherwise(F.array().cast("array<string>"))
    found = search(spark, sf_dir, asked(spark, sf_dir).withColumn("routes", routes)).top("weighted", 6, routed=True)
    return found.select("question_id", "rank", "id", "fused")


@query(f"""WITH {WEIGHTED}, {boosted('b', 'fu', OWN_FAMILY, 0.15)},
r AS (SELECT *, CAST({TOP} AS INTEGER) AS rank FROM b)
SELECT question_id, rank, id, fused FROM r WHERE rank <= 6""")
def soft_boost(spark, sf_dir):
    return search(spark, sf_dir).top("weighted", 6, boosts=[("family", 0.15)]).select("question_id", "rank", "id", "fused")


@query(f"""WITH {WEIGHTED}, {boosted('b', 'fu', 'is_workflow AND question_id % 2 = 0', 0.06)},
r AS (SELECT *, CAST({TOP} AS INTEGER) AS rank FROM b)
SELECT question_id, rank, id, fused FROM r WHERE rank <= 6""")
def workflow_boost(spark, sf_dir):
    q = asked(spark, sf_dir).withColumn("intent", F.col("question_id") % 2 == 0)
    return search(spark, sf_dir, q).top("weighted", 6, boosts=[("workflow", 0.06)]).select("question_id", "rank", "id", "fused")


@query(f"""WITH {RANKED},
k AS (SELECT * FROM r WHERE rank <= 6),
b AS (SELECT *, first_value(fused) OVER (PARTITION BY question_id ORDER BY rank) * 0.55 AS bar FROM k),
n AS (SELECT *, count(*) FILTER (fused >= bar) OVER (PARTITION BY question_id) AS n FROM b)
SELECT question_id, rank, id, fused FROM n WHERE CASE WHEN n >= 3 THEN fused >= bar ELSE rank <= 3 END""")
def relevance_cutoff(spark, sf_dir):
    return R.cutoff(ranked(spark, sf_dir, 6)).select("question_id", "rank", "id", "fused")


@query(f"""WITH {RANKED},
k AS (SELECT r.*, length(d.text) + length('doc_' || r.id) + 16 AS size FROM r JOIN documents d ON d.doc_id = r.id WHERE rank <= 6),
u AS (SELECT *, CAST(sum(size) OVER (PARTITION BY question_id ORDER BY rank) AS BIGINT) AS used FROM k)
SELECT question_id, rank, id, used FROM u WHERE used <= 18000 OR rank = 1""")
def context_budget(spark, sf_dir):
    c = chunks(spark, sf_dir).select("id", (F.char_length("text") + F.char_length("filename") + 16).cast("long").alias("size"))
    return R.context_budget(ranked(spark, sf_dir, 6).join(c, "id"), F.col("size"), 18_000).select("question_id", "rank", "id", "used")


def seats_sql(scored: str, intent: str, k: int = 6, floor: int = 2, rel: float = 0.55) -> str:
    """SQL for the rows of ``scored`` that have seats, as ``st`` with a new rank."""
    third = max(1, k // 3)
    return f"""so AS (
  SELECT *, {intent} AS wants, row_number() OVER (PARTITION BY question_id ORDER BY fused DESC, bm25 DESC, id) AS a,
         row_number() OVER (PARTITION BY question_id, is_workflow ORDER BY fused DESC, bm25 DESC, id) AS o, max(fused) OVER (PARTITION BY question_id) AS best FROM {scored}),
se AS (
  SELECT question_id, count(*) FILTER (is_workflow AND a <= {k}) AS w, count(*) FILTER (NOT is_workflow AND a <= {k}) AS p,
         count(*) FILTER (is_workflow AND (best <= 0 OR fused >= best * {rel})) AS wf, count(*) FILTER (NOT is_workflow AND (best <= 0 OR fused >= best * {rel})) AS pf FROM so GROUP BY question_id),
s1 AS (SELECT *, greatest(least({min(floor, third)}, wf) - w, 0) AS gw FROM se),
s2 AS (SELECT *, w + gw AS w1, greatest(p - gw, 0) AS p1 FROM s1),
s3 AS (SELECT *, greatest(least({third}, pf) - p1, 0) AS gp FROM s2),
st AS (
  SELECT so.* REPLACE (row_number() OVER (PARTITION BY question_id ORDER BY a) AS a) FROM so JOIN s3 USING (question_id)
  WHERE CASE WHEN NOT wants THEN a <= {k} WHEN is_workflow THEN o <= greatest(w1 - gp, 0) ELSE o <= p1 + gp END)"""


@query(f"WITH {WEIGHTED}, {seats_sql('fu', 'question_id % 2 = 0')} SELECT question_id, CAST(a AS INTEGER) AS rank, id, fused, is_workflow FROM st")
def mix_floor(spark, sf_dir):
    q = asked(spark, sf_dir).withColumn("intent", F.col("question_id") % 2 == 0)
    rows = search(spark, sf_dir, q).top("weighted", 6, sides=True)
    return R.mix_floor(rows.drop("rank"), 6).select("question_id", "rank", "id", "fused", "is_workflow")


WORKFLOW_SQL = "regexp_matches(lower(query), 'workflow|work flow|flow chart|flowchart|diagram|approval chain|approval cycle|approval flow|approval route|who approves|who signs|who authorises|who authorizes|sign off|signs off|signature matrix|signatory|next step|what happens after|what happens next|goes to|sequence|order of approval|routed|routing|escalate|escalation|sent back|rejected|cycle|steps in')"
_INTENT = f"({WORKFLOW_SQL} OR question_id % 4 = 0)"
HYBRID = f"""{WEIGHTED}, {boosted('b1', 'fu', OWN_FAMILY, 0.15)}, {boosted('b2', 'b1', f'is_workflow AND {_INTENT}', 0.06)}, {seats_sql('b2', _INTENT)},
cu AS (SELECT *, max(fused) OVER (PARTITION BY question_id) * 0.55 AS bar FROM st),
cn AS (SELECT *, count(*) FILTER (fused >= bar) OVER (PARTITION BY question_id) AS strong FROM cu),
hy AS (SELECT question_id, CAST(a AS INTEGER) AS rank, id, fused, is_workflow FROM cn WHERE CASE WHEN strong >= 3 THEN fused >= bar ELSE a <= 3 END)"""


def hybrid(spark, sf_dir):
    q = asked(spark, sf_dir).withColumn("intent", workflow_intent(F.col("query")) | (F.col("question_id") % 4 == 0))
    return R.hybrid_search(search(spark, sf_dir, q).top("weighted", 6, boosts=[("family", 0.15), ("workflow", 0.06)], sides=True).drop("rank"))


@query(f"WITH {HYBRID} SELECT * FROM hy")
def hybrid_search(spark, sf_dir):
    return hybrid(spark, sf_dir).select("question_id", "rank", "id", "fused", "is_workflow")


#: Questions are the beginnings of every hundredth document, and what its language adds; families are those of sources.
_BEGINNING = "array_to_string(list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda x: x <> '')[1:12], ' ')"
ASKED_WHOLE = f"""asked AS (SELECT doc_id AS question_id, {_BEGINNING} || CASE lang WHEN 'en' THEN ' who approves the tender handover' WHEN 'de' THEN ' see F-P-CN-02-01' WHEN 'fr' THEN ' vendor quotation, survey' ELSE '' END AS query FROM documents WHERE doc_id % 100 = 0)"""
FAMILY_SQL = "(['PSE', 'PQD', 'PCM', 'PTN', 'PVMO', 'PCN', NULL])[TRY_CAST(regexp_extract(d.source, '[0-9]+', 0) AS INTEGER) % 7 + 1]"
PAIRS_WHOLE = PAIRS.replace(ASKED, ASKED_WHOLE).replace("d.source AS family", f"{FAMILY_SQL} AS family")
assert ASKED not in PAIRS_WHOLE and "d.source AS family" not in PAIRS_WHOLE
_HINTED = "CASE WHEN contains(query, 'P-CN-02') THEN ['PCN'] ELSE list_filter(['PTN', 'PVMO', 'PCM', 'PSE', 'PQD', 'PCN'], lambda f: len(list_filter(CASE f " + " ".join(f"WHEN '{f}' THEN {list(w)!r}" for f, w in FAMILY_HINTS.items()) + " END, lambda w: contains(lower(query), w))) > 0) END"
WHOLE = f"""{PAIRS_WHOLE},
cw AS (SELECT ch.*, {_HINTED} AS hinted, CASE WHEN contains(query, 'P-CN-02') THEN ['PCN'] ELSE [] END AS routes, {WORKFLOW_SQL} AS intent FROM ch),
al AS (SELECT * FROM cw WHERE len(routes) = 0 OR family IS NULL OR list_contains(routes, family) OR NOT EXISTS (SELECT 1 FROM cw x WHERE list_contains(cw.routes, x.family)))"""


def _whole_sql(last: str) -> str:
    return f"""{seats_sql(last, 'intent')},
cu AS (SELECT *, max(fused) OVER (PARTITION BY question_id) * 0.55 AS bar FROM st),
cn AS (SELECT *, count(*) FILTER (fused >= bar) OVER (PARTITION BY question_id) AS strong FROM cu)
SELECT question_id, md5(query) AS repaired, CAST(a AS INTEGER) AS rank, id, fused, is_workflow FROM cn WHERE CASE WHEN strong >= 3 THEN fused >= bar ELSE a <= 3 END"""


def whole(spark, sf_dir, **kw):
    number = F.expr("try_cast(nullif(regexp_extract(family, '[0-9]+', 0), '') as int)") % 7
    family = F.get(F.array(*[F.lit(f) for f in ("PSE", "PQD", "PCM", "PTN", "PVMO", "PCN")]), number)
    c = chunks(spark, sf_dir).select("id", "text", family.alias("family"), "is_workflow")
    words = F.slice(F.filter(F.split("text", "[^A-Za-z]+"), lambda x: x != ""), 1, 12)
    added = F.when(F.col("lang") == "en", " who approves the tender handover").when(F.col("lang") == "de", " see F-P-CN-02-01").when(F.col("lang") == "fr", " vendor quotation, survey").otherwise("")
    q = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("question_id"), F.concat(F.array_join(words, " "), added).alias("query"))
    q = q.join(vectors(spark, sf_dir).withColumnRenamed("id", "question_id"), "question_id", "left")
    return R.ask_index(c, q, vectors(spark, sf_dir), **kw).select("question_id", F.md5("repaired").alias("repaired"), "rank", "id", "fused", "is_workflow")


@query(f"""WITH {WHOLE}, fu AS (SELECT *, round((1 - 0.4) * {span('bm25')} + 0.4 * {span('dense')}, 6) AS fused FROM al),
{boosted('b1', 'fu', 'coalesce(list_contains(hinted, family), false)', 0.15)}, {boosted('b2', 'b1', 'is_workflow AND intent', 0.06)}, {_whole_sql('b2')}""")
def whole_search(spark, sf_dir):
    """Repair, routing, hinted families, intent, fusion, boosts, seats and cutoff, all from the question's words."""
    return whole(spark, sf_dir)


@query(f"""WITH {WHOLE}, kk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, id) AS ra, row_number() OVER (PARTITION BY question_id ORDER BY dense DESC, id) AS rb FROM al),
fu AS (SELECT * EXCLUDE (ra, rb), round(1 / (60 + ra) + 1 / (60 + rb), 6) AS fused FROM kk), {_whole_sql('fu')}""")
def whole_search_rrf(spark, sf_dir):
    return whole(spark, sf_dir, fusion="rrf")


@query(f"""WITH {PAIRS},
m AS (SELECT id, CAST(sum(CAST(round(dense * 1e6) AS BIGINT)) AS BIGINT) AS micro FROM ch GROUP BY id),
a AS (SELECT count(*)::DOUBLE AS n, sum(micro) / 1e6 AS s, sum(CAST(micro AS HUGEINT) * micro) AS ss, (SELECT count(*) FROM asked)::DOUBLE AS q FROM m)
SELECT id, floor((2 * micro + q) / (2 * q)) / 1e6 AS mean, CAST(rank() OVER (ORDER BY micro DESC) AS INTEGER) AS rank,
       round((micro / 1e6 - s / n) / sqrt(CAST(ss AS DOUBLE) / 1e12 / n - s / n * (s / n)), 4) AS z FROM m, a""")
def hubness_zscore(spark, sf_dir):
    """Mean score over all questions: sums are of whole millionths, so no order of tasks changes them."""
    q = questions(spark, sf_dir).count()
    sums = search(spark, sf_dir, lexical=False).dense_sums()
    micro = F.col("micro").cast("decimal(38,0)")
    n, s, ss = F.col("n").cast("double"), F.col("s").cast("double") / 1e6, F.col("ss").cast("double") / 1e12
    all_ = sums.agg(F.count(F.lit(1)).alias("n"), F.sum("micro").alias("s"), F.sum((micro * micro).cast("decimal(38,0)")).alias("ss"))
    out = R.global_rank(sums.withColumn("score", F.col("micro") / 1e6 / q), "score").crossJoin(F.broadcast(all_))  # one row
    z = (F.col("micro") / 1e6 - s / n) / F.sqrt(ss / n - s / n * (s / n))
    return out.select("id", (F.floor((2 * F.col("micro") + q) / F.lit(2.0 * q)) / 1e6).alias("mean"), "rank", F.round(z, 4).alias("z"))


@query("""SELECT doc_id, source || ' | ' || lang || chr(10) || text AS embed_text, sha256(source || ' | ' || lang || chr(10) || text) AS fingerprint FROM documents""")
def embedding_input(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", embed_text(F.col("source"), F.col("lang"), F.col("text")).alias("embed_text"))
    return d.withColumn("fingerprint", F.sha2("embed_text", 256))


@query("""WITH s AS (SELECT conv_id, turn, 'compare P-CN-0' || (conv_id % 9) || ' with F-P-TN-02-0' || (turn % 7) || ' ' || text AS query FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(upper(query), '\\b(?:F-)?([PM]-[A-Z]{2,3})-\\d', 1), lambda x: replace(x, '-', '')))), ',') AS families,
       regexp_matches(lower(query), 'workflow|work flow|flow chart|flowchart|diagram|approval chain|approval cycle|approval flow|approval route|who approves|who signs|who authorises|who authorizes|sign off|signs off|signature matrix|signatory|next step|what happens after|what happens next|goes to|sequence|order of approval|routed|routing|escalate|escalation|sent back|rejected|cycle|steps in') AS intent
FROM s""")
def query_routing(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    q = F.concat(F.lit("compare P-CN-0"), (F.col("conv_id") % 9).cast("string"), F.lit(" with F-P-TN-02-0"), (F.col("turn") % 7).cast("string"), F.lit(" "), F.col("text"))
    return c.select("conv_id", "turn", F.array_join(route_families(q), ",").alias("families"), workflow_intent(q).alias("intent"))


@query("""SELECT source, count(*) AS n, sum(CASE WHEN length(w) > 3 AND w LIKE '%s' AND NOT (w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is') THEN 1 ELSE 0 END)::BIGINT AS plurals
FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY source""")
def plural_counts(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    return w.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(singular(F.col("w")) != F.col("w")).alias("plurals"))
