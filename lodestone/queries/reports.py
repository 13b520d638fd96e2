"""Reports on answers and diagrams: outcomes, sweeps, pairs, audits, cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import refused_with
from lodestone.operators import conversation as S
from lodestone.operators import diagrams as D
from lodestone.operators import evaluation as E
from lodestone.operators import graph as G
from lodestone.operators import retrieval as R
from lodestone.operators import validation as V
from lodestone.operators.search import Search
from lodestone.plans.scratch import folder, materialize
from lodestone.queries import graphs
from lodestone.queries.registry import query
from lodestone.queries.retrieval import ASKED, BM25, HYBRID, OWN_FAMILY, PAIRS, TOP, WEIGHTED, asked, boosted, search, seats_sql
from lodestone.queries.retrieval import span as span_sql
from lodestone.sources.files import write_json, write_json_array
from lodestone.sources.pages import fallback_rates as rates
from lodestone.sources.pages import page_text
from lodestone.sources.tables import chunks, questions, table

#: An item per document: a target that is prose, a figure or a code, another that is prose, and answers that hold some.
ITEMS_SQL = """it AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'ar' ELSE 'en' END AS lang, CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE 'doc_' || doc_id END AS doc, CASE WHEN doc_id % 7 = 0 THEN 'manual' END AS scoring,
         CASE doc_id % 3 WHEN 0 THEN 'the long form' WHEN 1 THEN 'Within ' || doc_id || ' Days' ELSE 'F-P-CM-01-' || doc_id % 90 END AS t1, 'the table' AS t2,
         text || CASE WHEN doc_id % 2 = 0 THEN ' THE TABLE says ' || CASE doc_id % 3 WHEN 0 THEN 'the long form' WHEN 1 THEN 'within ' || doc_id || ' days' ELSE 'f-p-cm-01-' || doc_id % 90 END WHEN doc_id % 3 = 0 THEN ' is not specified in these papers' ELSE '' END AS answer,
         CASE WHEN doc_id % 3 < 2 THEN 'doc_' || doc_id ELSE 'doc_x' END AS found, doc_id % 6 = 1 AS reused, doc_id % 11 AS seconds, CASE doc_id % 9 WHEN 0 THEN 'flagged' WHEN 1 THEN 'ungrounded' ELSE 'clean' END AS verdict, doc_id % 10 = 5 AS cites FROM documents),
sc AS (
  SELECT *, contains(lower(answer), lower(t1)) AS h1, contains(lower(answer), t2) AS h2,
         CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN contains(lower(answer), CAST(id AS VARCHAR)) ELSE contains(lower(answer), lower(t1)) END AS ar1,
         regexp_matches(lower(answer), 'not specified|not covered|does not|no information|isn''t in the context|not in the context|لا يوجد|غير محدد|لم يتم|غير مذكور') AS no FROM it),
oc AS (
  SELECT *, CASE WHEN doc = 'none' THEN CASE WHEN no THEN 'ok' ELSE 'INVENTED' END WHEN scoring = 'manual' THEN 'manual' WHEN lang = 'ar' THEN CASE WHEN ar1 IS NULL THEN 'n/a' WHEN ar1 THEN 'ok' ELSE 'WRONG' END WHEN h1 AND h2 THEN 'ok' ELSE 'WRONG' END AS outcome,
         CASE WHEN doc = 'none' THEN NULL WHEN coalesce(scoring, '') = 'manual' THEN found = doc WHEN reused THEN NULL ELSE found = doc END AS doc_hit,
         CASE WHEN doc = 'none' OR scoring = 'manual' THEN '' WHEN lang = 'ar' THEN CASE WHEN ar1 THEN '' ELSE coalesce(CASE WHEN ar1 IS NOT NULL THEN t1 END, '') END ELSE concat_ws(';', CASE WHEN NOT h1 THEN t1 END, CASE WHEN NOT h2 THEN t2 END) END AS missed FROM sc)"""


def _items(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    s, one = k.cast("string"), F.col("doc_id") % 3
    form = F.concat(F.lit("F-P-CM-01-"), (k % 90).cast("string"))
    first = F.when(one == 0, "the long form").when(one == 1, F.concat(F.lit("Within "), s, F.lit(" Days"))).otherwise(form)
    said = F.when(k % 2 == 0, F.concat(F.lit(" THE TABLE says "), F.when(one == 0, "the long form").otherwise(F.lower(first)))).when(one == 0, " is not specified in these papers").otherwise("")
    return d.select(
        k.alias("id"), F.when(k % 4 == 0, "ar").otherwise("en").alias("lang"), F.when(k % 5 == 0, "none").otherwise(F.concat(F.lit("doc_"), s)).alias("doc"), F.when(k % 7 == 0, "manual").alias("scoring"),
        F.array(first, F.lit("the table")).alias("targets"), F.concat("text", said).alias("answer"), F.array(F.when(one < 2, F.concat(F.lit("doc_"), s)).otherwise("doc_x")).alias("docs"), (k % 6 == 1).alias("reused"),
        (k % 11).alias("seconds"), F.when(k % 9 == 0, "flagged").when(k % 9 == 1, "ungrounded").otherwise("clean").alias("verdict"), F.when(k % 10 == 5, F.array(form)).otherwise(F.array().cast("array<string>")).alias("cited"),
    )


@query(f"WITH {ITEMS_SQL} SELECT id, outcome, doc_hit, missed FROM oc")
def app_outcomes(spark, sf_dir):
    return E.outcomes(_items(spark, sf_dir)).select("id", "outcome", "doc_hit", F.array_join("missed", ";").alias("missed"))


@query(f"""WITH {ITEMS_SQL}
SELECT lang, count(*) AS n, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome IN ('ok', 'WRONG', 'INVENTED')) AS scored, count(*) FILTER (doc_hit) AS doc_hits, count(doc_hit) AS docs, count(*) FILTER (outcome = 'manual') AS manual,
       count(*) FILTER (outcome = 'n/a') AS not_scoreable, round(count(*) FILTER (outcome = 'ok') / count(*) FILTER (outcome IN ('ok', 'WRONG', 'INVENTED')), 4) AS rate FROM oc GROUP BY lang""")
def outcome_rates(spark, sf_dir):
    return E.outcome_rates(E.outcomes(_items(spark, sf_dir)), "lang")


@query(f"""WITH {ITEMS_SQL}, a AS (SELECT *, doc = 'none' AS una, found = doc AS ret, h1 AND h2 AS right_, contains(lower(answer), 'not specified in these proce') AS ref FROM sc)
SELECT lang, count(*) AS n, count(*) FILTER (NOT una) AS answerable, count(*) FILTER (NOT una AND ret) AS retrieved, count(*) FILTER (NOT una AND right_) AS answered, count(*) FILTER (NOT una AND right_ AND NOT ret) AS lucky,
       count(*) FILTER (NOT una AND ret AND NOT right_) AS blocked, count(*) FILTER (una AND no2) AS refused, count(*) FILTER (una AND cites) AS leaked, count(*) FILTER (verdict <> 'clean') AS flagged, max(seconds) AS slowest, list_sort(list(seconds))[len(list(seconds)) // 2 + 1] AS median
FROM (SELECT *, contains(lower(answer), 'not specified in these paper') AS no2 FROM a) GROUP BY lang""")
def generation_report(spark, sf_dir):
    return E.generation_report(_items(spark, sf_dir), "Not specified in these papers.", "lang")


@query("SELECT doc_id AS id, contains(lower(text || CASE WHEN doc_id % 3 = 0 THEN ' NOT SPECIFIED in these process documents' ELSE ' not specified' END), 'not specified in these proce') AS refused FROM documents")
def strict_refusals(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    tail = F.when(F.col("doc_id") % 3 == 0, " NOT SPECIFIED in these process documents").otherwise(" not specified")
    return d.select(F.col("doc_id").alias("id"), refused_with(F.concat("text", tail), "Not specified in these process documents.").alias("refused"))


@query("""WITH a AS (SELECT item_id AS id, text AS question FROM benchmark WHERE item_id % 2 = 0), b AS (SELECT item_id AS id, reverse(text) AS question_other FROM benchmark WHERE item_id % 3 = 0)
SELECT id, CAST(row_number() OVER (ORDER BY -id) AS INTEGER) AS place, md5(question) AS question, md5(question_other) AS question_other FROM a JOIN b USING (id)""")
def paired_questions(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    out = E.paired(b.where("id % 2 = 0").withColumn("place", -F.col("id")), b.where("id % 3 = 0").withColumn("question", F.reverse("question")))
    return out.select("id", "place", F.md5("question").alias("question"), F.md5("question_other").alias("question_other"))


_GOLD = "gold AS (SELECT item_id AS question_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _gold(spark, sf_dir):
    return materialize(E.gold_pairs(questions(spark, sf_dir), chunks(spark, sf_dir)), "gold")


def _summed(rows, gold, questions_df, *by):
    """Hits and mean numbers of rows by setting; rows (*by, question_id, id, rank, is_workflow)."""
    n = questions_df.count()
    hit = rows.join(gold, ["question_id", "id"], "left_semi").select(*by, "question_id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("hits"))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("returned"), F.count_if("is_workflow").alias("workflow"))
    out = out.join(hit, list(by), "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.select(*by, "hits", "returned", F.round(F.col("returned") / n, 4).alias("mean_returned"), F.round(F.col("workflow") / n, 4).alias("mean_workflow"), F.round((F.col("returned") - F.col("workflow")) / n, 4).alias("mean_prose"))


def _summed_sql(rows: str, by: str) -> str:
    return f"""SELECT {by}, count(DISTINCT question_id) FILTER (gold) AS hits, count(*) AS returned, round(count(*) / (SELECT count(*) FROM asked), 4) AS mean_returned, round(count(*) FILTER (is_workflow) / (SELECT count(*) FROM asked), 4) AS mean_workflow,
round(count(*) FILTER (NOT is_workflow) / (SELECT count(*) FROM asked), 4) AS mean_prose FROM (SELECT r.*, g.id IS NOT NULL AS gold FROM {rows} r LEFT JOIN gold g ON g.question_id = r.question_id AND g.id = r.id) GROUP BY {by}"""


SWEEP_SQL = f"""{WEIGHTED}, {_GOLD},
kk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, id) AS a, row_number() OVER (PARTITION BY question_id ORDER BY dense DESC, id) AS b FROM ch),
al AS (SELECT 'weighted' AS fusion, question_id, id, is_workflow, bm25, fused FROM fu UNION ALL SELECT 'rrf', question_id, id, is_workflow, bm25, round(1 / (60 + a) + 1 / (60 + b), 6) FROM kk),
rk AS (SELECT *, row_number() OVER (PARTITION BY fusion, question_id ORDER BY fused DESC, bm25 DESC, id) AS rank FROM al),
tp AS (SELECT rk.*, k, rel, max(fused) OVER (PARTITION BY fusion, question_id, k, rel) * rel AS bar FROM rk, (VALUES (3), (6)) p(k), (VALUES (0.0::DOUBLE), (0.4), (0.55), (0.7)) q(rel) WHERE rank <= k),
ct AS (SELECT *, count(*) FILTER (fused >= bar) OVER (PARTITION BY fusion, question_id, k, rel) AS strong FROM tp),
kp AS (SELECT * FROM ct WHERE CASE WHEN strong >= 3 THEN fused >= bar ELSE rank <= 3 END)"""


@query(f"""WITH {SWEEP_SQL}
{_summed_sql('kp', 'fusion, k, rel')}""")
def sweep_fusion(spark, sf_dir):
    """Fusion by number of results by relative floor."""
    return E.sweep(_settings(spark, sf_dir), _gold(spark, sf_dir), questions(spark, sf_dir).count(), ["fusion", "k", "rel"], [["fusion", "k", "rel"]])


def _settings(spark, sf_dir):
    """One search per fusion; settings are rows, and all are cut from the same six best."""
    s = search(spark, sf_dir)
    six = lambda df, name: df.select(F.lit(name).alias("fusion"), "question_id", "id", "fused", "rank", "is_workflow")
    tops = materialize(six(s.top("weighted", 6), "weighted").unionByName(six(s.rrf(6), "rrf")), "tops")
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(rel).alias("rel")) for k in (3, 6) for rel in (0.0, 0.4, 0.55, 0.7)])
    rows = tops.withColumn("s", F.explode(grid)).select("*", "s.k", "s.rel").drop("s").where(F.col("rank") <= F.col("k"))
    return R.cutoff(rows, F.col("rel"), by=("fusion", "k", "rel", "question_id"))


@query(f"""WITH {SWEEP_SQL},
one AS (SELECT fusion, k, rel, count(DISTINCT question_id) FILTER (g.id IS NOT NULL) AS hits, count(*) AS n, count(*) FILTER (is_workflow) AS wf FROM kp LEFT JOIN gold g USING (question_id, id) GROUP BY fusion, k, rel)
SELECT fusion, k, rel, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS returned, round(sum(n) / (count(*) * (SELECT count(*) FROM asked)), 4) AS mean_returned, round(sum(wf) / (count(*) * (SELECT count(*) FROM asked)), 4) AS mean_workflow,
       round((sum(n) - sum(wf)) / (count(*) * (SELECT count(*) FROM asked)), 4) AS mean_prose FROM one GROUP BY GROUPING SETS ((fusion, k, rel), (fusion, k), (fusion), (k), (rel), ())""")
def sweep_margins(spark, sf_dir):
    """The sweep with its margins, in one aggregation over grouping sets."""
    sets = [["fusion", "k", "rel"], ["fusion", "k"], ["fusion"], ["k"], ["rel"], []]
    return E.sweep(_settings(spark, sf_dir), _gold(spark, sf_dir), questions(spark, sf_dir).count(), ["fusion", "k", "rel"], sets)


_BOOSTS, _FLOORS = (0.0, 0.06, 0.2), (0, 1, 3)


def _floor_sql(boost: float, floor: int) -> str:
    intent = "question_id % 2 = 0" if floor > 0 else "false"
    return f"SELECT {boost}::DOUBLE AS boost, {floor} AS floor, question_id, id, is_workflow FROM (WITH {boosted('bo', 'fu', 'is_workflow AND question_id % 2 = 0', boost)}, {seats_sql('bo', intent, floor=floor)} SELECT * FROM st)"


@query(f"""WITH {WEIGHTED}, {_GOLD}, al AS ({' UNION ALL '.join(_floor_sql(b, f) for b in _BOOSTS for f in _FLOORS)}) {_summed_sql('al', 'boost, floor')}""")
def sweep_boost_floor(spark, sf_dir):
    s = search(spark, sf_dir, asked(spark, sf_dir).withColumn("intent", F.col("question_id") % 2 == 0))
    out = None
    for boost in _BOOSTS:
        rows = materialize(s.top("weighted", 6, boosts=[("workflow", boost)], sides=True).drop("rank"), "tops")
        for floor in _FLOORS:
            one = R.mix_floor(rows, 6, floor).withColumn("boost", F.lit(boost)).withColumn("floor", F.lit(floor))
            out = one if out is None else out.unionByName(one)
    return _summed(out, _gold(spark, sf_dir), questions(spark, sf_dir), "boost", "floor")


_VARIED = r"""asked AS (SELECT item_id * 10 + v AS question_id, CASE v WHEN 0 THEN text ELSE regexp_replace(text, '[a-zA-Z]{7,}', ' ', 'g') END AS query, text AS passage FROM benchmark, (VALUES (0), (1)) x(v))"""


@query(f"""WITH {BM25.replace(ASKED, _VARIED)},
al AS (SELECT a.question_id, d.doc_id AS id, coalesce(bm25, 0) AS bm25 FROM asked a CROSS JOIN documents d LEFT JOIN bm ON bm.question_id = a.question_id AND bm.id = d.doc_id),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, id) AS INTEGER) AS bm25_rank FROM al),
sh AS (SELECT qt.question_id, count(*) FILTER (tf.term IS NOT NULL) AS n_shared, count(*) FILTER (tf.term IS NULL) AS n_missing FROM qt LEFT JOIN tf ON tf.id = qt.question_id // 10 AND tf.term = qt.term GROUP BY qt.question_id)
SELECT rk.question_id, rk.id, bm25_rank, n_shared, n_missing FROM rk JOIN sh USING (question_id) WHERE id = question_id // 10""")
def query_variants(spark, sf_dir):
    """How a question's own document ranks as its wording changes, and which of its terms that document has."""
    b = table(spark, sf_dir, "benchmark")
    v = b.select("item_id", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("query")), F.struct(F.lit(1).alias("v"), F.regexp_replace("text", "[a-zA-Z]{7,}", " ").alias("query")))).alias("x"))
    q = v.select((F.col("item_id") * 10 + F.col("x.v")).alias("question_id"), F.col("x.query").alias("query"))
    c = chunks(spark, sf_dir).select("id", "text")
    own = q.withColumn("id", F.floor(F.col("question_id") / 10).cast("long"))
    ranked = Search(c, q).ranks(own, ["bm25"])
    terms = E.term_overlap(own.join(c, "id")).select("question_id", F.size("shared").cast("long").alias("n_shared"), F.size("missing").cast("long").alias("n_missing"))
    return ranked.join(terms, "question_id")


@query(f"""WITH {graphs.GRAPH_SQL}, n2 AS (SELECT * FROM n WHERE id <> 7 OR graph % 2 = 0 UNION ALL SELECT 100000 + graph, id, label, kind, pos FROM n WHERE graph % 5 = 0)
SELECT 'dangling' AS fault, e.graph, e.src || '->' || e.dst AS where_, concat_ws(', ', CASE WHEN a.id IS NULL THEN e.src END, CASE WHEN b.id IS NULL THEN e.dst END) AS what FROM e LEFT JOIN n2 a ON a.graph = e.graph AND a.id = e.src LEFT JOIN n2 b ON b.graph = e.graph AND b.id = e.dst WHERE a.id IS NULL OR b.id IS NULL
UNION ALL SELECT DISTINCT 'no edges', graph, '', '' FROM n2 WHERE graph NOT IN (SELECT graph FROM e)""")
def graph_audit(spark, sf_dir):
    n, e = graphs.both(spark, sf_dir)
    more = n.where("graph % 5 = 0").withColumn("graph", F.col("graph") + 100_000)
    n = n.where("id <> 7 or graph % 2 = 0").unionByName(more)
    loose = D.dangling_edges(n, e).select(F.lit("dangling").alias("fault"), "graph", F.concat_ws("->", F.col("src").cast("string"), F.col("dst").cast("string")).alias("where_"), F.col("missing").alias("what"))
    return loose.unionByName(D.graphs_without_edges(n, e).select(F.lit("no edges").alias("fault"), "graph", F.lit("").alias("where_"), F.lit("").alias("what")))


@query(f"""WITH RECURSIVE {graphs.GRAPH_SQL}, s AS (SELECT graph, arg_min(id, pos) FILTER (NOT EXISTS (SELECT 1 FROM e WHERE e.graph = n.graph AND e.dst = n.id) AND EXISTS (SELECT 1 FROM e WHERE e.graph = n.graph AND e.src = n.id)) AS free, (SELECT arg_min(src, pos) FROM e WHERE e.graph = n.graph) AS first FROM n GROUP BY graph),
w(graph, id) AS (SELECT graph, coalesce(free, first) FROM s UNION SELECT w.graph, e.dst FROM w JOIN e ON e.graph = w.graph AND e.src = w.id)
SELECT e.graph, count(*) AS edges, count(w.id) AS reached, round(count(w.id) / count(*), 4) AS share FROM e LEFT JOIN w ON w.graph = e.graph AND w.id = e.src GROUP BY e.graph""")
def reached_edges(spark, sf_dir):
    return G.reached_edges(*graphs.both(spark, sf_dir))


@query(r"""WITH p AS (SELECT page_id % 7 AS doc, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text FROM pages),
q AS (SELECT doc, NOT (length(text) >= 20 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1) > 0.4) AS bad FROM p)
SELECT doc, count(*) AS pages, count(*) FILTER (NOT bad) AS native, count(*) FILTER (bad) AS flagged, round(count(*) FILTER (bad) / count(*), 4) AS rate FROM q GROUP BY ROLLUP (doc)""")
def fallback_rates(spark, sf_dir):
    return rates(page_text(table(spark, sf_dir, "pages")).withColumn("doc", F.col("page_id") % 7), "doc")


@query(f"""WITH {HYBRID}, c AS (SELECT h.question_id AS answer_id, 'PCN0' || (d.doc_id % 6) || '_form.pdf' AS filename, lang AS section, rank FROM hy h JOIN documents d ON d.doc_id = h.id),
g AS (SELECT answer_id, filename, min(rank) AS rank, list(section ORDER BY rank) AS s FROM c GROUP BY ALL)
SELECT answer_id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY rank, filename) AS INTEGER) AS place, filename, 'P-CN-0' || substr(filename, 5, 1) || ' form' AS shown, array_to_string(list_sort(list_distinct(s)), ',') AS sections FROM g""")
def source_cards(spark, sf_dir):
    from lodestone.queries.retrieval import hybrid

    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("PCN0"), (F.col("doc_id") % 6).cast("string"), F.lit("_form.pdf")).alias("filename"), F.col("lang").alias("section"))
    hits = hybrid(spark, sf_dir).join(c, "id").select(F.col("question_id").alias("answer_id"), "rank", "filename", "section")
    return V.source_cards(hits).withColumn("sections", F.array_join(F.array_sort("sections"), ","))


@query("""WITH c AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'Label: continuation' WHEN 1 THEN 'either FOLLOWUP or CONTINUATION' || chr(10) || 'FOLLOWUP' WHEN 2 THEN text || chr(10) || 'Continuation.' WHEN 3 THEN '' WHEN 4 THEN 'CONTINUATION CONTINUATION' ELSE text END AS said FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 6 IN (0, 2, 4) THEN 'CONTINUATION' ELSE 'FOLLOWUP' END AS label FROM c""")
def clean_labels(spark, sf_dir):
    t, text = F.col("turn") % 6, F.col("text")
    said = F.when(t == 0, "Label: continuation").when(t == 1, "either FOLLOWUP or CONTINUATION\nFOLLOWUP").when(t == 2, F.concat(text, F.lit("\nContinuation."))).when(t == 3, "").when(t == 4, "CONTINUATION CONTINUATION").otherwise(text)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.clean_label(said).alias("label"))


@query("""WITH t AS (SELECT c_nationkey AS page, c_custkey AS pos, CASE WHEN c_custkey % 2 = 0 THEN 'Over ' ELSE 'over  ' END || (c_custkey % 5) || ' K' AS condition, CASE WHEN c_custkey % 3 = 0 THEN 'COO' ELSE 'coo ' END AS approver FROM customer)
SELECT page, min(pos) AS pos, arg_min(condition, pos) AS condition, arg_min(approver, pos) AS approver FROM t GROUP BY page, trim(regexp_replace(lower(condition), '\\s+', ' ', 'g')), trim(lower(approver))""")
def merged_thresholds(spark, sf_dir):
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), k.alias("pos"), F.concat(F.when(k % 2 == 0, "Over ").otherwise("over  "), (k % 5).cast("string"), F.lit(" K")).alias("condition"), F.when(k % 3 == 0, "COO").otherwise("coo ").alias("approver"))
    return D.merge_thresholds(t)


@query("SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS text, (SELECT count(*) FROM region) AS regions FROM documents")
def json_sinks(spark, sf_dir):
    """Documents as JSON lines and back; regions as one array."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("text"))
    path = folder(spark, "json")
    write_json(d, f"{path}/lines")
    n = write_json_array(table(spark, sf_dir, "region"), f"{path}/regions.json")
    return spark.read.schema(d.schema).json(f"{path}/lines").withColumn("regions", F.lit(n).cast("long"))
