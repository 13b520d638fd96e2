"""The queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.filter_audit import filter_audit
from lodestone.llm.hard_negatives import hard_negatives
from lodestone.llm.langid import identify
from lodestone.llm.line_dedup import line_dedup
from lodestone.llm.mixing import LEVELS, mix
from lodestone.llm.packing import pack
from lodestone.llm.secrets import scan_secrets
from lodestone.llm.sharding import shard
from lodestone.llm.simhash import near_dedup
from lodestone.llm.token_files import read_tokens, write_tokens
from lodestone.llm.token_counts import token_counts
from lodestone.llm.topk import top_k
from lodestone.plans.scratch import folder

#: Bytes of text in a shard of op7: small, so that small tables are split too.
SHARD_LIMIT = 1 << 20
#: What op8 and the pipeline mix to: targets of languages; domains and sources are alike.
MIX = {"weights": {"lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}, "budget_share": 0.8, "max_epochs": 4, "seed": 1}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"), limit=SHARD_LIMIT)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), **MIX)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0, k=5)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary lies on this machine; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "token-files")
    write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), path)
    return read_tokens(spark, path)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, is_anchor=F.col("vec_id") % 100 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_secret_scan": op5_secret_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_sharding": op7_sharding,
    "op8_source_mixing": op8_source_mixing,
    "op9_exact_topk": op9_exact_topk,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_token_files": op11_token_files,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}

def _mix_sql() -> str:
    """SQL of :func:`mix` at the parameters of MIX: a level after the other, then the seeded prefixes."""
    steps, above, parent = [], "b0", []
    for depth, level in enumerate(LEVELS):
        given = MIX["weights"].get(level, {})
        weight = f"CASE {level} " + " ".join(f"WHEN '{v}' THEN {w}" for v, w in given.items()) + " ELSE 1 END" if given else "1"
        keys = ", ".join([*parent, level])
        family = "PARTITION BY " + ", ".join(parent) if parent else ""
        join = f"JOIN {above} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above}"
        n = depth + 1
        steps.append(f"""n{n} AS (
  SELECT x.*, budget, CAST(cap AS DOUBLE) / weight AS ratio
  FROM (SELECT {keys}, CAST(sum(tokens) AS BIGINT) * {MIX['max_epochs']} AS cap, {weight} AS weight FROM leaves GROUP BY {keys}) x {join}),
o{n} AS (
  SELECT *, ratio <= (budget - coalesce(sum(cap) OVER ({family} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER ({family} ORDER BY ratio, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS isfull
  FROM n{n}),
w{n} AS (
  SELECT *, (budget - coalesce(sum(CASE WHEN isfull THEN cap END) OVER ({family}), 0))
    / sum(CASE WHEN NOT isfull THEN weight END) OVER ({family}) AS worth
  FROM o{n}),
b{n} AS (SELECT {keys}, CASE WHEN isfull THEN CAST(cap AS DOUBLE) ELSE worth * weight END AS budget FROM w{n})""")
        above, parent = f"b{n}", [*parent, level]
    keys = ", ".join(LEVELS)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         'domain' || CAST(ascii(right(coalesce(source, ''), 1)) % 4 AS VARCHAR) AS domain,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT {keys}, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY {keys}),
b0 AS (SELECT floor(CAST(sum(tokens) AS DOUBLE) * {MIX['budget_share']}) AS budget FROM leaves),
{", ".join(steps)},
g AS (
  SELECT {keys}, tokens, CAST(floor(coalesce(budget, 0) + 1e-6) AS BIGINT) AS budget FROM leaves LEFT JOIN b{len(LEVELS)} USING ({keys})),
e AS (SELECT {keys}, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epoch, tokens, budget FROM g),
k AS (
  SELECT d.*, epoch, budget - epoch * tokens AS rest, md5('{MIX['seed']}:' || CAST(epoch AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS key
  FROM d JOIN e USING ({keys})),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY key, doc_id) AS upto FROM k)
SELECT doc_id, {keys}, n_tokens, CAST(epoch + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS repeats FROM c"""


ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
    "op6_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id <> r.last_doc AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op9_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_sharding": f"""
WITH d AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
         CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes
  FROM documents),
l AS (SELECT d.*, CAST(t.depth AS INTEGER) AS depth, h >> (60 - t.depth) AS prefix FROM d, range(0, 61) t(depth)),
n AS (
  SELECT depth, prefix, CAST(sum(bytes) AS BIGINT) AS shard_bytes, count(*) AS n FROM l GROUP BY depth, prefix
  HAVING sum(bytes) <= {SHARD_LIMIT} OR min(h) = max(h)),
r AS (SELECT l.*, n.shard_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY l.depth) AS k FROM l JOIN n USING (depth, prefix))
SELECT doc_id, bytes, CASE depth WHEN 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth) END || ':0' AS shard, depth, shard_bytes
FROM r WHERE k = 1""",
    "op8_source_mixing": _mix_sql(),
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
         CAST(list_sum(list_transform(list_zip(a.w, c.w), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id
  WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT alike AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_filter_audit": r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS fails
  FROM t),
c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM f LEFT JOIN labels USING (doc_id) GROUP BY part, fails),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || d.letter || e.letter || g.letter AS filter_order, [a.bit, b.bit, d.bit, e.bit, g.bit] AS bits
  FROM x a, x b, x d, x e, x g WHERE a.bit | b.bit | d.bit | e.bit | g.bit = 31),
s AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0) AS gone
  FROM o, range(1, 6) r(i)),
r AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (fails & (gone | own) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (fails & gone = 0 AND fails & own <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (fails & gone <> 0 AND fails & own <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails & gone = 0 AND fails & own <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (fails & gone = 0 AND fails & own <> 0), 0) AS toxic_lost
  FROM (SELECT part, filter_order, step, own, CAST(gone AS BIGINT) AS gone, fails, n, good, toxic FROM s, c) GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r""",
}
