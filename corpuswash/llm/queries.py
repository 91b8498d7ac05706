"""The registered queries of the training-data operators: thin calls over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, fingerprint, jaccard, lang_id, mixing, pii, shards, toxicity, url_filter
from .common import materialize, remainder, table

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 3) == 1
    model = lang_id.learn(docs.filter(~held_out))
    found = lang_id.identify(docs.drop("lang"), model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_all(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_all(docs, pii.learn(docs))
    base = F.filter("spans", lambda s: s["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_items(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat_format.digests(chat_format.format_records(chat_format.as_records(rows.unionByName(extra))))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 4) == 2
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """The model of op7 and of the pipeline: learned from labelled documents that are not held out."""
    return toxicity.learn(docs, labels.filter(remainder("doc_id", 4) != 2))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    checksum = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", size.alias("size"), checksum.alias("text_crc32"))
    out = shards.hilbert_shards(materialize(docs, "op8-rows"), ["lang", "source", "size"], ["text_crc32", "doc_id"], 24)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    return mixing.mix(materialize(docs, "op9-rows")).select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_fingerprint": op2_fingerprint,
    "op3_pii": op3_pii,
    "op4_decontaminate": op4_decontaminate,
    "op5_chat_format": op5_chat_format,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op8_hilbert_shards": op8_hilbert_shards,
    "op9_mix_sources": op9_mix_sources,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

ORACLES = {
    "op5_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))
    + length(role) + length(regexp_replace(role, '[^\\#<:\n]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op6_url_filter": r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS rid,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT rid, max_by(h || r.p, length(h || r.p)) AS rule, max_by(verdict, length(h || r.p)) AS verdict
  FROM p JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (rid)""",
    "op9_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][i % 3 + 1] AS w, source_size * 3 AS cap FROM s),
f AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER z, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER z, 0) AS DOUBLE) AS level
  FROM w WINDOW z AS (ORDER BY CAST(cap AS DOUBLE) / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE)
    ELSE w * (SELECT arg_min(level, (ratio, i)) FROM f WHERE ratio > level) END AS target FROM f),
q AS (SELECT *, floor(target / 16 + 0.5) AS q0, floor((SELECT sum(source_size) FROM s) / 16 + 0.5) - sum(floor(target / 16 + 0.5)) OVER () AS miss FROM t),
k AS (SELECT i, miss, target / 16 AS aim, CASE WHEN miss > 0 THEN q0 + j ELSE q0 - 1 - j END AS seat
  FROM q, (SELECT unnest(range(CAST((SELECT max(abs(miss)) FROM q) AS BIGINT) + 1)) AS j) WHERE miss <> 0),
r AS (SELECT i, miss, row_number() OVER (ORDER BY CASE WHEN miss > 0 THEN -aim / (2 * seat + 1) ELSE aim / (2 * seat + 1) END, i * sign(miss)) AS n FROM k WHERE seat >= 0),
m AS (SELECT i, sum(sign(miss)) AS moved FROM r WHERE n <= abs(miss) GROUP BY i),
g AS (SELECT source, i, source_size, target, CAST(q0 + coalesce(moved, 0) AS BIGINT) AS quota FROM q LEFT JOIN m USING (i)),
z AS (SELECT least(16, CASE WHEN max(c) // 128 = 0 THEN 0 ELSE length(bin(max(c) // 128)) END) AS bits FROM (SELECT count(*) AS c FROM d GROUP BY source)),
e AS (SELECT d.*, g.i, g.source_size, g.target, g.quota, CAST('0x' || substr(o, 1, 4) AS INTEGER) >> CAST(16 - bits AS INTEGER) AS bucket
  FROM z, d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
b AS (SELECT i, bucket, any_value(quota) AS total, CAST(sum(size) AS BIGINT) AS line,
    CASE WHEN any_value(source_size) > 0 THEN CAST(any_value(quota) AS DOUBLE) * CAST(sum(size) AS BIGINT) / any_value(source_size) ELSE 0.0 END AS aim FROM e GROUP BY i, bucket),
bq AS (SELECT *, floor(aim + 0.5) AS q0, total - sum(floor(aim + 0.5)) OVER (PARTITION BY i) AS miss FROM b),
bk AS (SELECT i, bucket, miss, aim, CASE WHEN miss > 0 THEN q0 + j ELSE q0 - 1 - j END AS seat
  FROM bq, (SELECT unnest(range(CAST((SELECT max(abs(miss)) FROM bq) AS BIGINT) + 1)) AS j) WHERE miss <> 0),
br AS (SELECT i, bucket, miss, row_number() OVER (PARTITION BY i ORDER BY CASE WHEN miss > 0 THEN -aim / (2 * seat + 1) ELSE aim / (2 * seat + 1) END, bucket * sign(miss)) AS n
  FROM bk WHERE seat >= 0),
bm AS (SELECT i, bucket, sum(sign(miss)) AS moved FROM br WHERE n <= abs(miss) GROUP BY i, bucket),
bt AS (SELECT i, bucket, line, (q0 + coalesce(moved, 0)) * 16 AS tokens FROM bq LEFT JOIN bm USING (i, bucket)),
bp AS (SELECT *, CASE WHEN line > 0 THEN least(floor(tokens / line), 3) ELSE 0 END AS passes FROM bt),
f3 AS (SELECT e.*, passes, CASE WHEN passes < 3 THEN tokens - passes * line ELSE 0 END AS rest,
    sum(size) OVER (PARTITION BY e.i, e.bucket ORDER BY o, size ROWS UNBOUNDED PRECEDING) AS upto FROM e JOIN bp USING (i, bucket))
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(least(rest, upto) - (upto - size), 0) AS BIGINT) AS taken FROM f3""",
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, (SELECT min(b) FROM r WHERE r.a = d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id""",
}
