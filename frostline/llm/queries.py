"""Each operator as a query over its whole table, with its SQL where SQL can say it."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import (
    bpe, conversations, factorisation, html_extract, merkle, mixing, near_dup, pii, quality_rules, secret_scan, token_files, topk_bitsliced, url_lists,
)
from frostline.llm.common import table
from frostline.session import scratch_path

VOCABULARIES = os.environ.get("TOKENIZER_DIR")  # another folder with the same files


def vocabulary(name: str) -> str:
    return f"{VOCABULARIES}/{name}" if VOCABULARIES else public_tokenizers.path(name)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scratch_path(spark, "token-files")
    return token_files.documents_from_files(spark, docs, vocabulary("byte_bpe_50k.json"), out)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_rules.trusted_documents(table(spark, sf_dir, "labels"))
    return quality_rules.judge(table(spark, sf_dir, "documents"), trusted)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(pii.find_personal_data(docs, pii.train(docs)))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE
      WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3),
                                        lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM docs
), shingles AS (
  SELECT doc_id, hash(unnest(s)) AS h FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT a, b FROM both_ways
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other
), smallest AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
  least(s.doc_id, coalesce(m.other, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(m.other, s.doc_id)) AS kept
FROM sets s LEFT JOIN smallest m ON m.doc_id = s.doc_id
"""


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", url_lists.fetch_day(F.col("page_id")))
    judged = url_lists.evaluate(captures, url_lists.list_history(pages), keep=("page_id", "fetched"))
    return judged.withColumn("fetched", F.col("fetched").cast("string"))


OP6_SQL = r"""
WITH named AS (
  SELECT page_id, DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS day,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'),
                lambda s: s <> '') AS parts
  FROM pages
), keys AS (
  SELECT DISTINCT 'host' AS kind, host AS key FROM named WHERE host IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'domain', regexp_replace(host, '^[^.]+\.', '') FROM named
  WHERE len(string_split(regexp_replace(host, '^[^.]+\.', ''), '.')) >= 3
  UNION ALL
  SELECT DISTINCT 'prefix', unnest(list_transform(range(1, len(parts) + 1),
    lambda i: host || '/' || array_to_string(parts[1:i], '/'))) FROM named WHERE host IS NOT NULL
), drawn AS (
  SELECT *, CAST('0x' || substr(md5(key), 1, 7) AS BIGINT) AS d FROM keys
), rules(kind, every, within, later, action, verdict) AS (VALUES
  ('host', 3, 200, 0, 'add', 'block'), ('host', 6, 200, 40, 'remove', 'block'),
  ('host', 12, 200, 80, 'add', 'allow'), ('domain', 5, 150, 0, 'add', 'block'),
  ('domain', 10, 150, 60, 'remove', 'block'), ('prefix', 7, 250, 0, 'add', 'allow'),
  ('prefix', 14, 250, 30, 'add', 'block')
), events AS (
  SELECT d.kind, d.key, DATE '2024-01-01' + CAST(d.d % r.within + r.later AS INTEGER) AS day, r.action, r.verdict
  FROM drawn d JOIN rules r ON d.kind = r.kind AND d.d % r.every = 0
), matches AS (
  SELECT n.page_id, n.day AS fetched, e.kind, e.key, e.day, e.action, e.verdict,
    CASE e.kind WHEN 'domain' THEN len(string_split(e.key, '.')) WHEN 'host' THEN 1000
      ELSE 999 + len(string_split(e.key, '/')) END AS weight,
    row_number() OVER (PARTITION BY n.page_id, e.kind, e.key ORDER BY e.day DESC) AS latest
  FROM named n JOIN events e ON e.day <= n.day AND (
       e.kind = 'host' AND e.key = n.host
    OR e.kind = 'domain' AND (e.key = n.host OR ends_with(n.host, '.' || e.key))
    OR e.kind = 'prefix' AND starts_with(n.host || '/' || array_to_string(n.parts, '/') || '/', e.key || '/'))
), active AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY weight DESC) AS best,
    count(*) OVER (PARTITION BY page_id) AS n_active
  FROM matches WHERE latest = 1 AND action = 'add'
)
SELECT n.page_id, CAST(n.day AS VARCHAR) AS fetched, n.host, coalesce(a.n_active, 0) AS n_active,
  a.kind || ':' || a.key AS rule, coalesce(a.verdict = 'block', false) AS blocked
FROM named n LEFT JOIN active a ON a.page_id = n.page_id AND a.best = 1
"""


def op7_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorisation.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), sized AS (
  SELECT doc_id, source, text,
         CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM docs
), keyed AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|1|' || md5(text)), 1, 13) AS BIGINT)
         + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
    / (CAST(size + 1 AS DOUBLE)
       / CAST(size + 1 + length(text) - length(translate(text, '#*$%&|<>!', '')) AS DOUBLE)) AS key
  FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
         3 * source_size AS cap
  FROM sources
), shares AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS ratio,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER prior, 0) AS DOUBLE)
      / CAST(sum(w) OVER () - coalesce(sum(w) OVER prior, 0) AS DOUBLE) AS share
  FROM weighted
  WINDOW prior AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), settled AS (
  SELECT *, arg_min(share, ratio) FILTER (ratio > share) OVER () AS final FROM shares
), targets AS (
  SELECT source, source_size,
    CASE WHEN final IS NULL OR ratio <= final THEN CAST(cap AS DOUBLE) ELSE w * final END AS target
  FROM settled
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM targets
), placed AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed k JOIN epochs e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * epochs + CASE WHEN 2 * upto - size < 2 * rest THEN size ELSE 0 END AS BIGINT) AS taken
FROM placed
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path), path)


def op10_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_bitsliced.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, scale=64)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM (SELECT DISTINCT vec_id, embedding FROM embeddings)
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(rows, conversations.damage(rows))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_personal_data": op3_personal_data,
    "op4_token_files": op4_token_files,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_url_lists": op6_url_lists,
    "op7_factorisation_machine": op7_factorisation_machine,
    "op8_mix_sources": op8_mix_sources,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_bitsliced_topk": op10_bitsliced_topk,
    "op11_repair_conversations": op11_repair_conversations,
    "op12_html_text": op12_html_text,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE = {
    "op5_near_duplicates": OP5_SQL,
    "op6_url_lists": OP6_SQL,
    "op8_mix_sources": OP8_SQL,
    "op10_bitsliced_topk": OP10_SQL,
}
