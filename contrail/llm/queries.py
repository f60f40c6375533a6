"""The registered queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm import (
    byte_bpe, conversation_repair, conversation_trie, embedding_dedup, language, mixing, ngram_join, pii, quality, suffix_dedup, token_counts, topk_search,
    warc,
)
from contrail.llm.common import read_table
from contrail.session import shared_dir

RANKS_50K = "byte_bpe_50k.tiktoken"
TOKENIZER_50K = "byte_bpe_50k.json"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(read_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS_50K),
                                      public_tokenizers.PATTERN)
    return byte_bpe.digests(coded)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read_table(spark, sf_dir, "documents"))
    counts = [pii.of_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"),
                        pii.as_text(F.col("spans")).alias("spans"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.deduplicate(read_table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_50K))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents"))
    return judged.withColumnRenamed("key", "doc_id").withColumn("broken_fences", F.array_join("broken_fences", ","))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(read_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(read_table(spark, sf_dir, "conversations")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(read_table(spark, sf_dir, "conversations"), rebuild=True)


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_byte_bpe, op3_pii, op4_warc, op5_embedding_dedup, op6_token_counts, op7_quality, op8_ngram_join, op9_language, op10_mixing,
    op11_conversation_repair, op12_conversation_trie, op13_topk_search)}


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in DuckDB, bit by bit."""
    return (f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT), "
            "lambda c, b: list_reduce(range(8), lambda y, z: xor(y >> 1, (y & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)")


ORACLE: dict[str, str] = {
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)""",
    "op10_mixing": """
WITH RECURSIVE s AS (
  SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS sz FROM documents GROUP BY 1),
r AS (SELECT source, sqrt(sz) / sz * ((SELECT sum(sz) FROM s) / (SELECT sum(sqrt(sz)) FROM s)) AS rate FROM s),
m AS (SELECT source, rate / greatest(ceil(rate / 16.0), 1) AS mean, greatest(ceil(rate / 16.0), 1)::INT AS draws FROM r),
c AS (SELECT source, mean, draws, 0 AS k, exp(-mean) AS p, exp(-mean) AS cum FROM m
      UNION ALL SELECT source, mean, draws, k + 1, p * mean / (k + 1), cum + p * mean / (k + 1) FROM c WHERE k < 96),
cdf AS (SELECT source, any_value(draws) AS draws, list(cum ORDER BY k) AS cums FROM c GROUP BY 1),
d AS (SELECT documents.*, draws, cums, '0|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, '')) AS seed
      FROM documents JOIN cdf ON documents.source IS NOT DISTINCT FROM cdf.source),
u AS (SELECT * EXCLUDE (cums, draws), list_sum(list_transform(range(1, draws + 1), lambda j: len(list_filter(cums,
        lambda x: x <= (('0x' || md5(seed || '|' || j)[1:13])::BIGINT)::DOUBLE / 4503599627370496.0))))::INT AS n FROM d),
e AS (SELECT * EXCLUDE (n), unnest(range(1, n + 1))::INT AS mix_copy FROM u)
SELECT * EXCLUDE (seed), md5('order|' || seed || '|' || mix_copy) AS mix_order FROM e""",
    "op11_conversation_repair": rf"""
WITH RECURSIVE x AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations),
y AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
             CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM x WHERE f <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM y),
d AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
             left(role, 1) AS c, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before FROM r),
puts(q, n, role, q2) AS (VALUES (0, 0, []::VARCHAR[], 0), (1, 0, [], 1), (2, 0, [], 2), (3, 0, [], 3), (0, 1, ['user'], 2), (1, 1, ['user'], 2), (2, 1, ['assistant'], 3),
  (3, 1, ['user'], 2), (0, 2, ['user', 'assistant'], 3), (1, 2, ['user', 'assistant'], 3), (2, 2, ['assistant', 'user'], 2), (3, 2, ['user', 'assistant'], 3)),
goes(q, c, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
moves(q, q2, audit, edit, c, role, put, cost) AS (
  SELECT p.q, p.q2, repeat('I', p.n) || 'D', 'D', NULL::VARCHAR, NULL::VARCHAR, p.role, 2 * p.n + 3 FROM puts p
  UNION ALL SELECT p.q, g.q2, repeat('I', p.n) || 'K', 'K', g.c, NULL, p.role, 2 * p.n FROM puts p JOIN goes g ON g.q = p.q2
  UNION ALL SELECT p.q, z.q2, repeat('I', p.n) || 'R', 'R', NULL, z.role[1], p.role, 2 * p.n + 2 FROM puts p JOIN puts z ON z.q = p.q2 AND z.n = 1),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM d
  UNION ALL
  SELECT conv_id, i, q, cost, audit, lines FROM (
    SELECT dp.conv_id, d.i, m.q2 AS q, dp.cost + m.cost + CASE WHEN m.edit <> 'D' AND d.fault = 'truncated' THEN 1 ELSE 0 END AS cost, dp.audit || m.audit AS audit,
           list_concat(dp.lines, list_concat(list_transform(m.put, lambda x: x || ':'),
             CASE WHEN m.edit = 'D' THEN [] ELSE [coalesce(m.role, d.role) || ':' || d.text] END)) AS lines
    FROM dp JOIN d ON d.conv_id IS NOT DISTINCT FROM dp.conv_id AND d.i = dp.i + 1 JOIN moves m ON m.q = dp.q
    WHERE m.edit = 'D' OR d.fault NOT IN ('blank', 'duplicate') AND (m.edit = 'R' OR m.c = d.c))
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
n AS (SELECT conv_id, max(i) AS i, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY 1),
e AS (SELECT dp.conv_id, dp.cost + 2 * len(t.put) AS cost, dp.audit || repeat('I', len(t.put)) AS audit,
             list_concat(dp.lines, list_transform(t.put, lambda x: x || ':')) AS lines
      FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.i = dp.i
      JOIN (VALUES (0, []::VARCHAR[]), (1, ['user', 'assistant']), (2, ['assistant']), (3, [])) t(q, put) ON t.q = dp.q
      QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + 2 * len(t.put), dp.audit || repeat('I', len(t.put))) = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(e.cost, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit,
       sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op12_conversation_trie": rf"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS d,
         strlen(coalesce(role, '')) || ':' || coalesce(role, '') || sha256(coalesce(text, '')) AS dig,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, t.d, dig, w FROM c JOIN t ON t.conv_id = c.base AND t.d <= c.h
      UNION ALL SELECT c.conv_id, t.d, dig, w FROM c JOIN t ON t.conv_id = c.conv_id AND t.d > c.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY d) AS d, dig, w FROM r),
p AS (SELECT conv_id, d, w, sha256(string_agg(dig, '|') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM s
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS above, max(d) OVER (PARTITION BY conv_id) AS len FROM p),
n AS (SELECT node, any_value(d) AS d, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
             string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len) AS ends FROM l GROUP BY 1),
k AS (SELECT above AS node, count(*) AS n_children FROM n GROUP BY 1),
v AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
u AS (SELECT l.node, sum(CASE WHEN v.conv_id = l.conv_id AND v.n_children = 0 THEN 1 ELSE 0 END) OVER b AS leaves,
             sum(CASE WHEN v.conv_id = l.conv_id THEN (v.n_convs - 1) * v.w ELSE 0 END) OVER b AS saved
      FROM l JOIN v USING (node) WINDOW b AS (PARTITION BY l.conv_id ORDER BY l.d DESC)),
a AS (SELECT node, sum(leaves)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM u GROUP BY 1)
SELECT v.conv_id, v.d::BIGINT AS depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, a.n_leaves, a.saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN a USING (node) LEFT JOIN v o ON o.node = v.above""",
    "op13_topk_search": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
}
