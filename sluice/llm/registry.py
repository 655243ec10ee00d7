"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline
from sluice.llm import bpe, chat, decontaminate, fingerprint, lines, neardup, ngrams, sharding, toxicity, unigram

SHARDS = 40
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=False)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.format_chats(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "n_turns", "n_calls", "n_results", "n_linked", F.array_join("errors", ",").alias("errors"), F.sha2(F.col("chat").cast("binary"), 256).alias("chat_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scores(table(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_counts, op2_minhash_near_dedup, op3_byte_bpe, op4_decontamination, op5_sharding, op6_toxicity, op7_chat_formatting, op8_line_dedup, op9_lm_scoring, op10_document_fingerprints]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


#: The chat's text is that of messages without calls; tests hold the others.
OP7_SQL = """
WITH calls AS (
  SELECT conv_id, string_split(unnest(string_split(text, '<tool_call>')[2:]), '</tool_call>')[1] AS raw FROM conversations WHERE role = 'assistant' AND contains(text, '<tool_call>')
), asked AS (
  SELECT conv_id, json_valid(raw) AS readable, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.id') END AS id FROM calls
), results AS (
  SELECT conv_id, CASE WHEN json_valid(text) THEN json_extract_string(text, '$.tool_call_id') END AS id FROM conversations WHERE role = 'tool'
), linked AS (
  SELECT conv_id, id FROM results WHERE EXISTS (SELECT 1 FROM asked WHERE asked.conv_id IS NOT DISTINCT FROM results.conv_id AND asked.id = results.id)
), found AS (
  SELECT conv_id, coalesce(id, '?') || ':unreadable' AS e FROM asked WHERE NOT readable
  UNION ALL SELECT conv_id, 'duplicate:' || id FROM asked WHERE id IS NOT NULL GROUP BY conv_id, id HAVING count(*) > 1
  UNION ALL SELECT conv_id, 'unlinked:' || coalesce(id, '?') FROM results WHERE NOT EXISTS (SELECT 1 FROM asked WHERE asked.conv_id IS NOT DISTINCT FROM results.conv_id AND asked.id = results.id)
  UNION ALL SELECT DISTINCT conv_id, 'unanswered:' || id FROM asked WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM results WHERE asked.conv_id IS NOT DISTINCT FROM results.conv_id AND asked.id = results.id)
), counts AS (
  SELECT conv_id, sum(calls) AS n_calls, sum(results) AS n_results, sum(linked) AS n_linked FROM (
    SELECT conv_id, 1 AS calls, 0 AS results, 0 AS linked FROM asked UNION ALL SELECT conv_id, 0, 1, 0 FROM results UNION ALL SELECT conv_id, 0, 0, 1 FROM linked
  ) GROUP BY conv_id
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256('{"messages":[' || string_agg('{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}', ',' ORDER BY turn, role) || ']}') AS chat_sha256
  FROM conversations GROUP BY conv_id
)
SELECT chats.conv_id, n_turns, coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_results, 0)::BIGINT AS n_results, coalesce(n_linked, 0)::BIGINT AS n_linked,
  coalesce(errors, '') AS errors, chat_sha256
FROM chats LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM chats.conv_id
LEFT JOIN (SELECT conv_id, string_agg(e, ',' ORDER BY e) AS errors FROM found GROUP BY conv_id) f ON f.conv_id IS NOT DISTINCT FROM chats.conv_id
"""

OP8_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), bad AS (
  SELECT k, max(doc_id) AS stays FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), kept AS (
  SELECT keyed.*, bad.k IS NULL OR bad.stays = doc_id AS keep FROM keyed LEFT JOIN bad USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), spans AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(ws, i, i + least(len(ws), 13) - 1), ' ') AS span, least(len(ws), 13) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), places AS (
  SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS span
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM spans))
), found AS (
  SELECT doc_id, item_id, places.n AS n, i FROM places JOIN spans USING (n, span)
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL, "op7_chat_formatting": OP7_SQL, "op8_line_dedup": OP8_SQL}
