"""Queries of the training-data operators, one per operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from kilnflow.llm import chat, decontaminate, filter_audit, line_dedup, mixing, quality_model, quality_rules, secrets, simhash, spelling, token_files, toxicity, warc
from kilnflow.llm.common import new_path, table
from kilnflow.llm.tokenizer_path import default_tokenizer


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write_blocks(table(spark, sf_dir, "documents"), default_tokenizer(), path)
    return token_files.read_documents(spark, path)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summarise(secrets.scan(table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), digest=True)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "n_windows", "first_word")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.records(warc.read_archives(spark, path, payloads=False)).select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.flags(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_model, op2_mixing, op3_chat_format, op4_token_files, op5_simhash, op6_toxicity, op7_secrets, op8_quality_rules, op9_line_dedup, op10_decontaminate, op11_warc, op12_filter_audit, op13_spelling)} | {"pipeline": corpus_pipeline.run}

#: A conversation goes if a longer one starts with it; of equal ones the least conv_id stays.
CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, list((role, text) ORDER BY turn, role, text) AS t,
         string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS chat
  FROM conversations GROUP BY conv_id
), sized AS (SELECT *, len(t) AS n FROM turns),
inner_prefixes AS (SELECT DISTINCT t[1:k] AS p FROM sized, unnest(range(1, n)) AS r(k)),
same AS (SELECT t, min(conv_id) AS conv_id, count(*) AS n_same, any_value(n) AS n, any_value(chat) AS chat FROM sized GROUP BY t)
SELECT conv_id, CAST(n AS INT) AS n_turns, n_same, chat FROM same WHERE t NOT IN (SELECT p FROM inner_prefixes)
"""

#: A payload's response is the row with the largest id.
WARC_SQL = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS p, strlen(coalesce(html, '')) AS n FROM pages),
tops AS (SELECT p, max(page_id) AS top FROM sized WHERE n >= 1000 GROUP BY p)
SELECT page_id, n AS payload_bytes, sha1(p) AS payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM sized LEFT JOIN tops USING (p)
"""

#: Each order is walked for each set of failed filters.
AUDIT_SQL = r"""
WITH marks AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 100 AS A, 100 * len(list_distinct(w)) < 80 * len(w) AS B,
         100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D, coalesce(texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t), false) AS E
  FROM texts LEFT JOIN marks USING (doc_id)
), sets AS (
  SELECT part, concat(CASE WHEN A THEN 'A' ELSE '' END, CASE WHEN B THEN 'B' ELSE '' END, CASE WHEN C THEN 'C' ELSE '' END, CASE WHEN D THEN 'D' ELSE '' END, CASE WHEN E THEN 'E' ELSE '' END) AS s,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, step, filter_order[step] AS f, left(filter_order, step - 1) AS before FROM orders, unnest(range(1, 6)) AS r(step)),
walked AS (
  SELECT part, filter_order, step, f, s, n, good, toxic, contains(s, f) AS fails, CASE WHEN step = 1 THEN false ELSE len(list_intersect(string_split(s, ''), string_split(before, ''))) > 0 END AS gone
  FROM sets, steps
), totals AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed, coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant,
         coalesce(sum(n) FILTER (s = f), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
  FROM walked GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM totals
"""

ORACLE_SQL = {"op3_chat_format": CHAT_SQL, "op11_warc": WARC_SQL, "op12_filter_audit": AUDIT_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
