"""Queries that apply each corpus operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, langid, lexical, licenses, lm, mixing, ngram_join, quality, resampling, simhash, token_counts, warc
from .common import bucket, remove, shared_dir, table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.join(docs, 3, 90, keep=["doc_id"])


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_texts(docs, bucket(F.col("doc_id"), 7) == 2)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, keep=["doc_id"])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(pages, path)
    back = warc.verified(warc.read(spark, path))
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = bucket(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep=["doc_id"])


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages, keep=["page_id", "url"])


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lexical.new_path(spark)
    lexical.build(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    found = lexical.search(spark, path, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    remove(spark, path)
    return found


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.sample(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.join(docs, 3, keep=["doc_id"])


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_lm_scoring, op3_token_counts, op4_quality_rules, op5_warc, op6_language_id, op7_decontamination, op8_mixing, op9_license_scan, op10_html_text, op11_lexical_search, op12_resampling, op13_simhash)}
ORACLE_SQL = {"op5_warc": OP5_SQL, "op9_license_scan": licenses.oracle(), "op11_lexical_search": lexical.oracle(), "op12_resampling": resampling.oracle()}
