"""A corpus from documents in five stages: language, quality, near copies, benchmark passages, mixing of sources.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all documents that the one before it kept; all but
the last return the columns of documents. The tables labels and benchmark are read from sf_dir. ORACLE_SQL is None: what
is learned from rows (languages, rules) and what hashes decide have no SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import decontam, langid, mixing, ngram_join, quality
from colonnade.llm.common import discard, materialize, table

ORACLE_SQL = None
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language is less than LEAST_SCORE certain, go."""
    model = langid.fit(docs)
    inside = docs.select(F.struct("*").alias("doc"), "text")
    said = langid.identify(inside, model, ["doc", "text"])
    return said.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or a learned rule rejects go."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    inside = docs.select(F.struct("*").alias("doc"), "text")
    return quality.judge(inside, rules, ["doc"]).where("kept").select("doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles reach a Jaccard similarity of 0.8 that with the smallest id stays.

    Rows that repeat an id differ by a 128-bit hash of all their columns; of equal rows one stays. Rows without words form no
    group: each stays. Null ids come after all others.
    """
    names = [F.xxhash64(*docs.columns).alias("h1"), F.xxhash64(F.lit(1), *docs.columns).alias("h2")]
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), *names)
    groups = ngram_join.join(docs.select(row.alias("row"), "text"), 5, 80, id_col="row", keep=["row"])
    stay = groups.where(F.col("row") == F.col("component_id")).select("row.h1", "row.h2")
    rows = docs.select(*names, F.struct("*").alias("doc")).join(stay, ["h1", "h2"], "left_semi")
    return rows.groupBy("h1", "h2").agg(F.first("doc").alias("doc")).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    inside = docs.select(F.struct("*").alias("doc"), "text")
    return decontam.flag(inside, table(spark, sf_dir, "benchmark").select("item_id", "text")).where("n_items = 0").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, with the number of the copy."""
    inside = docs.select(F.struct("*").alias("doc"), "doc_id", "text", "source")
    mixed = mixing.mix(inside, keep=["doc"])
    return mixed.where("copies > 0").select("doc.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


STAGES = [("language", language), ("quality", quality_rules), ("near copies", near_copies), ("decontamination", decontamination), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written, and deleted when the next one is."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        kept = materialize(stage(spark, docs, sf_dir), f"stage{i + 1}")
        if i:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
