"""Samples by hash: shares of any size, and all rows where the bound is not reached."""

from pyspark.sql import functions as F

from colonnade.llm import langid, quality
from colonnade.llm.common import hash_bound


def test_bounds_of_shares(spark):
    assert hash_bound(1.0) == hash_bound(7.0) == (1 << 63) - 1 and hash_bound(0.0) == -(1 << 63)
    for share in (1e-3, 1e-9, 1e-15):
        assert abs((hash_bound(share) + (1 << 63)) / (1 << 64) - share) < 1e-3 * share
    n = spark.range(200_000).where(F.xxhash64("id") <= F.lit(hash_bound(0.01)).cast("long")).count()
    assert 1800 < n < 2200


def test_fit_takes_all_rows_below_the_bound(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id"), F.when(F.col("id") % 2 == 0, " und der die das nicht").otherwise(" and the of that is")).alias("text"), F.when(F.col("id") % 2 == 0, "de").otherwise("en").alias("lang"))
    seen = []
    monkeypatch.setattr(langid, "train", lambda x, langs: seen.append(len(langs)))
    langid.fit(docs)
    assert seen == [60]
    monkeypatch.setattr(quality, "learn", lambda x, bad, **_: seen.append(len(bad)))
    quality.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")))
    assert seen == [60, 60]
