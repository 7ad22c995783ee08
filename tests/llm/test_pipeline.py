"""The pipeline: every stage keeps the columns of documents, and its decisions hold."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    base = docs.where("n_chars > 400").limit(20)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    first = base.first()
    odd = spark.createDataFrame([(None, None, None, None, None), (90_001, "", "en", "s", 0), (90_002, "12 34 " * 40, "en", "s", 1), (90_003, first["text"] + " end", "en", "s", 1), (90_004, first["text"] + " " + bench, "en", "s", 1), tuple(first)], docs.schema)
    now = docs.unionByName(odd)
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, now, DATA)
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        kept[name] = [r[0] for r in now.select("doc_id").collect()]
        if name != "mix":
            assert now.columns == docs.columns
    assert not {90_001, 90_002, None} & set(kept["language"])
    assert len(kept["near copies"]) == len(set(kept["near copies"])) and 90_003 not in kept["near copies"]
    assert 90_004 not in kept["decontamination"] and len(kept["decontamination"]) > 80
    assert now.groupBy("doc_id").agg(F.max("copy").alias("n")).where("n > 3").count() == 0


def test_run(spark):
    out = pipeline.run(spark, DATA)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "copy"} and out.count() > 50


def test_empty(spark):
    none = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0
