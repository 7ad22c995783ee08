"""Read sets that grow: running summaries over a stream of reads.

An add-on. New Parquet files of reads (the columns of sources.fastq) are picked up as they arrive; the state is one row of
sums a file of reads, whatever the number of reads, so it needs no watermark to stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reads import quality_sum, record_counts
from ..sources.fastq import SCHEMA


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_summary(reads: DataFrame) -> DataFrame:
    """records, bases, quality_sum, min_len, max_len, gc of each file so far; for update or complete mode."""
    c = record_counts(F.col("seq"))
    each = reads.select("file", c["bases"].alias("bases"), (c["n_c"] + c["n_g"]).alias("gc"), (c["n_a"] + c["n_c"] + c["n_g"] + c["n_t"]).alias("acgt"), quality_sum(F.col("qual")).alias("quality"))
    out = each.groupBy("file").agg(F.count("*").alias("records"), F.sum("bases").alias("bases"), F.sum("quality").alias("quality_sum"), F.min("bases").alias("min_len"), F.max("bases").alias("max_len"), F.sum("gc").alias("gc"), F.sum("acgt").alias("acgt"))
    return out.withColumn("gc_percent", F.coalesce(100.0 * F.col("gc") / F.nullif("acgt", F.lit(0)), F.lit(0.0))).drop("gc", "acgt")
