"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see; where it is unset and Spark is local, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        at = _LOCAL[key] = _LOCAL.get(key) or f"file://{tempfile.mkdtemp(prefix='colonnade-')}"
    return at.rstrip("/")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: it is computed once, and lost executors lose nothing."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spread(df: DataFrame, *by: str, share: int = 10_000) -> DataFrame:
    """df dealt over tasks by columns, about `share` rows a task.

    Spark splits input by bytes: a small file of short rows is one task, however long the work on each row takes. df should be
    cheap to count, as a stored table is.
    """
    return df.repartition(max(1, -(-df.count() // share)), *by)
