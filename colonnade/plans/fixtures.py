"""Aligned sequences derived from the customer table, equally in Spark and in DuckDB SQL.

The test tables hold no sequences. A reference of 128 columns comes from md5 digests; each customer is a row that starts
at column key modulo 5 and differs from it where digits of the md5 of its key say so.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rows as R
from ..sources.shared import shared_dir, spread

WIDTH = 128
_TO_BASES = str.maketrans("0123456789abcdef", "ACGT" * 4)
REFERENCE = "".join(hashlib.md5(f"ref{i}".encode()).hexdigest().translate(_TO_BASES) for i in range(4))


_STORED: dict[tuple[str, str], str] = {}


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference as row 0 and a row a customer (its key plus 1), meta keys segment and nation; written once a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORED:
        _STORED[key] = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
        derived(spark, sf_dir).write.parquet(_STORED[key])
    return spark.read.schema(R.ROWS).parquet(_STORED[key])


def _cells() -> np.ndarray:
    """The cell of each column for each byte that a digit can be."""
    cell = np.repeat(np.frombuffer(REFERENCE.encode(), np.uint8)[:, None], 256, 1)
    x = np.arange(WIDTH)
    cell[x % 7 == 0, ord("f")] = ord("-")
    cell[:, ord("e")] = np.frombuffer(REFERENCE.translate(str.maketrans("ACGT", "CGTA")).encode(), np.uint8)
    cell[x % 11 == 0, ord("d")] = ord("N")
    return cell


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digits as cells, without those before the start."""
    cell, x = _cells(), np.arange(WIDTH)
    for batch in batches:
        digits = np.frombuffer("".join(batch.column(3).to_pylist()).encode(), np.uint8).reshape(-1, WIDTH)
        text = cell[x, digits].tobytes().decode()
        raw = [text[i * WIDTH + a : (i + 1) * WIDTH] for i, a in enumerate(batch.column(4).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.string())], names=["k", "segment", "nation", "raw"])


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    digits = F.concat(*(F.md5(F.concat(F.col("k").cast("string"), F.lit(f":{i}"))) for i in range(4)))
    raw = spread(base, "k").select("k", "segment", "nation", digits.alias("digits"), (F.col("k") % 5).cast("int").alias("a")).mapInArrow(_texts, "k long, segment string, nation string, raw string")
    start, data = R.from_gapped(F.col("raw"), (F.col("k") % 5).cast("int"))
    entry = lambda key: F.struct(F.lit(key).alias("key"), F.col(key).alias("value"))
    made = raw.select(F.lit(1).cast("long").alias("doc_id"), (F.col("k") + 1).cast("int").alias("idx"), F.concat(F.lit("seq_"), F.col("k")).alias("name"), F.concat(F.lit("customer of "), F.col("nation")).alias("description"), start.alias("start"), data.alias("data"), F.array(entry("segment"), entry("nation")).alias("meta"))
    first = spark.createDataFrame([(1, 0, "ref", "reference", 0, REFERENCE, [])], R.ROWS)
    return first.unionByName(made)


SQL = {
    "raw0": f"""SELECT c_custkey AS k, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation,
      concat(md5(c_custkey || ':0'), md5(c_custkey || ':1'), md5(c_custkey || ':2'), md5(c_custkey || ':3')) AS digits, '{REFERENCE}' AS ref FROM customer""",
    "raw1": """SELECT *, array_to_string(list_transform(range(k % 5, 128), lambda x: CASE
      WHEN digits[x + 1] = 'f' AND x % 7 = 0 THEN '-' WHEN digits[x + 1] = 'e' THEN translate(ref[x + 1], 'ACGT', 'CGTA')
      WHEN digits[x + 1] = 'd' AND x % 11 = 0 THEN 'N' ELSE ref[x + 1] END), '') AS raw FROM raw0""",
    "rows": f"""SELECT 1::BIGINT AS doc_id, 0 AS idx, 'ref' AS name, 'reference' AS description, 0 AS start, '{REFERENCE}' AS data, NULL AS segment, NULL AS nation
      UNION ALL SELECT 1, CAST(k + 1 AS INTEGER), 'seq_' || k, 'customer of ' || nation, CAST(k % 5 + length(raw) - length(ltrim(raw, '-')) AS INTEGER), trim(raw, '-'), segment, nation FROM raw1""",
    "cells": "SELECT doc_id, idx, CAST(start + i AS INTEGER) AS col, data[i + 1] AS base FROM (SELECT *, unnest(range(length(data))) AS i FROM rows)",
    "counts": """SELECT doc_id, col, count_if(base = 'A') AS n_a, count_if(base = 'C') AS n_c, count_if(base = 'G') AS n_g, count_if(base = 'T') AS n_t, count_if(base = '-') AS n_gap,
      count_if(base NOT IN ('A', 'C', 'G', 'T', '-')) AS n_other FROM cells WHERE idx <> 0 GROUP BY ALL
      UNION ALL SELECT 1, CAST(c AS INTEGER), 0, 0, 0, 0, 0, 0 FROM range(128) t(c) WHERE c NOT IN (SELECT col FROM cells WHERE idx <> 0)""",
    "majority": """SELECT *, n_a + n_c + n_g + n_t + n_gap AS n, greatest(n_a, n_c, n_g, n_t, n_gap) AS top,
      CASE WHEN greatest(n_a, n_c, n_g, n_t, n_gap) = 0 THEN NULL WHEN n_a = greatest(n_a, n_c, n_g, n_t, n_gap) THEN 'A' WHEN n_c = greatest(n_a, n_c, n_g, n_t, n_gap) THEN 'C'
      WHEN n_g = greatest(n_a, n_c, n_g, n_t, n_gap) THEN 'G' WHEN n_t = greatest(n_a, n_c, n_g, n_t, n_gap) THEN 'T' ELSE '-' END AS state FROM counts""",
    "consensus_cells": """SELECT *, CASE WHEN n = 0 THEN CASE WHEN n_other > 0 THEN 'N' ELSE ' ' END WHEN n_gap > greatest(n_a, n_c, n_g, n_t) THEN '-'
      ELSE substr('-ACMGRSVTWYHKDBN', 1 + (n_a = greatest(n_a, n_c, n_g, n_t))::INT + 2 * (n_c = greatest(n_a, n_c, n_g, n_t))::INT + 4 * (n_g = greatest(n_a, n_c, n_g, n_t))::INT + 8 * (n_t = greatest(n_a, n_c, n_g, n_t))::INT, 1) END AS b FROM majority""",
}


def _counted(sql: str) -> str:
    """count_if(x) as a count of BIGINT type."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def with_fixtures(sql: str) -> str:
    """The SQL with the fixture tables it names, and those they name, as common table expressions."""
    return _counted(_with(sql))


def _with(sql: str) -> str:
    need: list[str] = []

    def add(text: str) -> None:
        for name, body in SQL.items():
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                add(body)
                need.append(name)

    add(sql)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in need)
    if not need:
        return sql
    return f"WITH {own[1] or ''}{head}, {sql[own.end():]}" if own else f"WITH {head} {sql}"
