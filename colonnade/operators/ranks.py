"""Numbers and running sums in the order of rows, within documents of any size.

A window over a document puts all its rows in one task. That is done only where the largest document is counted to have at
most FEW rows. Else rows are dealt by ranges of (document, order) as a table, sums run within each part of a document, and what
comes before a part is summed over the parts, of which there are as many as ranges and documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialized

FEW = 1 << 20
PART, AT, BEFORE = "part\u0000", "at\u0000", "before\u0000"  # names that no table has


def running(rows: DataFrame, by: list[str], order: list[Column], value: Column, name: str, upto: int = 0) -> DataFrame:
    """Add the sum of a whole-number value over a group's rows up to each row (upto = 0) or the row before it (upto = -1); 0 before the first.

    order must tell the rows of a group apart, or their numbers are those of some order of equal rows.
    """
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if sizes <= FEW:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))
    dealt = rows.withColumn(BEFORE, value).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = materialized(dealt.withColumns({AT: F.monotonically_increasing_id(), PART: F.spark_partition_id()}), "dealt")
    parts = dealt.groupBy(*by, PART).agg(F.sum(BEFORE).alias(name))
    before = F.coalesce(F.sum(name).over(Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(c).alias(f"{c}\u0000") for c in by), F.col(PART).alias(f"{PART}\u0000"), before.alias(f"{BEFORE}\u0000"))
    w = Window.partitionBy(*by, PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, upto)
    local = dealt.withColumn(name, F.coalesce(F.sum(BEFORE).over(w), F.lit(0)))
    same = F.col(PART) == F.col(f"{PART}\u0000")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}\u0000"))
    out = local.join(parts, same).withColumn(name, F.col(name) + F.col(f"{BEFORE}\u0000"))
    return out.select(*rows.columns, name)


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Add the number of each row in its group, from 0 on."""
    return running(rows, by, order, F.lit(1).cast("long"), name, -1)
