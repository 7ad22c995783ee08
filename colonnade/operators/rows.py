"""Rows of alignments: one record a sequence, with its start column and gapped data.

A rows table has doc_id, idx, name, description, start, data and meta (array of key, value). A row covers the columns from
start to start + length(data); outside there is no coverage, which is not a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequence as S
from .ranks import numbered

META = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
ROWS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("idx", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("data", T.StringType()), T.StructField("meta", META)]
)


def end() -> Column:
    return F.col("start") + F.length("data")


def from_gapped(data: Column, offset: Column | int = 0) -> tuple[Column, Column]:
    """(start, data) of gapped text whose first character is at offset: gaps at both ends are no coverage."""
    body = F.regexp_replace(data, "^-+|-+$", "")
    lead = F.length(data) - F.length(F.regexp_replace(data, "^-+", ""))
    return F.when(body == "", 0).otherwise(lead + offset).cast("int"), body


def at(col: Column) -> Column:
    """The cell in a column, null without coverage."""
    return F.when((col >= F.col("start")) & (col < end()), F.substring("data", col - F.col("start") + 1, F.lit(1)))


def ungapped_len() -> Column:
    return F.length(S.ungap(F.col("data")))


def meta_value(key: str) -> Column:
    return F.try_element_at(F.filter("meta", lambda m: m["key"] == key), F.lit(1))["value"]


def set_meta(key: str, value: Column) -> Column:
    """meta with the first entry of a key replaced, or one appended."""
    first = F.array_position(F.transform("meta", lambda m: m["key"]), F.lit(key))
    entry = F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    changed = F.transform("meta", lambda m, i: F.when(i + 1 == first, entry).otherwise(m))
    return F.when(first > 0, changed).otherwise(F.concat("meta", F.array(entry)))


def slice_text(c0: Column, c1: Column, blank: str = " ") -> Column:
    """The columns c0..c1 as text, no coverage as blank."""
    a, b = F.greatest(c0, F.col("start")), F.least(c1, end())
    none = F.repeat(F.lit(blank), F.greatest(c1 - c0, F.lit(0)))
    inside = F.concat(F.repeat(F.lit(blank), a - c0), F.substring("data", a - F.col("start") + 1, b - a), F.repeat(F.lit(blank), c1 - b))
    return F.when(a < b, inside).otherwise(none)


def cells(rows: DataFrame, c0: int | None = None, c1: int | None = None) -> DataFrame:
    """doc_id, idx, col, base. A column range is cut out of the data before it is exploded."""
    if c0 is not None:
        a = F.greatest(F.lit(c0), F.col("start"))
        b = F.least(F.lit(c1), end())
        rows = rows.where((a < b)).select("doc_id", "idx", a.alias("start"), F.substring("data", a - F.col("start") + 1, b - a).alias("data"))
    return rows.where(F.length("data") > 0).select("doc_id", "idx", F.col("start"), F.posexplode(F.split("data", ""))).where(F.col("col") != "").select("doc_id", "idx", (F.col("start") + F.col("pos")).alias("at"), F.col("col").alias("base")).withColumnRenamed("at", "col")


def widths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.max(end()).cast("int").alias("width"))


def base_window(rows: DataFrame) -> DataFrame:
    """(c0, c1) from the first to the last base of each document."""
    lead = F.length("data") - F.length(F.regexp_replace("data", "^-+", ""))
    tail = F.length("data") - F.length(F.regexp_replace("data", "-+$", ""))
    some = rows.where(F.length(S.ungap(F.col("data"))) > 0)
    return some.groupBy("doc_id").agg(F.min(F.col("start") + lead).cast("int").alias("c0"), F.max(end() - tail).cast("int").alias("c1"))


def trim_window(rows: DataFrame) -> DataFrame:
    """The base window of the documents that are wider than it."""
    return base_window(rows).join(widths(rows), "doc_id").where((F.col("c0") > 0) | (F.col("c1") < F.col("width"))).select("doc_id", "c0", "c1")


def crop(rows: DataFrame, c0: int, c1: int) -> DataFrame:
    """Rows of the columns c0..c1, moved to start there, and how each changed."""
    a, b = F.greatest(F.col("start"), F.lit(c0)), F.least(end(), F.lit(c1))
    gone = a >= b
    change = F.when(gone, F.when((F.length("data") == 0) & (F.col("start") == 0), "Unchanged").otherwise("Cut")).when((a != F.col("start")) | (b != end()), "Cut").otherwise("Moved" if c0 > 0 else "Unchanged")
    return rows.select("doc_id", "idx", "name", "description", F.when(gone, 0).otherwise(a - c0).cast("int").alias("start"), F.when(gone, "").otherwise(F.substring("data", a - F.col("start") + 1, b - a)).alias("data"), "meta", change.alias("change"))


def crop_annotations(tracks: DataFrame, c0: int, c1: int) -> DataFrame:
    """Intervals (start_col, end_col) clipped to c0..c1; status kept, shortened or removed."""
    a, b = F.greatest("start_col", F.lit(c0)), F.least("end_col", F.lit(c1))
    out = tracks.withColumn("status", F.when(a >= b, "removed").when(b - a != F.col("end_col") - F.col("start_col"), "shortened").otherwise("kept"))
    return out.withColumns({"start_col": F.when(a < b, a - c0), "end_col": F.when(a < b, b - c0)})


def crop_features(tracks: DataFrame, c0: int, c1: int) -> DataFrame:
    """Features whose parts (start, end) are clipped; those without a part left are removed."""
    clip = F.transform("parts", lambda p: F.struct((F.greatest(p["start"], F.lit(c0)) - c0).alias("start"), (F.least(p["end"], F.lit(c1)) - c0).alias("end")))
    kept = F.filter(clip, lambda p: p["start"] < p["end"])
    size = lambda parts: F.aggregate(parts, F.lit(0), lambda s, p: s + (p["end"] - p["start"]).cast("int"))
    return tracks.withColumn("status", F.when(F.size(kept) == 0, "removed").when(size(kept) != size(F.col("parts")), "shortened").otherwise("kept")).withColumn("parts", kept)


def meta_keys(rows: DataFrame) -> DataFrame:
    """Keys of each document in the order of their first use."""
    each = rows.select("doc_id", "idx", F.posexplode("meta").alias("pos", "m")).groupBy("doc_id", F.col("m.key").alias("key")).agg(F.min(F.struct("idx", "pos")).alias("first"))
    return each.select("doc_id", "key", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("ord"))


def slice_rows(rows: DataFrame, c0: int, c1: int, only: DataFrame | None = None) -> DataFrame:
    """Rows of a column range: rows without a base go first, then columns without a base in the rows left.

    only: (doc_id, col) of the columns that may stay. Data come back with gaps at the ends as no coverage.
    """
    each = cells(rows, c0, c1).where(F.col("base") != S.GAP)
    if only is not None:
        each = each.join(only.select("doc_id", "col"), ["doc_id", "col"], "left_semi")
    columns = numbered(each.select("doc_id", "col").distinct(), ["doc_id"], [F.col("col")], "new").withColumn("new", F.col("new").cast("int"))
    placed = each.join(columns, ["doc_id", "col"])
    packed = placed.groupBy("doc_id", "idx").agg(F.array_sort(F.collect_list(F.struct("new", "base"))).alias("cells"))
    # each base after the gaps between it and the base before it
    gaps = lambda x, i: F.when(i == 0, "").otherwise(F.repeat(F.lit(S.GAP), x["new"] - F.element_at("cells", i)["new"] - 1))
    data = F.array_join(F.transform("cells", lambda x, i: F.concat(gaps(x, i), x["base"])), "")
    packed = packed.select("doc_id", "idx", F.col("cells")[0]["new"].cast("int").alias("start"), data.alias("data"))
    return packed.join(rows.select("doc_id", "idx", "name", "description", "meta"), ["doc_id", "idx"]).select("doc_id", "idx", "name", "description", "start", "data", "meta")


def pick_columns(rows: DataFrame, only: DataFrame) -> DataFrame:
    """The cells of each row in the columns (doc_id, col) of only, side by side: doc_id, idx, data."""
    each = cells(rows).join(only.select("doc_id", "col"), ["doc_id", "col"], "left_semi")
    return each.groupBy("doc_id", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "base"))), lambda x: x["base"]), "").alias("data"))


def first_column() -> Column:
    """First column of a feature with parts (start, end) in order; null without parts."""
    return F.array_min(F.transform("parts", lambda p: p["start"]))


def last_column() -> Column:
    """The column after the last one of a feature."""
    return F.array_max(F.transform("parts", lambda p: p["end"]))


def slice_columns(rows: DataFrame, c0: int, c1: int) -> DataFrame:
    """Alignment column of every column of the slice."""
    each = cells(rows, c0, c1).where(F.col("base") != S.GAP).select("doc_id", "col").distinct()
    return numbered(each, ["doc_id"], [F.col("col")], "new").withColumn("new", F.col("new").cast("int"))


def copy_kind(rows: DataFrame, kind: str) -> DataFrame:
    """Kind of a copy of rows: a contig becomes an alignment; linked rows are judged by gaps, starts and lengths."""
    if kind not in ("Linked", "Text"):
        return rows.select("doc_id").distinct().withColumn("kind", F.lit("Alignment" if kind == "Contig" else kind))
    gapped = F.bool_or(F.contains("data", F.lit(S.GAP)) | (F.col("start") > 0))
    same = (F.count("*") > 1) & (F.min(end()) == F.max(end()))
    return rows.groupBy("doc_id").agg(F.when(gapped | same, "Alignment").otherwise("Sequences").alias("kind"))


def delete_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows without those in gone (doc_id, idx), numbered anew; refuses to delete all rows of a document."""
    left = rows.join(gone.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")
    return numbered(left.withColumn("old_idx", F.col("idx")), ["doc_id"], [F.col("old_idx")], "new_idx").withColumn("idx", F.col("new_idx").cast("int")).drop("new_idx")


def reorder_rows(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Rows with the index that order (doc_id, idx, new_idx) gives them."""
    return rows.join(order, ["doc_id", "idx"]).withColumn("idx", F.col("new_idx")).drop("new_idx")


def import_metadata(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join a table (name, line, key, value) to rows on the lower-case name, or else the name before its first dot.

    Of equal names the last line counts; empty values never replace one.
    """
    named = table.groupBy(F.lower("name").alias("k"), "line").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("new")).groupBy("k").agg(F.max_by("new", "line").alias("new"))
    full, short = named.withColumnsRenamed({"k": "k1", "new": "n1"}), named.withColumnsRenamed({"k": "k2", "new": "n2"})
    low = F.lower("name")
    out = rows.join(full, low == F.col("k1"), "left").join(short, F.substring_index(low, ".", 1) == F.col("k2"), "left")
    new = F.filter(F.coalesce("n1", "n2"), lambda m: m["value"] != "")
    kept = F.filter("meta", lambda m: ~F.array_contains(F.transform(F.coalesce(new, F.array()), lambda n: n["key"]), m["key"]))
    return out.select("doc_id", "idx", "name", "description", "start", "data", F.when(F.coalesce("n1", "n2").isNull(), F.col("meta")).otherwise(F.concat(kept, new)).alias("meta"), F.coalesce("n1", "n2").isNotNull().alias("matched"))


def split_names(rows: DataFrame, delimiter: str, keys: list[str] | None = None) -> DataFrame:
    """(doc_id, idx, key, value) from the fields of names; names of one field are left out."""
    parts = S.name_fields(F.col("name"), delimiter)
    each = rows.select("doc_id", "idx", parts.alias("parts")).where(F.size("parts") >= 2).select("doc_id", "idx", F.posexplode("parts").alias("i", "value"))
    named = F.try_element_at(F.array(*(F.lit(k) for k in keys or [])).cast("array<string>"), F.col("i") + 1)
    return each.select("doc_id", "idx", F.coalesce(named, F.concat(F.lit("Name field "), (F.col("i") + 1).cast("string"))).alias("key"), "value")


def alignment_kind(rows: DataFrame) -> DataFrame:
    """Alignment if a row has gaps, or several rows have one length; else Sequences."""
    gap = F.bool_or(F.contains("data", F.lit(S.GAP)))
    same = (F.count("*") > 1) & (F.min(end()) == F.max(end()))
    return rows.groupBy("doc_id").agg(F.when(gap | same, "Alignment").otherwise("Sequences").alias("kind"))


def export(rows: DataFrame, c0: int, c1: int, gapped: bool = True, reference: int | None = None, consensus: str | None = None) -> DataFrame:
    """(ord, name, description, text) of rows to write: consensus, reference, then rows with a base in the range."""
    text = F.translate(slice_text(F.lit(c0), F.lit(c1)), " ", S.GAP)
    text = text if gapped else S.ungap(text)
    each = rows.select(F.when(F.col("idx") == F.lit(reference), -1).otherwise(F.col("idx")).alias("ord"), "name", "description", text.alias("text"))
    out = each.where((F.col("ord") == -1) | (S.ungap(F.col("text")) != ""))
    if consensus is not None:
        said = consensus[c0:c1].replace(" ", S.GAP)
        line = rows.sparkSession.range(1).select(F.lit(-2).alias("ord"), F.lit("Consensus").alias("name"), F.lit("").alias("description"), F.lit(said if gapped else said.replace("-", "")).alias("text"))
        out = line.unionByName(out)
    return out
