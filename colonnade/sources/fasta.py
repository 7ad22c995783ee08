"""FASTA and metadata tables.

Files are read as text by Spark: uncompressed FASTA splits at record starts, so a file of any size is read in parallel.
Gzip is recognised by its first bytes where the name does not say so.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import rows as R
from .blocks import RANGE_BYTES, Format, Line, Record, between, index, ranges_of


def description_meta(desc: Column) -> Column:
    """key=value pairs of a description: bracketed ones if there is a bracket, else words with both sides."""
    entry = lambda m: F.struct(F.trim(F.substring_index(m, "=", 1)).alias("key"), F.trim(F.regexp_replace(m, "^[^=]*=", "")).alias("value"))
    bracketed = F.filter(F.transform(F.regexp_extract_all(desc, F.lit(r"\[([^\[\]=]*=[^\]]*)\]"), 1), entry), lambda m: m["key"] != "")
    words = F.filter(F.transform(F.regexp_extract_all(desc, F.lit(r"([^\s=]+=\S+)"), 1), entry), lambda m: (m["key"] != "") & (m["value"] != ""))
    return F.when(F.contains(desc, F.lit("[")), bracketed).otherwise(words)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset-ordered) raw records without their leading mark."""
    raw = spark.read.text(path, lineSep="\n>").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord"), F.col("value"))
    return raw


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Rows of FASTA files, doc_id by path, idx in file order; errors for FASTQ and for empty input."""
    raw = _records(spark, path)
    text = F.regexp_replace(F.regexp_replace("value", "^\\s*>", ""), "\r", "")
    head, body = F.substring_index(text, "\n", 1), F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, "^[^\n]*\n", "")).otherwise("")
    fastq = F.trim(F.col("value")).startswith("@") & (F.col("ord") == F.min("ord").over(Window.partitionBy("path")))
    each = raw.withColumns({"head": head, "seq": S.normalize(body), "bad": fastq}).where(F.trim("head") != "")
    start, data = R.from_gapped(F.col("seq"))
    name, desc = F.regexp_extract("head", r"^\S*", 0), F.trim(F.regexp_replace("head", r"^\S*", ""))
    checked = F.when(F.col("bad"), F.raise_error(F.lit("This is a FASTQ file"))).otherwise(name)
    w = Window.partitionBy("path").orderBy("ord")
    return each.select(F.xxhash64("path").alias("doc_id"), (F.row_number().over(w) - 1).cast("int").alias("idx"), checked.alias("name"), desc.alias("description"), start.alias("start"), data.alias("data"), description_meta(desc).alias("meta"))


def limited(rows: DataFrame, max_rows: int, max_bases: int) -> DataFrame:
    """The first rows of each document up to a number of rows and bases, with `more`: whether others follow."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    before = F.coalesce(F.sum(F.length("data")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keep = (F.row_number().over(w) <= max_rows) & (before < max_bases)
    out = rows.withColumn("keep", keep).withColumn("more", ~F.min("keep").over(Window.partitionBy("doc_id")))
    return out.where("keep").drop("keep")


def write_fasta(rows: DataFrame, path: str) -> None:
    """One record a row: >name description, then the sequence on one line; in order of `ord` or idx."""
    by = "ord" if "ord" in rows.columns else "idx"
    text = "text" if "text" in rows.columns else "data"
    head = F.concat(F.lit(">"), "name", F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" "), "description")).otherwise(""))
    rows.orderBy(by).select(F.concat(head, F.lit("\n"), F.col(text)).alias("value")).write.text(path)


def pasted(texts: DataFrame) -> DataFrame:
    """(id, n, name, description, seq, unknown) of FASTA or plain text in (id, text).

    Text before the first mark is a record without a name. Unknown characters become N; each counts once.
    """
    raw = F.filter(F.split(F.concat(F.lit("\n"), F.regexp_replace("text", "\r", "")), "\n[ \t]*>"), lambda p: F.lit(True))
    each = texts.select("id", F.posexplode(raw).alias("n", "part"))
    head = F.when(F.col("n") > 0, F.substring_index("part", "\n", 1)).otherwise("")
    body = F.when(F.col("n") > 0, F.when(F.contains("part", F.lit("\n")), F.regexp_replace("part", "^[^\n]*\n", "")).otherwise("")).otherwise(F.col("part"))
    each = each.withColumns({"head": head, "body": body}).where((F.col("n") > 0) | (S.normalize(F.col("body")) != ""))
    w = Window.partitionBy("id").orderBy("n")
    return each.select("id", F.row_number().over(w).alias("n"), F.regexp_extract("head", r"^\S*", 0).alias("name"), F.trim(F.regexp_replace("head", r"^\S*", "")).alias("description"), S.normalize(F.col("body")).alias("seq"), S.unknown_count(F.col("body")).alias("unknown"))


def pasted_kind(records: DataFrame) -> DataFrame:
    """(id, kind) of pasted records by their letters as they are pasted: an alignment if there is a gap, or several have one length."""
    same = (F.count("*") > 1) & (F.min(F.length("seq")) == F.max(F.length("seq")))
    gap = F.bool_or(F.contains("seq", F.lit(S.GAP)))
    return records.groupBy("id").agg(F.when(gap | same, "Alignment").otherwise("Sequences").alias("kind"))


def pasted_document(records: DataFrame, name: str, description: str) -> DataFrame:
    """Rows of pasted records: a single one gets the given name; others keep theirs or are `Sequence n`."""
    many = F.count("*").over(Window.partitionBy("id"))
    start, data = R.from_gapped(F.col("seq"))
    named = F.when(many == 1, F.lit(name)).otherwise(F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Sequence "), F.col("n").cast("string"))))
    return records.select(F.col("id").alias("doc_id"), (F.col("n") - 1).cast("int").alias("idx"), named.alias("name"), F.when(many == 1, F.lit(description)).otherwise(F.col("description")).alias("description"), start.alias("start"), data.alias("data"), description_meta(F.col("description")).alias("meta"))


def split_delimited(line: str, delimiter: str) -> list[str]:
    """Fields of a line. Text between quotes, wherever they stand, keeps its delimiters; two quotes inside quotes are one."""
    fields, pieces = [""], line.split('"')
    for i, piece in enumerate(pieces):
        inside = i % 2 == 1
        doubled = not inside and not piece and 0 < i < len(pieces) - 1  # nothing between the end of one quoted piece and the next
        first, *more = [piece] if inside else ['"'] if doubled else piece.split(delimiter)
        fields[-1] += first
        fields += more
    return [f.strip() for f in fields]


def table_delimiter(header: str) -> str:
    return "\t" if "\t" in header else ";" if header.count(";") > header.count(",") else ","


def read_meta_table(spark: SparkSession, path: str) -> DataFrame:
    """(name, line, key, value) of a table of metadata whose first column holds names.

    The header is read by the driver; lines go through an Arrow batch parser. Short lines are padded, long ones cut.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "^﻿|\r$", "").alias("value")).where(F.trim("value") != "")
    first = lines.orderBy("line").first()
    if first is None:
        raise ValueError("The table is empty")
    delimiter = table_delimiter(first["value"])
    keys = split_delimited(first["value"], delimiter)[1:]
    if not keys:
        raise ValueError("The table needs at least two columns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for line, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, *values = split_delimited(text, delimiter)
                for key, value in zip(keys, [*values, *[""] * len(keys)], strict=False):
                    for column, x in zip(out, (name, line, key, value), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["name", "line", "key", "value"])

    return lines.where(F.col("line") > first["line"]).mapInArrow(run, "name string, line long, key string, value string")


def maybe_gunzip(data: bytes) -> bytes:
    """Contents of a file that may be compressed, by its first two bytes; several members are joined."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def read_fasta_bytes(spark: SparkSession, path: str) -> DataFrame:
    """read_fasta() for files whose compression their name does not tell: a file is one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = maybe_gunzip(content).decode("utf-8", "replace")
                if text.lstrip()[:1] == "@":
                    raise ValueError(f"{where} is a FASTQ file")
                parts = [p for p in ("\n" + text).split("\n>")[1:]]
                if not parts:
                    raise ValueError(f"{where} has no sequences")
                yield pa.RecordBatch.from_arrays([pa.array([where] * len(parts)), pa.array(list(range(len(parts))), pa.int32()), pa.array(parts)], names=["path", "idx", "text"])

    each = files.mapInArrow(run, "path string, idx int, text string")
    text = F.regexp_replace("text", "\r", "")
    head = F.substring_index(text, "\n", 1)
    body = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, "^[^\n]*\n", "")).otherwise("")
    return _shaped(each.withColumns({"head": head, "body": body}))


def _shaped(each: DataFrame) -> DataFrame:
    """Rows of records (path, idx, head, body)."""
    start, data = R.from_gapped(F.col("seq"))
    desc = F.trim(F.regexp_replace("head", r"^\S*", ""))
    return each.withColumn("seq", S.normalize(F.col("body"))).select(F.xxhash64("path").alias("doc_id"), "idx", F.regexp_extract("head", r"^\S*", 0).alias("name"), desc.alias("description"), start.alias("start"), data.alias("data"), description_meta(desc).alias("meta"))


def _marked(lines: Iterator[Line], file: str = "") -> Iterator[Record]:
    """(place, header, sequence, "") of records of lines; text before the first mark belongs to none."""
    at, head, held = 0, None, []
    for place, line in lines:
        if line.startswith(">"):
            if head is not None:
                yield at, head, "".join(held), ""
            at, head, held = place, line[1:].rstrip("\r"), []
        elif head is None and line.startswith("@"):
            raise ValueError(f"{file} is a FASTQ file")
        else:
            held.append(line.rstrip("\r"))
    if head is not None:
        yield at, head, "".join(held), ""


FASTA = Format(">", _marked, lambda lines: True)


def read_fasta_ranges(spark: SparkSession, files: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """read_fasta() for block-gzip files: each is read by many tasks, in ranges that an index has proved. A file must have a sequence."""
    ranges = ranges_of(index(spark, files, FASTA, range_bytes))
    filled = {r["file"] for r in ranges if r["records"]}
    if empty := sorted(set(files) - filled):
        raise ValueError(f"{empty[0]} has no sequences")
    ranges = [r for r in ranges if r["records"]]
    sent = spark.sparkContext.broadcast([(r["file"], r["first"], r["after"], r["base"]) for r in ranges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                path, first, after, base = sent.value[i]
                for idx, (head, seq, _) in enumerate(between(path, first, after, FASTA), base):
                    yield pa.RecordBatch.from_pylist([{"path": path, "idx": idx, "head": head, "body": seq}], schema=pa.schema([("path", pa.string()), ("idx", pa.int32()), ("head", pa.string()), ("body", pa.string())]))

    return _shaped(spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(run, "path string, idx int, head string, body string"))
