"""Queries that write and read files, edit library tables, and run helpers that no other query runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import columns as C
from ..operators import display as D
from ..operators import library as B
from ..operators import mapper as M
from ..operators import ranks
from ..operators import reads as E
from ..operators import rows as R
from ..operators import search as Q
from ..sources import fasta, fastq
from ..sources.shared import shared_dir
from . import fixtures as X
from .more_queries import READS_SQL, folders, reads
from .queries import NORM, table
from .registry import query


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _library(spark: SparkSession, **tables: DataFrame) -> B.Library:
    lib = B.Library(spark, _place(spark, "library"))
    if tables:
        lib.load_tables(tables)
    return lib


def _documents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select((k + 1).alias("id"), F.col("n_name").alias("name"), F.lit("Alignment").alias("kind"), F.lit(3).alias("n_rows"), F.lit(9).alias("width"), F.lit(1).alias("reference"), F.lit("").alias("description"), F.lit(None).cast("string").alias("created"), (k % 10 + 1).alias("folder_id"))


# ---- files -----------------------------------------------------------------------------------------------------------
@query("S01_S02_S08_S12_fasta_files", "SELECT name, description, data FROM rows")
def s01(spark, d):
    path = _place(spark, "fasta")
    fasta.write_fasta(X.rows(spark, d), path)
    return fasta.read_fasta(spark, path).select("name", "description", "data")


@query(
    "S09_S10_metadata_file",
    """SELECT 'seq_' || c_custkey AS name, key, CASE key WHEN 'a' THEN c_mktsegment || '; "x"' WHEN 'b' THEN CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_nationkey::VARCHAR END ELSE CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'z' END END AS value
    FROM customer, (VALUES ('a'), ('b'), ('c')) t(key)""",
)
def s09(spark, d):
    path, k = _place(spark, "meta"), F.col("c_custkey")
    rest = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(";"), F.col("c_nationkey"), F.lit("; z;too many")))
    lines = table(spark, d, "customer").select(k.alias("ord"), F.concat(F.lit("seq_"), k, F.lit(';"'), "c_mktsegment", F.lit('; ""x"""'), rest, F.lit("\r")).alias("value"))
    spark.createDataFrame([(0, "﻿name;a;b;c"), (0, "")], "ord long, value string").unionByName(lines).repartition(1).sortWithinPartitions("ord", F.desc("value")).select("value").write.text(path)
    return fasta.read_meta_table(spark, path).select("name", "key", "value")



@query("S11_H23_H24_fastq_files", READS_SQL + " SELECT head, seq, qual FROM reads")
def s11(spark, d):
    path = _place(spark, "fastq")
    reads(spark, d).select(F.concat(F.lit("@"), "head", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.text(path)
    return fastq.read_fastq_bytes(spark, path).select("head", "seq", "qual")


@query("S11_S12_H23_block_gzip_ranges", READS_SQL + " SELECT read_no, true AS in_order, head, seq, qual FROM reads")
def s11_ranges(spark, d):
    """Written as block-gzip files, and read by a task a range; reads are numbered in each file."""
    path = _place(spark, "blocks")
    fastq.write_fastq(reads(spark, d).repartitionByRange(4, "read_no").sortWithinPartitions("read_no"), path, member=4096)
    back = fastq.read_fastq(spark, path, range_bytes=8192)
    key = F.split_part("head", F.lit(":"), F.lit(5)).cast("long")
    first = back.groupBy("file").agg(F.min(key).alias("first"))
    return back.join(first, "file").select(key.alias("read_no"), (key - F.col("first") == F.col("read_no")).alias("in_order"), "head", "seq", "qual")


@query("R09_R10_R11_read_rows", READS_SQL + f", n AS (SELECT read_no, file, head, {NORM.format('seq')} AS s FROM reads) SELECT CAST(read_no AS INTEGER) AS idx, split_part(head, ' ', 1) AS name, trim(s, '-') AS data, 'Mate=R' || file[7] || ';File=' || file AS meta FROM n")
def r11(spark, d):
    r = reads(spark, d)
    shown = fastq.trimmed(r).join(fastq.with_names(r).select("file", "read_no", F.substring_index("head", " ", 1).alias("name"), "description"), ["file", "read_no"])
    both = [E.read_rows(shown.where(F.col("file").contains(f"_{mate}")), mate) for mate in ("R1", "R2")]
    return both[0].unionByName(both[1]).select("idx", "name", "data", F.array_join(F.transform("meta", lambda m: F.concat(m["key"], F.lit("="), m["value"])), ";").alias("meta"))


@query("R07_H19_shows_all", READS_SQL + f" SELECT file, count(*) <= {E.PREVIEW_READS} AS fastq, count(*) <= {E.PREVIEW_SEQUENCES} AND sum(length(replace(seq, '-', ''))) <= 5000000 AS fasta FROM reads GROUP BY file")
def r07(spark, d):
    s = E.scan(reads(spark, d))
    return s.select("file", E.shows_all(F.lit(True), F.col("records"), F.col("bases")).alias("fastq"), E.shows_all(F.lit(False), F.col("records"), F.col("bases") * F.lit(E.PREVIEW_BASES // 5_000_000)).alias("fasta"))


# ---- library: documents ----------------------------------------------------------------------------------------------
@query("X23_X24_X25_X26_H35_documents", "SELECT n_nationkey + 1 AS id, CASE n_nationkey WHEN 4 THEN 'new name' ELSE n_name END AS name, CASE n_nationkey WHEN 2 THEN 2 WHEN 3 THEN NULL ELSE 1 END AS reference, CASE n_nationkey WHEN 6 THEN 3 ELSE n_nationkey % 10 + 1 END AS folder_id FROM nation WHERE n_nationkey <> 8")
def x23(spark, d):
    lib = _library(spark, documents=_documents(spark, d))
    lib.set_reference(3, 2)
    lib.set_reference(4, None)
    lib.rename_document(5, "new name")
    lib.move_document(7, 3)
    lib.delete_document(9)
    return lib.documents().select("id", "name", "reference", "folder_id")


@query("S21_S22_S25_X29_X31_H36_texts_and_links", "SELECT 'note' AS name, 'Text' AS kind, 0 AS n_rows, 0 AS width, 'first text' AS content UNION ALL SELECT 'set', 'Linked', count(*), 150, 'run' FROM customer")
def s21(spark, d):
    lib = _library(spark)
    note = lib.insert_text("note", "first text")
    n = table(spark, d, "customer").count()
    link = lib.insert_linked("set", {"name": "run", "summary": {"records": n, "width": 150}})
    said = spark.createDataFrame([(note, lib.text(note)), (link, lib.linked(link)["name"])], "id long, content string")
    known = lib.list_linked().select(F.col("doc_id").alias("id")).union(lib.table("texts").select("doc_id"))
    return lib.documents().join(said, "id").join(known, "id", "left_semi").select("name", "kind", "n_rows", "width", "content")


@query(
    "M25_M27_M29_M24_row_edits",
    """WITH n AS (SELECT CAST(count(*) AS INTEGER) AS n FROM rows), a AS (SELECT n - 1 - idx AS idx, name, CASE WHEN idx % 2 = 0 THEN 'even' ELSE segment END AS segment FROM rows, n)
    SELECT 'copy' AS doc, CAST(row_number() OVER (ORDER BY idx) - 1 AS INTEGER) AS idx, name, segment FROM a WHERE idx IN (0, 2, 5)
    UNION ALL SELECT 'all', CAST(row_number() OVER (ORDER BY idx) - 1 AS INTEGER), name, segment FROM a WHERE idx NOT IN (0, 2, 5)""",
)
def m25(spark, d):
    lib = _library(spark)
    rows = X.rows(spark, d)
    id_ = lib.insert_document("all", "Alignment", rows, 0)
    even = rows.where("idx % 2 = 0").select("idx", F.array(F.struct(F.lit("segment").alias("key"), F.lit("even").alias("value"))).alias("meta"))
    lib.update_metadata(id_, even)
    n = rows.count()
    lib.reorder_rows(id_, list(range(n))[::-1])
    copy = lib.insert_copy(id_, [0, 2, 5], "copy", cut=True)
    assert lib.document(id_)["n_rows"] == n - 3 and lib.document(copy)["n_rows"] == 3
    part = lambda i, name: lib.load(i)[1].select(F.lit(name).alias("doc"), "idx", "name", R.meta_value("segment").alias("segment"))
    return part(copy, "copy").union(part(id_, "all"))


@query("M18_M28_save_crop", "SELECT idx, CASE WHEN start >= 90 OR start + length(data) <= 10 THEN 0 ELSE greatest(start, 10) - 10 END AS start, substr(data, greatest(10 - start, 0) + 1, least(start + length(data), 90) - greatest(start, 10)) AS data, 80 AS width FROM rows WHERE idx > 0")
def m28(spark, d):
    lib = _library(spark)
    id_ = lib.insert_document("all", "Alignment", X.rows(spark, d).where("idx > 0"))
    lib.replace_rows(id_, R.crop(lib.load(id_)[1], 10, 90).drop("change"))
    info, rows, _ = lib.load(id_)
    return rows.select("idx", "start", "data", F.lit(info["width"]).alias("width"))


# ---- library: tracks -------------------------------------------------------------------------------------------------
@query(
    "X15_X16_X17_X19_O12_annotations",
    """WITH a AS (SELECT o_orderkey AS id, o_orderpriority AS name, CAST(o_orderkey % 100 AS INTEGER) AS s, NULL AS color FROM orders WHERE o_orderkey NOT IN (2, 3) UNION ALL SELECT max(o_orderkey) + 1, 'added', 5, NULL FROM orders)
    SELECT CAST(row_number() OVER (ORDER BY s, id) AS INTEGER) AS ord, id, CASE id WHEN 1 THEN 'renamed' ELSE name END AS name, s AS start_col, CASE WHEN id IN (4, 5) THEN '#FF0000' END AS color FROM a""",
)
def x15(spark, d):
    k = F.col("o_orderkey")
    own = table(spark, d, "orders").select(k.alias("id"), F.lit(1).alias("doc_id"), F.col("o_orderpriority").alias("name"), F.lit("Region").alias("kind"), (k % 100).cast("int").alias("start_col"), (k % 100 + 10).cast("int").alias("end_col"), F.lit("").alias("note"), F.lit(None).cast("string").alias("color"))
    lib = _library(spark, annotations=own)
    lib.update_annotation(1, name="renamed")
    lib.delete_annotations([2, 3])
    lib.set_color("annotations", [4, 5], "#FF0000")
    lib.add_annotation(1, "added", "Region", 5, 15)
    return _in_order(lib.annotations(1), [F.col("start_col"), F.col("id")], "id", "name", "start_col", "color")


def _in_order(ordered: DataFrame, order: list, *columns: str) -> DataFrame:
    """The rows with their place in an order."""
    placed = ranks.numbered(ordered.withColumn("doc_id", F.lit(1)), ["doc_id"], order, "ord")
    return placed.select((F.col("ord") + 1).cast("int").alias("ord"), *columns)


@query(
    "X18_X20_X21_X22_O13_features",
    """WITH f AS (SELECT s_name AS name, CAST(s_suppkey % 7 AS INTEGER) AS a, CAST(s_suppkey % 7 + s_nationkey + 1 AS INTEGER) AS b, CAST(row_number() OVER (ORDER BY s_suppkey % 7, s_name) AS BIGINT) AS id FROM supplier)
    SELECT CAST(row_number() OVER (ORDER BY a, b, id) AS INTEGER) AS ord, id, CASE id WHEN 2 THEN 'gene x' ELSE name END AS name, CASE WHEN id = 2 THEN '#00FF00' WHEN id IN (4, 6) THEN '#0000FF' END AS color FROM f WHERE id NOT IN (3, 5)""",
)
def x18(spark, d):
    lib = _library(spark)
    lib.insert_document("one", "Sequences", spark.createDataFrame([], R.ROWS))
    a, none = (F.col("s_suppkey") % 7).cast("int"), F.lit(None).cast("string")
    part = F.array(F.struct(a.alias("start"), (a + F.col("s_nationkey") + 1).cast("int").alias("end")))
    made = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("gene").alias("kind"), F.lit(7).alias("strand"), part.alias("parts"), F.lit("").alias("location"), F.array().cast(R.META).alias("qualifiers"), F.lit("").alias("source"), none.alias("color"))
    lib.add_features(1, made)
    lib.update_feature(2, "gene x", "#00FF00")
    lib.delete_features([3, 5])
    lib.set_color("features", [4, 6], "#0000FF")
    out = lib.features(1)
    assert out.where("strand <> 1").isEmpty()
    return _in_order(out, [F.col("parts")[0]["start"], F.array_max(F.transform("parts", lambda p: p["end"])), F.col("id")], "id", "name", "color")


@query("W09_position_note", "SELECT count(*) AS n, 'This document has ' || count(*) || ' annotations; their positions are not shifted when bases are inserted or removed. ' || count_if(o_orderkey % 100 + 10 > 60) || ' of them extend past the new end and will be removed.' AS note FROM orders")
def w09(spark, d):
    return B.position_note(table(spark, d, "orders").select((F.col("o_orderkey") % 100 + 10).cast("int").alias("end")), 60)


# ---- library: folders and settings -----------------------------------------------------------------------------------
@query(
    "X27_H38_H39_U05_U06_O11_folders",
    """WITH f AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey > 1 THEN s_suppkey // 2 END AS parent_id FROM supplier UNION ALL SELECT max(s_suppkey) + 1, 'added', 2 FROM supplier),
    g AS (SELECT id, CASE id WHEN 5 THEN 'a renamed one' ELSE name END AS name, CASE WHEN id = 7 THEN 10 WHEN parent_id = 4 THEN 2 ELSE parent_id END AS parent_id, id = 6 AS collapsed FROM f WHERE id <> 4)
    SELECT CAST(row_number() OVER (ORDER BY lower(name), id) AS INTEGER) AS ord, id, name, parent_id, collapsed FROM g""",
)
def x27(spark, d):
    lib = _library(spark, folders=folders(spark, d))
    lib.create_folder("added", 2)
    lib.rename_folder(5, "a renamed one")
    lib.collapse_folder(6, True)
    lib.move_folder(7, 10)
    lib.delete_folder(4)
    return _in_order(lib.folders(), [F.lower("name"), F.col("id")], "id", "name", "parent_id", "collapsed")


@query(
    "C35_folder_doc_count",
    """WITH RECURSIVE f AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey > 1 THEN s_suppkey // 2 END AS parent FROM supplier), t AS (SELECT id AS root, id FROM f WHERE id BETWEEN 1 AND 10 UNION ALL SELECT t.root, f.id FROM f JOIN t ON f.parent = t.id)
    SELECT root AS id, count(n_nationkey) AS n FROM t LEFT JOIN nation ON n_nationkey % 10 + 1 = t.id GROUP BY root""",
)
def c35(spark, d):
    lib = _library(spark, folders=folders(spark, d), documents=_documents(spark, d))
    return lib.folder_counts().where("id between 1 and 10")


@query(
    "U07_planned_moves",
    """WITH RECURSIVE f AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey > 1 THEN s_suppkey // 2 END AS parent FROM supplier), t AS (SELECT id FROM f WHERE id = 4 UNION ALL SELECT f.id FROM f JOIN t ON f.parent = t.id)
    SELECT 'folder' AS kind, 4::BIGINT AS id UNION ALL SELECT 'document', n_nationkey + 1 FROM nation WHERE n_nationkey % 10 + 1 <> 5 AND n_nationkey % 10 + 1 NOT IN (SELECT id FROM t)""",
)
def u07(spark, d):
    up, docs = folders(spark, d), _documents(spark, d)
    items = spark.createDataFrame([("folder", 4)], "kind string, id long").unionByName(docs.select(F.lit("document").alias("kind"), "id"))
    return B.planned_moves(items, 5, up, docs)


@query("X28_H37_settings", "SELECT 'theme' AS key, max(n_name) AS value FROM nation UNION ALL SELECT 'none', NULL")
def x28(spark, d):
    lib = _library(spark)
    lib.set_setting("theme", "light")
    lib.set_setting("theme", table(spark, d, "nation").agg(F.max("n_name")).first()[0])
    return spark.createDataFrame([(k, lib.setting(k)) for k in ("theme", "none")], "key string, value string")


# ---- helpers ---------------------------------------------------------------------------------------------------------
@query("F05_format_tm", "SELECT k, CASE WHEN lo IS NULL OR k % 11 = 0 THEN '–' WHEN k % 3 = 0 THEN printf('%.1f', lo) || ' °C' ELSE printf('%.1f', lo) || '–' || printf('%.1f', lo + 4.0) || ' °C' END AS tm FROM (SELECT c_custkey AS k, c_custkey % 90 + 0.23::DOUBLE AS lo FROM customer)")
def f05(spark, d):
    k = F.col("c_custkey")
    lo = F.when(k % 11 != 0, k % 90 + F.lit(0.23))
    return table(spark, d, "customer").select(k.alias("k"), N.format_tm(lo, lo + F.when(k % 3 == 0, 0.01).otherwise(4.0)).alias("tm"))


@query("H03_direction", "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS direction FROM orders")
def h03(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("k"), N.direction(F.when(k % 3 == 0, "Forward primer").when(k % 3 == 1, "Reverse primer").otherwise("Probe")).alias("direction"))


@query("H02_H04_H05_feature_ends", "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS INTEGER) END AS first, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 4 * 12 AS INTEGER) END AS last, c_custkey % 4 > 0 AS some FROM customer")
def h04(spark, d):
    n = (F.col("c_custkey") % 4).cast("int")
    parts = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), lambda i: F.struct((i * n).alias("start"), (i * n + (12 - i) * n).alias("end")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), parts.alias("parts")).select("k", R.first_column().cast("int").alias("first"), R.last_column().cast("int").alias("last"), (F.size("parts") > 0).alias("some"))


@query("Q09_jump", "SELECT o_orderkey AS k, least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT o_orderkey, CAST(o_orderkey % 977 AS INTEGER) AS a, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 50 AS INTEGER) ELSE CAST(o_orderkey % 977 AS INTEGER) END AS b FROM orders)")
def q09(spark, d):
    a = F.col("o_orderkey") % 977
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("go "), a, F.lit(" - "), F.col("o_custkey") % 50)).otherwise(F.concat(F.lit(" "), a, F.lit("x")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), Q.jump(said).alias("j")).select("k", F.col("j.a").cast("int").alias("lo"), F.col("j.b").cast("int").alias("hi"))


@query("O04_O06_descending", "SELECT key, key = 'Length' AS descending FROM (VALUES ('Name'), ('Length'), ('Identity'), ('Column'), ('Original')) t(key)")
def o04(spark, d):
    return spark.createDataFrame([(k, D.default_descending(k)) for k in ("Name", "Length", "Identity", "Column", "Original")], "key string, descending boolean")


@query("X08_reads_done", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey * 1000 END AS done FROM orders")
def x08(spark, d):
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("wrote "), k, F.lit(" reads"))).otherwise(F.concat(F.lit(" read "), F.format_number(k * 1000, 0), F.when(k % 3 == 1, " reads").otherwise(" pairs, so far")))
    return table(spark, d, "orders").select(k.alias("k"), E.reads_done(line).alias("done"))


@query("C33_C34_pair_identity", "SELECT idx, count(CASE WHEN r.base = c.base AND r.base <> '-' AND r.base <> 'N' THEN 1 END) AS matches, count(*) AS compared FROM cells c JOIN (SELECT col, base FROM cells WHERE idx = 0) r USING (col) WHERE idx > 0 AND c.base <> 'N' GROUP BY idx")
def c33(spark, d):
    def one(batches):
        import pyarrow as pa

        for batch in batches:
            got = [M.Alignment(s, x.encode(), []).count(X.REFERENCE.encode()) for s, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.matches for a in got], pa.int64()), pa.array([a.matches + a.mismatches + a.gaps for a in got], pa.int64())], names=["idx", "matches", "compared"])

    return X.rows(spark, d).where("idx > 0").select("idx", "start", "data").mapInArrow(one, "idx int, matches long, compared long")


@query(
    "C08_C09_H43_counts_after_edits",
    "WITH c AS (SELECT col, base FROM cells WHERE idx > 5 AND idx % 7 <> 3) SELECT CAST(t.col AS INTEGER) AS col, "
    + ", ".join(f"count(CASE WHEN base {w} THEN 1 END) AS {n}" for n, w in [*((f"n_{b.lower()}", f"= '{b}'") for b in "ACGT"), ("n_gap", "= '-'"), ("n_other", "NOT IN ('A', 'C', 'G', 'T', '-')")])
    + " FROM range((SELECT CAST(max(start + length(data)) AS BIGINT) FROM rows WHERE idx > 4 AND idx % 7 <> 3)) t(col) LEFT JOIN c USING (col) GROUP BY 1",
)
def c08(spark, d):
    """Rows are added, one becomes the reference, others go, all are turned round: counts are kept up, never counted again."""
    rows = X.rows(spark, d)
    lib = _library(spark)
    id_ = lib.insert_document("some", "Alignment", rows.where("idx between 0 and 9"), 0)
    lib.column_counts(id_)
    first = lib.now().document(id_)["files"]["counts"]
    lib.append_rows(id_, rows.where("idx > 9"))
    n = lib.document(id_)["n_rows"]
    lib.set_reference(id_, 5)
    lib.delete_rows(id_, [i for i in range(n) if i < 5 or i % 7 == 3])
    left = lib.document(id_)["n_rows"]
    lib.reorder_rows(id_, list(range(left))[::-1])
    assert lib.document(id_)["reference"] == left - 1 and lib.now().document(id_)["files"]["counts"] != first
    return lib.column_counts(id_).drop("doc_id")


@query("H41_H42_recomputed_consensus", "SELECT string_agg(b, '' ORDER BY col) AS consensus FROM consensus_cells")
def h41(spark, d):
    return C.consensus(C.column_counts(X.rows(spark, d), 0)).select("consensus")
