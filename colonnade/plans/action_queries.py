"""Queries of checks before actions, inputs and reports of tools, and actions of several library edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as T
from ..functions import sequence as S
from ..operators import actions as A
from ..operators import display as D
from ..operators import library as B
from ..operators import reads as E
from ..operators import rows as R
from . import fixtures as X
from .edit_queries import _library, _in_order, _place
from .queries import NORM, table
from .registry import query


def _k():
    return F.col("o_orderkey")


def _orders(spark, d, **columns):
    return table(spark, d, "orders").select(_k().alias("k"), *(c.alias(n) for n, c in columns.items()))


# ---- texts -----------------------------------------------------------------------------------------------------------
@query(
    "H02_H22_H60_H62_H63_documents",
    """SELECT o_orderkey AS k, o_orderkey % 5 < 3 AS has_rows, CASE WHEN o_orderkey % 2 = 0 THEN 'reads' ELSE 'sequences' END AS unit, CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_custkey % 9 = 1 THEN 'Doc [' || o_orderstatus || ']' ELSE 'Doc [' || (o_custkey % 9) || ',000 sequences]' END AS name,
    CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey END AS folder, CASE o_orderkey % 5 WHEN 3 THEN o_custkey % 2 = 0 WHEN 4 THEN false ELSE o_custkey % 4 > 0 END AS can_map FROM orders""",
)
def h02(spark, d):
    kinds = F.array(*(F.lit(k) for k in ("Sequences", "Alignment", "Contig", "Linked", "Text")))
    kind = F.get(kinds, (_k() % 5).cast("int"))
    c, n = F.col("o_custkey"), F.col("o_custkey") % 9
    name = F.when(n > 0, T.rows_name(F.lit("Doc"), F.when(n == 1, 1).otherwise(n * 1000), F.col("o_orderstatus")))
    return _orders(spark, d, has_rows=T.has_rows(kind), unit=T.unit(_k() % 2 == 0), name=name, folder=A.target_folder(F.when(_k() % 3 == 0, c), _k()), can_map=T.can_map(kind, c % 4, c % 2 == 0))


@query(
    "H61_sort_phrase",
    """SELECT k, 'by ' || CASE k % 3 WHEN 0 THEN 'name (' || CASE WHEN down THEN 'Z→A' ELSE 'A→Z' END || ')' WHEN 1 THEN 'length (' || CASE WHEN down THEN 'longest first' ELSE 'shortest first' END || ')'
    ELSE CASE n WHEN 0 THEN 'bases' WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'base at ref 1,042' ELSE 'base at column 1,008' END ELSE 'bases at columns 1008–' || (1007 + n) END || CASE WHEN down THEN ' (reversed)' ELSE '' END END AS phrase
    FROM (SELECT o_orderkey AS k, o_custkey % 2 = 0 AS down, o_orderkey % 4 AS n FROM orders)""",
)
def h61(spark, d):
    n = (_k() % 4).cast("int")
    cols = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), lambda i: i + 1006)
    place = T.bases_place(cols, F.when(_k() % 2 == 0, 1042), F.concat(F.lit("columns 1008–"), 1007 + n))
    key = F.when(_k() % 3 == 0, "Name").when(_k() % 3 == 1, "Length").otherwise("Bases")
    return _orders(spark, d, phrase=T.sort_phrase(key, F.col("o_custkey") % 2 == 0, place))


@query(
    "H64_H65_refusals",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'Linked files are read-only: features cannot be saved. Import the file into the library to change it.' END AS read_only,
    CASE WHEN o_orderkey % 2 = 0 THEN 'The viewer shows only the first 1,000 of ' || (1 + o_orderkey % 9) || ',000,000 reads of these linked files; this needs all of them.' END AS partial FROM orders""",
)
def h64(spark, d):
    kind = F.when(_k() % 3 == 0, "Linked").otherwise("Contig")
    return _orders(spark, d, read_only=T.refuse_read_only(kind, "features"), partial=T.refuse_partial(_k() % 2 == 1, F.lit(1000), (1 + _k() % 9) * 1_000_000, T.unit(F.lit(True))))


@query("H56_common_color", "SELECT o_custkey AS c, CASE WHEN count(DISTINCT coalesce(p, '')) = 1 THEN max(p) END AS color, count(DISTINCT coalesce(p, '')) > 1 AS mixed FROM (SELECT o_custkey, CASE WHEN o_orderpriority < '4' THEN '#' || o_orderstatus END AS p FROM orders) GROUP BY 1")
def h56(spark, d):
    color = F.when(F.col("o_orderpriority") < "4", F.concat(F.lit("#"), "o_orderstatus"))
    got = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(T.common_color(color).alias("x"))
    return got.select("c", "x.color", "x.mixed")


@query(
    "H58_H59_X09_X14_tool_texts",
    """SELECT o_orderkey AS k, 'tool -w ' || (o_orderkey % 8) || ' "' || o_orderstatus || ' x"' AS command, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'Reading ' || o_custkey ELSE 'Done' END AS status,
    CASE WHEN o_orderkey % 3 = 0 THEN 'NCBI received too many requests; wait a moment and try again.' WHEN o_orderkey % 3 = 1 THEN 'NCBI answered with HTTP status 500.' ELSE 'NCBI answered with HTTP status 404: no ' || o_custkey END AS error,
    CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 12 >= 9 THEN '1.' || (o_orderkey % 12) || '.2' END AS version, CASE WHEN o_orderkey % 5 = 0 THEN 'unexpected answer to --version: none' WHEN o_orderkey % 12 < 9 THEN 'version 1.' || (o_orderkey % 12) || '.2 is too old; 1.9.0 or newer is needed' END AS problem FROM orders""",
)
def h58(spark, d):
    args = F.array(F.lit("-w"), (_k() % 8).cast("string"), F.concat("o_orderstatus", F.lit(" x")))
    m = _k() % 4
    line = F.when(m == 0, "  \t").when(m == 1, " error: x").when(m == 2, F.concat(F.lit(" Reading "), "o_custkey", F.lit(" ...\r"))).otherwise("Done...")
    status = F.when(_k() % 3 == 0, 429).when(_k() % 3 == 1, 500).otherwise(404)
    body = F.when(_k() % 3 == 2, F.concat(F.lit("no "), "o_custkey")).otherwise("")
    answer = F.when(_k() % 5 == 0, " none\n").otherwise(F.concat(F.lit("tool v1."), _k() % 12, F.lit(".2\nmore")))
    got = _orders(spark, d, command=T.command_line("tool", args), status=T.status_line(line), error=T.error_message(status, body), s=T.tool_status(answer, (1, 9, 0)))
    return got.select("k", "command", "status", "error", "s.version", "s.problem")


@query(
    "X04_progress",
    """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN (o_custkey % 50) / 50.0::DOUBLE WHEN 3 THEN least(o_custkey % 200, 100) / 100.0::DOUBLE ELSE 0.5::DOUBLE END AS fraction,
    CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Searching sets over 2,000 candidates · ' || (o_custkey % 9 + 1) || ',000 evaluations (' || ((o_custkey % 9 + 1) * 10) || '.0% of max work)' WHEN 2 THEN 'Round of ' || o_orderstatus WHEN 3 THEN 'plain' ELSE 'x · 3,000 candidates generated' END AS text FROM orders""",
)
def x04(spark, d):
    c, m = F.col("o_custkey"), _k() % 5
    event = (
        F.when(m == 0, '{"type":"result"}')
        .when(m == 1, F.concat(F.lit('{"type":"progress","phase":"set_search","candidates":2000,"max_work":10000,"evaluations":'), (c % 9 + 1) * 1000, F.lit("}")))
        .when(m == 2, F.concat(F.lit('{"type":"progress","phase":"round","pct":3,"total":50,"covered":'), c % 50, F.lit(',"message":"Optimize by mismatch: round of '), "o_orderstatus", F.lit('"}')))
        .when(m == 3, F.concat(F.lit('{"type":"progress","message":"plain","pct":'), c % 200, F.lit("}")))
        .otherwise('{"type":"progress","phase":"reduce","generated":3000,"pct":50,"message":"x"}')
    )
    return _orders(spark, d, p=T.progress(event)).select("k", "p.fraction", "p.text")


@query(
    "H55_search_fields",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE 50.5::DOUBLE END AS tm, CASE WHEN o_orderkey % 4 = 2 THEN NULL ELSE o_orderkey % 7 + 1000 END AS max_work, 0.25::DOUBLE AS oligo_um,
    CASE o_orderkey % 4 WHEN 1 THEN 'The minimum Tm must be a number from 0 to 100.' WHEN 2 THEN 'Max. work must be a whole number.' WHEN 3 THEN 'Oligos in the set must be a whole number of at least 1.' END AS problem FROM orders""",
)
def h55(spark, d):
    m = _k() % 4
    typed = {k: F.lit("2") for k in T.ASKED} | {
        "tm": F.when(m == 1, "100,5").otherwise("50,5"),
        "max_work": F.when(m == 2, "1.5").otherwise(F.concat(F.lit("1,00"), _k() % 7)),
        "n_oligos": F.when(m == 3, "0").otherwise("1 0"),
        "oligo_nm": F.lit("250"),
    }
    got = T.search_fields(typed)
    return _orders(spark, d, **{k: got[k] for k in ("tm", "max_work", "oligo_um", "problem")})


# ---- typed sequences and records -------------------------------------------------------------------------------------
_S1 = "substr(translate(md5(c_custkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, 5 + c_custkey % 20)"


@query(
    "H53_H54_typed_sequences",
    f"""WITH s AS (SELECT c_custkey AS id, {_S1} AS s, c_custkey % 4 AS m FROM customer), t AS (SELECT *, length(s) - length(replace(s, 'N', '')) AS n_n, length(s) - length(regexp_replace(s, '[GC]', '', 'g')) AS n_gc FROM s)
    SELECT id, CASE m WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE m END::BIGINT AS n, CASE m WHEN 0 THEN '' WHEN 1 THEN length(s) || ' bp · GC ' || printf('%.1f', 100.0 * (n_gc + 0.5 * n_n) / length(s)) || '%' || CASE WHEN n_n > 0 THEN ' · ' || n_n || ' ambiguous (N, R, Y…)' ELSE '' END || ' · 1 gaps'
      WHEN 2 THEN '2 sequences · ' || CASE WHEN length(s) = 4 THEN '4 bp each' ELSE '4–' || length(s) || ' bp' END || ' → new sequence list' ELSE '3 sequences · 0–' || length(s) || ' bp → new sequence list' END AS summary,
    CASE WHEN m = 1 THEN '1 character(s) that are not nucleotide codes will be stored as N.' END AS note,
    CASE m WHEN 2 THEN 'a · ' || length(s) || ' bp|b · 4 bp' WHEN 3 THEN 'a · ' || length(s) || ' bp|b · 4 bp|Sequence 3 · 0 bp' ELSE '' END AS listing,
    CASE m WHEN 0 THEN 'Type or paste a sequence.' WHEN 1 THEN CASE WHEN id % 3 = 0 THEN 'Enter a name.' END WHEN 2 THEN CASE WHEN id % 5 = 0 THEN '2 records found: this document holds one sequence. Use File → New sequence… to create a sequence list.' WHEN id % 3 = 0 THEN 'Enter a name.' END ELSE '“Sequence 3” has no sequence.' END AS problem
    FROM (SELECT id, m, n_n + (m = 1)::INT AS n_n, n_gc, CASE WHEN m = 1 THEN s || 'N' ELSE s END AS s FROM t)""",
)
def h53(spark, d):
    k = F.col("c_custkey")
    s = F.substring(F.translate(F.md5(k.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGN"), F.lit(1), (5 + k % 20).cast("int"))
    m = k % 4
    text = F.when(m == 0, " \n12").when(m == 1, F.concat(s, F.lit("-!"))).when(m == 2, F.concat(F.lit(">a x\n"), s, F.lit("\n>b\nACGT\n"))).otherwise(F.concat(F.lit(">a x\n"), s, F.lit("\n>b\nACGT\n>\n")))
    texts = table(spark, d, "customer").select(k.alias("id"), text.alias("text"), F.when(k % 3 == 0, " ").otherwise("x").alias("name"), (k % 5 == 0).alias("edit"))
    return A.typed_summary(texts).withColumn("listing", F.array_join("listing", "|"))


@query(
    "R25_feature_target",
    """SELECT c_custkey::VARCHAR AS path, CASE WHEN c_custkey % 3 = 0 THEN 'R' || c_custkey || '.1' END AS version, CASE WHEN c_custkey % 3 = 0 THEN length(list_filter(range(40), lambda i: translate(substr(md5(c_custkey::VARCHAR) || md5(c_custkey::VARCHAR), 1, 40), '0123456789abcdef', 'ACGTACGTACGTACGT')[i + 1] <> '"""
    + X.REFERENCE[:40]
    + """'[i + 1]))::INTEGER END AS differences, CASE WHEN c_custkey % 3 > 0 THEN 'The record R' || c_custkey || '.1 (record ' || c_custkey || ') is 40 bp long; seq has 39 bases. Features are only imported onto a sequence of the same length (the same record and version).' END AS problem FROM customer""",
)
def r25(spark, d):
    from .more_queries import records

    k = F.col("c_custkey")
    seq = F.when(k % 3 == 0, X.REFERENCE[:40].replace("T", "U")).otherwise(X.REFERENCE[:39])
    target = table(spark, d, "customer").select(k.cast("string").alias("path"), F.lit("seq").alias("label"), seq.alias("seq"))
    return A.feature_target(records(spark, d), target)


# ---- views -----------------------------------------------------------------------------------------------------------
@query(
    "R30_feature_order",
    """SELECT o_custkey AS doc_id, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey) AS INTEGER) AS ord, 0 AS lane FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 10 AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 10 + 10 AS e FROM orders) WHERE o_orderkey % 3 > 0""",
)
def r30(spark, d):
    from pyspark.sql import Window

    s = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) * 10).cast("int")
    each = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), _k().alias("id"), s.alias("s"))
    parts = F.when(F.col("id") % 3 > 0, F.array(F.struct(F.col("s").alias("start"), (F.col("s") + 10).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return A.ordered_features(each.withColumn("parts", parts)).select("doc_id", "id", "ord", "lane")


@query("H47_H49_item_of_row", "SELECT idx AS row, CAST(row_number() OVER (ORDER BY length(replace(data, '-', '')) DESC, idx) - 1 AS INTEGER) AS item FROM rows")
def h47(spark, d):
    options = A.keep_view(D.Options(sort="Length", descending=True, group_by="gone"), ["segment"])
    return A.item_of_row(D.build(X.rows(spark, d), options)).select("row", "item")


# ---- linked files ----------------------------------------------------------------------------------------------------
_P = "'/d/' || c_nationkey || '_' || c_custkey || '_R' || m || '.fq'"


def _paths(spark, d):
    path = F.concat(F.lit("/d/"), "c_nationkey", F.lit("_"), "c_custkey", F.lit("_R"), F.col("m"), F.lit(".fq"))
    return table(spark, d, "customer").withColumn("m", F.explode(F.array(F.lit(1), F.lit(2)))).select(path.alias("path"), F.col("c_custkey").alias("size"))


@query("U03_add_files", f"SELECT {_P} AS path, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE c_custkey END AS size FROM customer, (VALUES (1), (2)) t(m)")
def u03(spark, d):
    p = _paths(spark, d)
    known = p.where("size % 3 = 0").withColumn("size", F.lit(-1).cast("long"))
    return A.add_files(known, p.unionByName(p))


@query(
    "R31_regroup",
    """SELECT CASE WHEN c_custkey % 4 = 0 THEN 'typed ' || c_custkey ELSE c_nationkey || '_' || c_custkey END AS name, 'Paired' AS layout, 2 AS n FROM customer""",
)
def r31(spark, d):
    p = _paths(spark, d)
    first = E.propose(p)
    k = F.regexp_extract(F.col("files")[0]["path"], r"_(\d+)_", 1).cast("long")
    old = first.select(F.when(k % 4 == 0, F.concat(F.lit("typed "), k)).otherwise(F.col("name")).alias("name"), F.when(k % 8 == 1, F.slice("files", 1, 1)).otherwise(F.col("files")).alias("files"))
    return A.regroup(p, old).select("name", "layout", F.size("files").alias("n"))


@query(
    "J09_X06_run_inputs",
    """WITH s AS (SELECT c_custkey AS k, c_custkey % 5 AS m, 'f' || c_custkey AS f FROM customer) SELECT 's' || k AS name, 'Lane ' || l || ' of 2' AS part, f || 'a' || l AS r1, f || 'b' || l AS r2, NULL AS problem FROM s, (VALUES (1), (2)) t(l) WHERE m = 0
    UNION ALL SELECT 's' || k, '', f || 'a1', f || 'b1', NULL FROM s WHERE m = 1 UNION ALL SELECT 's' || k, NULL, NULL, NULL, 'The R1 and R2 files of the read set are not in order' FROM s WHERE m = 2
    UNION ALL SELECT 's' || k, NULL, NULL, NULL, 'A paired read set needs R1 and R2 files' FROM s WHERE m = 3 UNION ALL SELECT 's' || k, 'File ' || l || ' of 2', f || x || '1', NULL, NULL FROM s, (VALUES (1, 'a'), (2, 'b')) t(l, x) WHERE m = 4""",
)
def j09(spark, d):
    k = F.col("c_custkey")
    m = k % 5
    file = lambda name, role: F.struct(F.concat(F.lit("f"), k, F.lit(name)).alias("path"), F.lit(role).alias("role"))
    pair = lambda i: [file(f"a{i}", "R1"), file(f"b{i}", "R2")]
    files = F.when(m == 0, F.array(*pair(1), *pair(2))).when(m == 1, F.array(*pair(1))).when(m == 2, F.array(*pair(1)[::-1])).when(m == 3, F.array(pair(1)[0])).otherwise(F.array(file("a1", "Single"), file("b1", "Single")))
    sets = table(spark, d, "customer").select(F.concat(F.lit("s"), k).alias("name"), F.when(m == 4, "Single").otherwise("Paired").alias("layout"), files.alias("files"))
    runs = A.run_inputs(sets)
    each = sets.select(F.explode("files").alias("f")).select("f.path")
    used = A.linked_files(each, runs).select(F.col("path").alias("r1"), F.lit(True).alias("linked"))
    return runs.join(used, "r1", "left").where(F.col("r1").isNull() | F.col("linked")).select("name", "part", "r1", "r2", "problem")


@query("X10_error_text", "SELECT o_custkey AS run, CASE WHEN count_if(o_orderkey % 5 = 0) > 0 THEN string_agg(CASE WHEN o_orderkey % 5 = 0 THEN 'bad ' || o_orderkey END, chr(10) ORDER BY o_orderkey) ELSE string_agg('line ' || o_orderkey, chr(10) ORDER BY o_orderkey) END AS text FROM orders GROUP BY 1")
def x10(spark, d):
    line = F.when(_k() % 5 == 0, F.concat(F.lit(" error:  bad "), _k(), F.lit(" "))).otherwise(F.concat(F.lit("line "), _k()))
    return A.error_text(table(spark, d, "orders").select(F.col("o_custkey").alias("run"), _k().alias("ord"), line.alias("line")))


# ---- runs on selected columns ----------------------------------------------------------------------------------------
@query(
    "X02_X03_run_records",
    """WITH k AS (SELECT idx, col, base FROM cells WHERE idx % 2 = 1 AND col >= 2 AND col < 50 AND base <> '-'), c AS (SELECT DISTINCT col FROM k), r AS (SELECT DISTINCT idx FROM k)
    SELECT idx, 'seq_' || (idx - 1) AS name, string_agg(coalesce(base, '-'), '' ORDER BY col) AS text FROM (SELECT r.idx, c.col, k.base FROM r CROSS JOIN c LEFT JOIN k ON k.idx = r.idx AND k.col = c.col) GROUP BY idx""",
)
def x02(spark, d):
    rows = X.rows(spark, d)
    return A.run_records(rows, rows.where("idx % 2 = 1"), 2, 50).select("idx", "name", "text")


@query(
    "X05_run_report",
    """SELECT o_orderkey AS k, concat_ws(chr(10), 'PRIMER SEARCH RUN', repeat('=', 17), 'Document:    doc', 'Selection:   ref 1–9' || CASE WHEN o_orderkey % 2 = 0 THEN '; columns with gaps in the reference left out' ELSE '' END, 'Columns:     1,200',
    'Sequences:   all rows: ' || (o_custkey % 9 + 2) || ' chosen' || CASE WHEN o_custkey % 2 = 0 THEN ', 1 without bases in the selection left out' ELSE '' END, 'Usable:      1' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' of ' || (o_custkey % 9 + 2 - (o_custkey % 2 = 0)::INT) || ' (tool drops ' || (o_orderkey % 3) || ' with gaps or no coverage and 0 with N/ambiguity codes)' END,
    'Tool:        tool 1.2.3 (/bin/tool)', 'Command:     tool x', 'Started:     then', 'Finished:    now (2.0 s)', '', 'Positions in the output count the columns passed to the tool:', 'one', 'two', '', 'out ' || o_orderkey || chr(10)) AS text FROM orders""",
)
def x05(spark, d):
    n = F.col("o_custkey") % 9 + 2
    lit = {k: F.lit(v) for k, v in {"document": "doc", "selection": "ref 1–9", "columns": 1200, "rows": "all rows", "usable": 1, "ambiguous": 0, "tool": "tool", "version": "1.2.3", "path": "/bin/tool", "command": "tool x", "started": "then", "finished": "now", "seconds": 2.0}.items()}
    about = lit | {"collapsed": _k() % 2 == 0, "chosen": n, "written": n - (F.col("o_custkey") % 2 == 0).cast("int"), "gaps": _k() % 3, "positions": F.array(F.lit("one"), F.lit("two")), "output": F.concat(F.lit("out "), _k(), F.lit(" \n\n"))}
    return _orders(spark, d, text=A.run_report(about))


# ---- actions ---------------------------------------------------------------------------------------------------------
def _made(rows, chosen):
    part = F.array(F.struct(F.col("idx").alias("start"), (F.col("idx") + 5).alias("end")))
    none = F.lit(None).cast("string")
    return rows.select("name", F.lit("gene").alias("kind"), F.lit(1).alias("strand"), part.alias("parts"), F.lit("").alias("location"), F.array().cast(R.META).alias("qualifiers"), F.lit("src").alias("source"), none.alias("color"), chosen.alias("chosen"))


@query(
    "H66_H67_import_record",
    """SELECT 'done' AS what, 'Imported R (' || length(replace((SELECT data FROM rows WHERE idx = 0), '-', '')) || ' bp) with ' || count_if(idx % 2 = 0) || ' features' AS said, count(*)::BIGINT AS features FROM rows WHERE idx BETWEEN 1 AND 9
    UNION ALL SELECT 'more', 'Imported 5 features from S', 5 UNION ALL SELECT 'failed', 'no document', 0""",
)
def h66(spark, d):
    lib, rows = _library(spark), X.rows(spark, d)
    some = rows.where("idx between 1 and 9")
    id_, said = A.import_record(lib, rows.where("idx = 0"), _made(some, F.col("idx") % 2 == 0), "R")
    more = A.import_features(lib, id_, _made(some, F.col("idx") % 2 == 1), "S")
    before = lib.table("documents").count()
    try:
        A.import_record(lib, rows.where("idx = 0"), _made(some, F.lit(True)).withColumn("strand", F.raise_error(F.lit("no")).cast("int")), "T")
        failed = "imported"
    except ValueError:
        failed = "no document" if lib.table("documents").count() == before else "left over"
    n = lib.features(id_).count()
    return spark.createDataFrame([("done", said, n), ("more", more, 5), ("failed", failed, 0)], "what string, said string, features long")


@query("H68_save_rows", "SELECT 'all [3 sequences]' AS doc, 3 AS n UNION ALL SELECT 'all [seq_0]', 1 UNION ALL SELECT 'all', CAST(count(*) - 3 AS INTEGER) FROM rows")
def h68(spark, d):
    lib = _library(spark)
    id_ = lib.insert_document("all", "Alignment", X.rows(spark, d))
    A.save_rows(lib, id_, [1])
    A.save_rows(lib, id_, [2, 4, 6], cut=True)
    return lib.documents().select(F.col("name").alias("doc"), F.col("n_rows").alias("n"))


@query("H69_confirm_trim", "SELECT idx, start + 6 - 6 AS start, data, 128 AS width, 'kept' AS track FROM rows WHERE idx > 0")
def h69(spark, d):
    lib = _library(spark)
    rows = X.rows(spark, d).where("idx > 0")
    id_ = lib.insert_document("all", "Alignment", rows.withColumn("start", F.col("start") + 6 - F.lit(0)))
    lib.add_annotation(id_, "kept", "Region", 4, 20)
    lib.add_annotation(id_, "gone", "Region", 0, 3)
    first = rows.agg(F.min("start")).first()[0]
    assert A.trim(lib, id_) == (6 + first, 6 + X.WIDTH) and A.trim(lib, id_) is None
    info, rows, tracks = lib.load(id_)
    return rows.join(tracks.select(F.col("name").alias("track")), F.col("doc_id") == id_).select("idx", (F.col("start") + first).alias("start"), "data", F.lit(info["width"] + first).cast("int").alias("width"), "track")


@query("H70_save_sequence", "SELECT 'one' AS name, 'Sequences' AS kind, 1 AS n, 'ACGTN' AS first UNION ALL SELECT 'many', 'Alignment', 2, 'AC-T' UNION ALL SELECT 'none', 'Type or paste a sequence.', NULL, NULL")
def h70(spark, d):
    lib = _library(spark)
    text = lambda t: spark.createDataFrame([(1, t)], "id long, text string")
    one = A.save_sequence(lib, text("acgt"), "first")
    A.save_sequence(lib, text("ACGT!"), "one", edit=one)
    A.save_sequence(lib, text(">a\nac-t\n>b\nacgt"), "many")
    try:
        A.save_sequence(lib, text(" \n"), "none")
        said = "stored"
    except ValueError as e:
        said = str(e)
    got = lib.documents().join(lib.table("rows").where("idx = 0").select(F.col("doc_id").alias("id"), "data"), "id").select("name", "kind", F.col("n_rows").alias("n"), F.col("data").alias("first"))
    return got.unionByName(spark.createDataFrame([("none", said, None, None)], got.schema))


@query(
    "H71_H72_links",
    """WITH s AS (SELECT s_suppkey % 20 AS k, s_suppkey FROM supplier), n AS (SELECT k, count(*) AS n FROM s GROUP BY k)
    SELECT 'run' || k AS name, CASE WHEN k % 2 = 0 THEN 'Paired' ELSE 'Single' END AS layout, CASE WHEN k % 2 = 0 THEN 2 * n ELSE n END AS records, CAST(100 + k AS INTEGER) AS width, CASE WHEN k % 2 = 0 THEN 'run' || k || '_R1.fq:missing,run' || k || '_R2.fq:missing' ELSE 'run' || k || '.fq:missing' END AS files FROM n""",
)
def h71(spark, d):
    """A set of files for each of 20 groups of suppliers; none of the files is there."""
    k = F.col("s_suppkey") % 20
    n = table(spark, d, "supplier").groupBy(k.alias("k")).agg(F.count("*").alias("n"))
    names = F.when(F.col("k") % 2 == 0, F.array(F.lit("_R1"), F.lit("_R2"))).otherwise(F.array(F.lit("")))
    scans = n.select(F.explode(names).alias("mate"), "k", "n").select(F.concat(F.lit("/nowhere/reads/run"), "k", "mate", F.lit(".fq")).alias("path"), F.col("n").alias("records"), (100 + F.col("k")).cast("int").alias("width"), F.lit(9).cast("long").alias("size"), F.lit(None).cast("long").alias("modified"), F.lit("x").alias("digest"))
    lib = _library(spark)
    ids = A.link(lib, E.propose(scans.select("path")), scans)
    files = A.check_links(lib, ids).groupBy("set").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat(S.file_name(F.col("path")), F.lit(":"), "state").alias("t")))), lambda x: x["t"]), ",").alias("files"))
    about = lib.table("linked").select(F.col("doc_id").alias("set"), F.from_json("data", "name string, layout string, summary struct<records: long, width: int>").alias("d"))
    return about.join(files, "set").select("d.name", "d.layout", "d.summary.records", "d.summary.width", "files")


@query("H75_save_report", "SELECT 'report' AS name, 'Text' AS kind, 'PRIMER SEARCH RUN' AS head")
def h75(spark, d):
    lib = _library(spark)
    id_ = A.save_report(lib, "report", f"{A.TITLE}\nmore")
    return lib.documents().select("name", "kind", F.lit(lib.text(id_).split("\n")[0]).alias("head"))
