"""Queries for files, read sets, records, mapping and library tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import columns as C
from ..operators import library as B
from ..operators import links, many_targets
from ..operators import mapper as M
from ..operators import reads as E
from ..operators import rows as R
from ..sources import fasta, genbank
from ..sources.shared import shared_dir, spread
from . import fixtures as X
from .queries import NORM, docs, table
from .registry import query

# ---- pasted text and descriptions ------------------------------------------------------------------------------------
_PASTE = "CASE WHEN doc_id % 3 = 0 THEN text ELSE '>' || replace(substr(text, 1, 30), chr(10), ' ') || chr(10) || text || chr(10) || '> b [x=1] [y= 2 ] z=3' || chr(10) || 'ACG-T' END"


def pasted_texts(spark, d):
    t = F.col("text")
    made = F.when(F.col("doc_id") % 3 == 0, t).otherwise(F.concat(F.lit(">"), F.replace(F.substring("text", 1, 30), F.lit("\n"), F.lit(" ")), F.lit("\n"), t, F.lit("\n> b [x=1] [y= 2 ] z=3\nACG-T")))
    return docs(spark, d).select(F.col("doc_id").alias("id"), made.alias("text"))


@query(
    "S05_pasted_records",
    f"""WITH p AS (SELECT doc_id AS id, text AS body, 1 AS n FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, text, 1 FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'ACG-T', 2 FROM documents WHERE doc_id % 3 <> 0)
    SELECT id, CAST(n AS INTEGER) AS n, {NORM.format('body')} AS seq FROM p WHERE id % 3 <> 0 OR {NORM.format('body')} <> ''""",
)
def s05(spark, d):
    return fasta.pasted(pasted_texts(spark, d)).select("id", "n", "seq")


@query("S07_description_metadata", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'host=' || o_orderpriority || ';status=' || o_orderstatus ELSE 'host=x;k=' || o_custkey END AS meta FROM orders")
def s07(spark, d):
    o = table(spark, d, "orders")
    desc = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("strain [host="), "o_orderpriority", F.lit("] a=b [ status = "), "o_orderstatus", F.lit(" ] [=q]"))).otherwise(F.concat(F.lit("=z host=x y= k="), "o_custkey"))
    m = fasta.description_meta(desc)
    return o.select(F.col("o_orderkey").alias("k"), F.array_join(F.transform(m, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("meta"))


# ---- read sets -------------------------------------------------------------------------------------------------------
_FILE = "'run' || (c_custkey % 4) || '_R' || (1 + c_custkey % 2) || '.fq'"
_READ = "translate(substr(md5(CAST(c_custkey AS VARCHAR)) || md5('x' || c_custkey), 1, CAST(10 + c_custkey % 50 AS INTEGER)), '0123456789abcdef', 'ACGTACGTACGTNNU-')"
_HEAD = "'M0:1:F:2:' || c_custkey || ':' || (c_custkey % 7) || '/1 x'"
READS_SQL = f"WITH reads AS (SELECT c_custkey AS read_no, {_FILE} AS file, {_READ} AS seq, {_HEAD} AS head, repeat(chr(CAST(33 + c_custkey % 40 AS INTEGER)), CAST(10 + c_custkey % 50 AS INTEGER)) AS qual FROM customer)"


def reads(spark: SparkSession, d: str) -> DataFrame:
    c = spread(table(spark, d, "customer").select(F.col("c_custkey").alias("read_no")), "read_no")
    n = F.col("read_no")
    length = (10 + n % 50).cast("int")
    seq = F.translate(F.substring(F.concat(F.md5(n.cast("string")), F.md5(F.concat(F.lit("x"), n))), F.lit(1), length), "0123456789abcdef", "ACGTACGTACGTNNU-")
    return c.select("read_no", F.concat(F.lit("run"), n % 4, F.lit("_R"), 1 + n % 2, F.lit(".fq")).alias("file"), seq.alias("seq"), F.concat(F.lit("M0:1:F:2:"), n, F.lit(":"), n % 7, F.lit("/1 x")).alias("head"), F.repeat(F.char(33 + n % 40), length).alias("qual"))


@query(
    "C23_C24_scan_files",
    READS_SQL + """ SELECT file, count(*) AS records, CAST(sum(length(seq) - length(replace(seq, 'A', ''))) AS BIGINT) AS n_a, CAST(sum(length(seq) - length(replace(replace(seq, 'T', ''), 'U', ''))) AS BIGINT) AS n_t, CAST(sum(length(seq) - length(replace(seq, 'N', ''))) AS BIGINT) AS n_other,
    CAST(sum(length(replace(seq, '-', ''))) AS BIGINT) AS bases, CAST(sum(length(qual) * (read_no % 40)) AS BIGINT) AS quality, CAST(min(length(replace(seq, '-', ''))) AS INTEGER) AS min_len, CAST(max(length(seq)) AS INTEGER) AS max_width, bool_or(contains(seq, '-')) AS gapped FROM reads GROUP BY file""",
)
def c24(spark, d):
    return E.scan(reads(spark, d)).select("file", "records", "n_a", "n_t", "n_other", "bases", "quality", "min_len", "max_width", "gapped")


@query("C26_n50", READS_SQL + ", l AS (SELECT file, length(replace(seq, '-', '')) AS len, count(*) AS n FROM reads GROUP BY ALL), m AS (SELECT *, sum(len * n) OVER (PARTITION BY file ORDER BY len DESC) AS upto, sum(len * n) OVER (PARTITION BY file) AS total FROM l) SELECT file, CAST(max(len) FILTER (2 * upto >= total) AS BIGINT) AS n50 FROM m GROUP BY file")
def c26(spark, d):
    return E.n50(E.length_histogram(reads(spark, d)))


@query(
    "C25_C27_R12_summary",
    READS_SQL + """, r AS (SELECT 'run' || substr(file, 4, 1) AS "set", *, replace(seq, '-', '') AS b FROM reads), l AS (SELECT "set", length(b) AS len, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT *, sum(len * n) OVER (PARTITION BY "set" ORDER BY len DESC) AS upto, sum(len * n) OVER (PARTITION BY "set") AS total FROM l)
    SELECT r."set", count(*) AS records, CAST(sum(length(b)) AS BIGINT) AS bases, round(sum(length(qual) * (read_no % 40))::DOUBLE / sum(length(b)), 6) AS mean_quality, round(100.0 * sum(length(b) - length(translate(b, 'CG', '')))::DOUBLE / sum(length(b) - length(replace(b, 'N', '')) * 0 - (length(b) - length(replace(b, 'N', '')))), 6) AS gc_percent,
    round(100.0 * sum(length(b) - length(replace(b, 'N', '')))::DOUBLE / sum(length(b)), 6) AS n_percent, (SELECT CAST(max(len) FILTER (2 * upto >= total) AS BIGINT) FROM m WHERE m."set" = r."set") AS n50 FROM r GROUP BY r."set\"""",
)
def c27(spark, d):
    r, of = reads(spark, d), F.substring("file", 1, 4)
    out = E.summarize(E.scan(r).withColumn("set", of), E.length_histogram(r).withColumn("set", of))
    return out.select("set", "records", "bases", F.round("mean_quality", 6).alias("mean_quality"), F.round("gc_percent", 6).alias("gc_percent"), F.round("n_percent", 6).alias("n_percent"), "n50")


@query("R04_technology", READS_SQL + " SELECT file, CASE WHEN file LIKE 'run0%' THEN 'Nanopore' ELSE 'Illumina' END AS technology FROM reads GROUP BY file")
def r04(spark, d):
    s = E.scan(reads(spark, d)).withColumn("heads", F.when(F.col("file").startswith("run0"), F.array(F.lit("x runid=1"))).otherwise(F.col("heads")))
    return s.select("file", E.technology(F.col("heads"), F.col("records"), F.col("max_len"), F.lit(0)).alias("technology"))


@query("J05_pair_check", READS_SQL + " SELECT count(DISTINCT substr(file, 1, 4)) AS problems FROM reads")
def j05(spark, d):
    s = E.scan(reads(spark, d)).select(F.substring("file", 1, 4).alias("set"), F.lit(0).alias("lane"), F.regexp_extract("file", "_(R[12])", 1).alias("role"), "file", "records", "names")
    return E.pair_problems(s).agg(F.count("*").alias("problems"))


@query("C29_input_stats", "SELECT count(*) AS written, count_if(contains(data, '-')) AS gaps, count_if(NOT contains(data, '-') AND regexp_matches(data, '[^ACGT]')) AS ambiguous, count_if(NOT regexp_matches(data, '[^ACGT]')) AS usable FROM rows")
def c29(spark, d):
    return E.input_stats(X.rows(spark, d)).drop("doc_id")


@query("R05_R07_preview", READS_SQL + " SELECT file, read_no, seq FROM reads WHERE read_no < 500")
def r05(spark, d):
    return E.preview(reads(spark, d), paired=True).select("file", "read_no", "seq")


def _files(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, F.concat(F.lit("S"), (k / 12).cast("int"), F.lit("_L00"), (k / 6).cast("int") % 2 + 1, F.lit("_R"), (k / 3).cast("int") % 2 + 1, F.lit("_001.fastq.gz")))
    kind = kind.when(k % 3 == 1, F.concat(F.lit("SRR"), (k / 6).cast("int"), F.lit("_"), (k / 3).cast("int") % 2 + 1, F.lit(".fq"))).otherwise(F.concat(F.lit("FAX_pass_x_"), k, F.lit(".fastq")))
    return table(spark, d, "orders").select(F.concat(F.lit("/data/d"), k % 3, F.lit("/"), kind).alias("path")).distinct()


@query(
    "R01_R03_J06_J07_propose",
    """WITH f AS (SELECT DISTINCT o_orderkey % 3 AS d, CASE o_orderkey % 3 WHEN 0 THEN 'S' || o_orderkey // 12 WHEN 1 THEN 'SRR' || o_orderkey // 6 ELSE 'FAX_pass_x' END AS name, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey // 6 % 2 + 1 ELSE 0 END AS lane, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey // 3 % 2 + 1 END AS mate, o_orderkey AS k FROM orders),
    g AS (SELECT *, CASE d WHEN 0 THEN name || '_L00' || lane || '_R' || mate || '_001.fastq.gz' WHEN 1 THEN name || '_' || mate || '.fq' ELSE name || '_' || k || '.fastq' END AS file, count(DISTINCT mate) OVER (PARTITION BY d, name, lane) = 2 AS whole FROM f),
    h AS (SELECT *, bool_and(whole) OVER (PARTITION BY d, name) AS paired FROM g)
    SELECT '/data/d' || d AS dir, name, CASE WHEN paired THEN 'Paired' ELSE 'Single' END AS layout, CAST(count(*) AS INTEGER) AS n, string_agg(CASE WHEN paired THEN 'R' || mate ELSE 'Single' END || ':' || file, ',' ORDER BY CASE WHEN paired THEN lane ELSE 0 END, CASE WHEN paired THEN mate ELSE 0 END, file) AS files FROM h GROUP BY d, name, paired""",
)
def r01(spark, d):
    p = E.propose(_files(spark, d))
    return p.select("dir", "name", "layout", F.size("files").alias("n"), F.array_join(F.transform("files", lambda f: F.concat(f["role"], F.lit(":"), S.file_name(f["path"]))), ",").alias("files"))


_DRAWN = """, f AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS i, n FROM (SELECT DISTINCT file, (SELECT count(*) FROM customer) AS n FROM reads)),
    d AS (SELECT i AS number FROM range((SELECT CAST(sum(n) AS BIGINT) FROM f)) t(i)), k AS (SELECT number FROM d ORDER BY substr(md5('7:' || number), 1, 15), number LIMIT 1000)"""


@query("U08_R06_sample", READS_SQL + _DRAWN + " SELECT r.file, r.read_no FROM k JOIN f ON number >= i * n AND number < (i + 1) * n JOIN reads r ON r.file = f.file AND r.read_no = number - i * n")
def u08(spark, d):
    """Numbers are drawn below the customers of each file; a file has those reads of which it is the file."""
    files = sorted(f"run{i % 4}_R{1 + i % 2}.fq" for i in range(4))
    n = table(spark, d, "customer").count()
    return E.sample(reads(spark, d), [([f], n) for f in files], 7)[["file", "read_no"]]


@query(
    "S18_U08_R06_R08_sample_files",
    READS_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY read_no) - 1 AS n FROM reads), f AS (SELECT file, count(*) AS size, sum(count(*)) OVER (ORDER BY file) - count(*) AS first FROM reads GROUP BY file),
    k AS (SELECT i AS number FROM range((SELECT count(*) FROM reads)) t(i) ORDER BY substr(md5('3:' || i), 1, 15), i LIMIT 1000)
    SELECT head, seq, qual FROM k JOIN f ON number >= first AND number < first + size JOIN o ON o.file = f.file AND o.n = number - first""",
)
def r06_files(spark, d):
    """Reads drawn from block-gzip files of which only the stretches with drawn reads are opened."""
    from uuid import uuid4

    from ..sources import blocks, fastq

    path = f"{shared_dir(spark)}/sampled-{uuid4().hex}"
    r = reads(spark, d)
    names = sorted(f"run{i}_R{1 + i % 2}.fq" for i in range(4))
    for i, name in enumerate(names):
        fastq.write_fastq(r.where(F.col("file") == name).repartitionByRange(1, "read_no").sortWithinPartitions("read_no"), f"{path}/{i}", member=2048)
    index = blocks.index(spark, fastq.files_in(path.removeprefix("file://")), fastq.FASTQ, 4096)
    return E.sample_files(spark, index, None, 3).select("head", "seq", "qual")


_WHERE = "CASE n_nationkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing' WHEN 2 THEN 'missing' WHEN 3 THEN 'changed' ELSE 'missing' END"


@query("R13_R14_R15_R16_R17_R18_J10_H20_moved_files", f"SELECT n_nationkey % 3 AS \"set\", n_nationkey AS idx, {_WHERE} AS state, CASE WHEN n_nationkey % 5 IN (1, 3) THEN 'new' ELSE 'old' END AS folder, n_nationkey % 5 IN (0, 1, 3) AS good FROM nation")
def r13(spark, d):
    """A file a nation: some stay, some move, some are gone, changed, or replaced by another of one size. One is found by hand; those beside it follow."""
    from uuid import uuid4

    root = f"{shared_dir(spark)}/moved-{uuid4().hex}"
    k = F.col("n_nationkey")
    content = F.repeat(F.concat(F.col("n_name"), F.lit("\n")), (k * 9000 + 1).cast("int"))
    n = table(spark, d, "nation").select(k.alias("k"), F.concat(F.lit("f"), k, F.lit(".fq")).alias("name"), content.alias("text"))
    place = lambda folder: F.concat(F.lit(f"{root}/{folder}/"), "name")
    written = lambda rows, folder: _written(rows.select(place(folder).alias("path"), "text"))
    written(n, "first")
    written(n.where("k % 5 = 0"), "old")
    written(n.where("k % 5 = 3").withColumn("text", F.concat("text", F.lit("more"))), "old")
    written(n.where("k % 5 in (1, 3)"), "new")
    written(n.where("k % 5 = 4").withColumn("text", F.translate("text", "AEIOU", "XXXXX")), "new")
    known = links.remembered(n.select(place("first").alias("path"))).withColumn("name", S.file_name(F.col("path")))
    files = n.select("k", "name").join(known, "name").select((F.col("k") % 3).alias("set"), F.col("k").cast("int").alias("idx"), place("old").alias("path"), "size", "modified", "digest")
    before = links.states(files).select("set", "idx", "state")
    after = links.relinked(files, 1, 1, f"{root}/new/f1.fq")
    good = links.states(after).select("set", "idx", F.element_at(F.split("path", "/"), -2).alias("folder"), (F.col("state") == "ok").alias("good"))
    return before.join(good, ["set", "idx"]).select("set", F.col("idx").cast("long").alias("idx"), "state", "folder", "good")


def _written(files: DataFrame) -> int:
    """Write texts (path, text) to files of their own; how many."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = pafs.FileSystem.from_uri(path)
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at, compression=None) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    return files.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


@query("C28_link_problems", "SELECT o_custkey AS k, count_if(o_orderstatus = 'F') AS missing, count_if(o_orderstatus = 'P') AS changed FROM orders GROUP BY o_custkey")
def c28(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "missing").when(F.col("o_orderstatus") == "P", "changed").otherwise("ok")
    return E.link_problems(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), status.alias("status")), "k")


# ---- records ---------------------------------------------------------------------------------------------------------
def flat_file(k, seq):
    """A flat file text of one record for a key column, with three features."""
    return F.concat(
        F.lit("LOCUS       R"), k, F.lit("  40 bp    DNA\nDEFINITION  record "), k, F.lit(".\nACCESSION   R"), k, F.lit("\nVERSION     R"), k, F.lit(".1\nFEATURES             Location/Qualifiers\n     source          1..40\n                     /organism=\"an organism\"\n     gene            "), k % 20 + 1, F.lit("..30\n                     /gene=\"g"), k,
        F.lit("\"\n     CDS             complement(join(2..5,"), k % 10 + 10, F.lit("..35))\n                     /product=\"a \"\"long\"\"\n                     name\"\nORIGIN\n        1 "), F.lower(seq), F.lit("\n//\n"),
    )


def records(spark, d):
    c = spread(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")
    seq = F.translate(F.substring(F.concat(F.md5(F.col("k").cast("string")), F.md5(F.col("k").cast("string"))), 1, 40), "0123456789abcdef", "ACGT" * 4)
    return genbank.records(c.select(F.col("k").cast("string").alias("path"), flat_file(F.col("k"), seq).alias("value")))


@query(
    "S13_S15_R27_genbank_records",
    """SELECT CAST(c_custkey AS VARCHAR) AS path, 'R' || c_custkey AS locus, 40 AS length, 'record ' || c_custkey AS definition, 'R' || c_custkey || '.1' AS version, translate(substr(md5(c_custkey::VARCHAR) || md5(c_custkey::VARCHAR), 1, 40), '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence,
    'accession=R' || c_custkey || '.1;organism=an organism' AS meta FROM customer""",
)
def s13(spark, d):
    return records(spark, d).select("path", "locus", "length", "definition", "version", "sequence", F.array_join(F.transform(genbank.record_meta(), lambda m: F.concat(m["key"], F.lit("="), m["value"])), ";").alias("meta"))


def features(spark, d):
    each = records(spark, d).select("path", F.posexplode("features").alias("i", "f"))
    return genbank.with_location(each.select("path", F.concat("path", F.lit("-"), "i").alias("id"), "i", "f.key", "f.location", "f.qualifiers"))


@query(
    "R19_R22_features",
    """WITH u AS (SELECT c_custkey AS k, unnest([0, 1, 2]) AS i FROM customer) SELECT k::VARCHAR AS path, CAST(i AS INTEGER) AS i, ['source', 'gene', 'CDS'][i + 1] AS key, CASE i WHEN 0 THEN 'an organism' WHEN 1 THEN 'g' || k ELSE 'a "long" name' END AS name, CAST(CASE i WHEN 2 THEN -1 ELSE 1 END AS INTEGER) AS strand,
    CASE i WHEN 0 THEN '0-40' WHEN 1 THEN (k % 20) || '-30' ELSE '1-5,' || (k % 10 + 9) || '-35' END AS parts FROM u""",
)
def r19(spark, d):
    return features(spark, d).select("path", "i", "key", genbank.feature_name().alias("name"), genbank.strand(F.col("loc")).alias("strand"), F.array_join(F.transform("loc.parts", lambda p: F.concat(p["start"], F.lit("-"), p["end"])), ",").alias("parts"))


_RC = "WITH rc AS (SELECT col, row_number() OVER (ORDER BY col) AS pos FROM cells WHERE idx = 7 AND base <> '-')"


@query(
    "R23_R24_J04_import_features",
    _RC + """, u AS (SELECT c_custkey AS k, unnest([0, 1, 2, 3]) AS j FROM customer), p AS (SELECT k, CASE j WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS i, CASE j WHEN 0 THEN 1 WHEN 1 THEN k % 20 + 1 WHEN 2 THEN 2 ELSE k % 10 + 10 END AS a, CASE j WHEN 0 THEN 40 WHEN 1 THEN 30 WHEN 2 THEN 5 ELSE 35 END AS b FROM u),
    s AS (SELECT k, i, string_agg(x.col || '-' || (y.col + 1), ',' ORDER BY a) AS parts FROM p JOIN rc x ON x.pos = a JOIN rc y ON y.pos = b GROUP BY ALL)
    SELECT k || '-' || i AS id, parts, CASE WHEN i = 1 AND k % 20 = 3 THEN 'already imported' ELSE 'new' END AS state, i <> 0 AND NOT (i = 1 AND k % 20 = 3) AS chosen FROM s""",
)
def r23(spark, d):
    at = C.reference_coords(X.rows(spark, d), 7).where("is_base").select("pos", "col")
    f = features(spark, d)
    first = genbank.import_items(f.where("path = '3' and i = 1"), 40, at, spark.createDataFrame([], "kind string, parts array<struct<start:int,end:int>>"))
    there = first.select(F.col("key").alias("kind"), "parts")
    out = genbank.import_items(f, 40, at, there)
    return out.select("id", F.array_join(F.transform("parts", lambda p: F.concat(p["start"], F.lit("-"), p["end"])), ",").alias("parts"), "state", "chosen")


@query("R25_R26_differing_bases", "SELECT c_custkey AS k, length(list_filter(range(40), lambda i: translate(substr(md5(c_custkey::VARCHAR) || md5(c_custkey::VARCHAR), 1, 40), '0123456789abcdef', 'ACGTACGTACGTACGT')[i + 1] <> '" + X.REFERENCE[:40] + "'[i + 1]))::INTEGER AS differing FROM customer")
def r25(spark, d):
    return genbank.usable(records(spark, d)).select(F.col("path").cast("long").alias("k"), genbank.differing(F.col("sequence"), F.lit(X.REFERENCE[:40])).alias("differing"))


# ---- mapping ---------------------------------------------------------------------------------------------------------
@query("P01_P02_P18_map_to_reference")
def p02(spark, d):
    r = X.rows(spark, d)
    turned = r.withColumn("data", F.when(F.col("idx") % 5 == 4, S.revcomp(F.col("data"))).otherwise(F.col("data")))
    contig, _, _ = M.map_to_reference(turned, 0, M.Params.preset("Highest", fine_tuning=1))
    return contig.select("idx", "start", "data", F.array_join(F.transform("meta", lambda m: F.concat(m["key"], F.lit("="), m["value"])), ";").alias("meta"))


_GENOME = "translate(array_to_string(list_transform(range(20), lambda i: md5('g' || n_nationkey || ':' || i)), ''), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_TURNED = "translate(reverse(s), 'ACGT', 'TGCA')"


def _complemented(text, places):
    """A text with the letters at some places, counted from 0, replaced."""
    letter = lambda s, i: F.translate(F.substring(s, i + 1, F.lit(1)), "ACGT", "CGTA")
    return F.aggregate(places, text, lambda s, i: F.overlay(s, letter(s, i), i + 1))


@query(
    "P02_P03_P04_map_to_many",
    f"""WITH g AS (SELECT n_nationkey AS target, {_GENOME} AS genome FROM nation),
    q AS (SELECT c_custkey AS id, c_nationkey AS target, CAST(c_custkey * 37 % 400 AS INTEGER) AS t_start, CAST(60 + c_custkey % 150 AS INTEGER) AS n FROM customer),
    s AS (SELECT id, target, t_start, n, substr(genome, t_start + 1, n) AS s, list_filter(range(12, n - 12), lambda i: i % 30 = id % 30) AS changed FROM q JOIN g USING (target))
    SELECT id, CAST(target AS BIGINT) AS target, t_start, id % 3 = 0 AS reverse, array_to_string(list_transform(range(n), lambda i: CASE WHEN list_contains(changed, i) THEN translate(s[i + 1], 'ACGT', 'CGTA') ELSE s[i + 1] END), '') AS aligned,
    CAST(n - len(changed) AS INTEGER) AS matches, CAST(len(changed) AS INTEGER) AS mismatches, 0 AS gaps FROM s""",
)
def p03(spark, d):
    """Pieces of 25 genomes with a change every 30 bases, a third of them reversed; each finds its genome and place."""
    digits = lambda n: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.md5(F.concat(F.lit("g"), n, F.lit(":"), i))), "")
    bases = F.translate(digits(F.col("n_nationkey")), "0123456789abcdef", "ACGTACGTACGTACGT")
    genomes = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), bases.alias("seq"))
    c = F.col("c_custkey")
    cut = spread(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select(c.alias("id"), F.col("c_nationkey").alias("n"), (c * 37 % 400).cast("int").alias("a"), (60 + c % 150).cast("int").alias("size"))
    own = cut.join(genomes.select(F.col("id").alias("n"), "seq"), "n").select("id", F.substring("seq", F.col("a") + 1, F.col("size")).alias("s"))
    changed = _complemented(F.col("s"), F.sequence(12 + F.pmod(F.col("id") - 12, F.lit(30)).cast("int"), F.length("s") - 13, F.lit(30)))
    own = own.select("id", changed.alias("text"))
    text = F.col("text")
    queries = own.select("id", F.when(F.col("id") % 3 == 0, S.revcomp(text)).otherwise(text).alias("seq"))
    found = many_targets.map_to_many(queries, genomes, M.Params.preset("Highest", min_aligned=20))
    return found.select("id", "target", "t_start", "reverse", "aligned", "matches", "mismatches", "gaps")


_REF = "".join(hashlib.md5(f"c{i}".encode()).hexdigest() for i in range(10)).translate(str.maketrans("0123456789abcdef", "ACGT" * 4))
_CUT = 160  # where some reads have five bases more, which fit neither neighbour
_MORE = "".join(next(b for b in "ACGT" if b not in (_REF[_CUT], _REF[_CUT - 1])) + x for x in ("C", "G", ""))


@query(
    "U01_P01_P14_P19_contig",
    f"""WITH q AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 100 AS INTEGER) AS a, CAST(120 + c_custkey % 100 AS INTEGER) AS n FROM customer),
    c AS (SELECT id, a, n, a + n >= 200 AND a <= 120 AND id % 4 = 0 AS more, list_filter(range(12, n - 12), lambda i: i % 30 = id % 30 AND abs(a + i - {_CUT}) > 14) AS changed FROM q),
    s AS (SELECT *, array_to_string(list_transform(range(n), lambda i: CASE WHEN list_contains(changed, i) THEN translate(substr('{_REF}', CAST(a + i + 1 AS INTEGER), 1), 'ACGT', 'CGTA') ELSE substr('{_REF}', CAST(a + i + 1 AS INTEGER), 1) END), '') AS s FROM c)
    SELECT 0 AS idx, 0 AS start, '{_REF[:_CUT]}{"-" * len(_MORE)}{_REF[_CUT:]}' AS data, NULL AS direction, NULL AS mismatches
    UNION ALL SELECT CAST(id + 1 AS INTEGER), a, CASE WHEN a + n > {_CUT} THEN substr(s, 1, {_CUT} - a) || CASE WHEN more THEN '{_MORE}' ELSE '{"-" * len(_MORE)}' END || substr(s, {_CUT} - a + 1) ELSE s END, CASE WHEN id % 3 = 0 THEN 'Reverse' ELSE 'Forward' END, CAST(len(changed) AS VARCHAR) FROM s""",
)
def p14(spark, d):
    """Pieces of one reference with changed and inserted bases, mapped with all rounds: rows of the contig, insertions in columns of their own."""
    c = F.col("c_custkey")
    q = spread(table(spark, d, "customer").select("c_custkey"), "c_custkey").select(c.alias("id"), (c * 37 % 100).cast("int").alias("a"), (120 + c % 100).cast("int").alias("n"))
    changed = F.filter(F.sequence(12 + F.pmod(F.col("id") - 12, F.lit(30)).cast("int"), F.col("n") - 13, F.lit(30)), lambda i: F.abs(F.col("a") + i - _CUT) > 14)
    text = _complemented(F.substring(F.lit(_REF), F.col("a") + 1, F.col("n")), changed)
    at = _CUT - F.col("a")
    more = (F.col("a") + F.col("n") >= 200) & (F.col("a") <= 120) & (F.col("id") % 4 == 0)
    text = F.when(more, F.concat(F.substring(text, F.lit(1), at), F.lit(_MORE), F.substring(text, at + 1, F.col("n")))).otherwise(text)
    reads_ = q.select("id", text.alias("t")).select("id", F.when(F.col("id") % 3 == 0, S.revcomp(F.col("t"))).otherwise(F.col("t")).alias("data"))
    none = F.array().cast(R.META)
    made = reads_.select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") + 1).cast("int").alias("idx"), F.lit("r").alias("name"), F.lit("").alias("description"), F.lit(0).alias("start"), "data", none.alias("meta"))
    first = spark.createDataFrame([(1, 0, "ref", "", 0, _REF, [])], R.ROWS)
    contig, _, _ = M.map_to_reference(first.unionByName(made), 0, M.Params.preset("High", fine_tuning=2))
    value = lambda key: F.when(F.col("idx") > 0, R.meta_value(key))
    return contig.select("idx", "start", "data", value("Direction").alias("direction"), value("Mismatches").alias("mismatches"))


@query(
    "P15_next_target",
    """WITH r AS (SELECT col, base FROM cells WHERE idx = 0), m AS (SELECT c.*, r.base, CASE WHEN n_a + n_c + n_g + n_t + n_gap = 0 THEN CASE WHEN r.base <> '-' THEN r.base WHEN n_other > 0 THEN 'N' END
    ELSE (SELECT arg_max(s, (k, (s = r.base)::INT, -i)) FROM (SELECT unnest([n_a, n_c, n_g, n_t, n_gap]) AS k, unnest(['A', 'C', 'G', 'T', '-']) AS s, unnest([0, 1, 2, 3, 4]) AS i)) END AS call FROM counts c JOIN r USING (col))
    SELECT string_agg(call, '' ORDER BY col) FILTER (call <> '-') AS target FROM m""",
)
def p15(spark, d):
    import numpy as np

    counts = np.zeros((X.WIDTH, 6), np.int64)
    for r in C.column_counts(X.rows(spark, d), 0).collect():
        counts[r["col"]] = [r[c] for c in C.COUNTS]
    return spark.createDataFrame([(M.next_target(counts, (0, X.REFERENCE.encode()))[0].decode(),)], "target string")


@query("W08_J12_layout", "WITH i AS (SELECT CAST(o_orderkey % 50 AS INTEGER) AS pos, max(o_custkey % 9) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), e AS (SELECT CAST(p AS INTEGER) AS pos, coalesce(n, 0) AS width FROM range(51) t(p) LEFT JOIN i ON i.pos = p) SELECT pos, width, CAST(pos + sum(width) OVER (ORDER BY pos) AS BIGINT) AS col FROM e")
def w08(spark, d):
    ins = table(spark, d, "orders").where("o_orderkey % 3 = 0").select((F.col("o_orderkey") % 50).cast("int").alias("pos"), (F.col("o_custkey") % 9).alias("n")).groupBy("pos").agg(F.max("n").alias("n")).collect()
    lay = M.layout_of(50, [(r["pos"], r["n"]) for r in ins])
    return spark.createDataFrame([(i, int(w), int(c)) for i, (w, c) in enumerate(zip(lay.widths, lay.column, strict=True))], "pos int, width long, col long")


# ---- library ---------------------------------------------------------------------------------------------------------
def folders(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") > 1, F.floor(F.col("s_suppkey") / 2)).alias("parent_id"), F.lit(False).alias("collapsed"))


@query("U04_folder_subtree", "WITH RECURSIVE f AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey > 1 THEN s_suppkey // 2 END AS parent FROM supplier), t AS (SELECT id FROM f WHERE id = 2 UNION ALL SELECT f.id FROM f JOIN t ON f.parent = t.id) SELECT id FROM t")
def u04(spark, d):
    return B.subtree(folders(spark, d), 2)


@query(
    "W04_W05_lanes",
    """WITH RECURSIVE o AS (SELECT o_custkey AS doc_id, o_orderkey AS id, CAST(o_orderkey % 120 AS INTEGER) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 120, o_orderkey) AS i FROM orders),
    r AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, 0::BIGINT AS id, [0, 0, 0, 0, 0, 0, 0, 0] AS free, 0 AS lane FROM o
      UNION ALL SELECT doc_id, i, id, list_transform(free, lambda f, j: CASE WHEN j = lane + 1 THEN greatest(f, s + 20) ELSE f END), lane FROM (SELECT r.doc_id, o.i, o.id, o.s, free, CASE WHEN list_min(free) <= s THEN CAST(list_position(list_transform(free, lambda f: f <= s), true) AS INTEGER) - 1 ELSE 7 END AS lane FROM r JOIN o ON o.doc_id = r.doc_id AND o.i = r.i + 1))
    SELECT doc_id, id, lane FROM r WHERE i > 0""",
)
def w04(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 120).cast("int").alias("start"), (F.col("o_orderkey") % 120 + 20).cast("int").alias("end"))
    return B.lanes(o)


@query("H33_H34_meta_json", "SELECT idx, CASE WHEN idx = 0 THEN '[]' ELSE '[[\"segment\",\"' || segment || '\"],[\"nation\",\"' || nation || '\"]]' END AS json FROM rows")
def h33(spark, d):
    return X.rows(spark, d).select("idx", B.meta_to_json(B.meta_from_json(B.meta_to_json(F.col("meta")))).alias("json"))


@query("S19_S20_library_round_trip", "SELECT idx, name, start, data, CAST(max(start + length(data)) OVER () AS INTEGER) AS width FROM rows WHERE idx % 2 = 0")
def s19(spark, d):
    from uuid import uuid4

    lib = B.Library(spark, f"{shared_dir(spark)}/library-{uuid4().hex}")
    id_ = lib.insert_document("all", "Alignment", X.rows(spark, d).where("idx % 2 = 0"), 0)
    info, rows, _ = lib.load(id_)
    return rows.select("idx", "name", "start", "data", F.lit(info["width"]).alias("width"))


_DEMO = """WITH n AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i FROM customer), bits AS (SELECT p, ('0x' || substr(md5('7:r:' || p), 1, 8))::BIGINT AS h, ('0x' || substr(md5('7:g:' || p // 800), 1, 8))::BIGINT % 2 = 0 AS rich FROM range(LENGTH) t(p)),
    ref AS (SELECT p, CASE WHEN rich AND h % 100 < 30 THEN CASE h // 100 % 2 WHEN 0 THEN 'G' ELSE 'C' END ELSE substr('ACGT', CAST(h // 200 % 4 AS INTEGER) + 1, 1) END AS b FROM bits),
    clade AS (SELECT c, p, b, ('0x' || substr(md5('7:c:' || c || ':' || p), 1, 8))::BIGINT AS h FROM ref, range(6) t(c)),
    changed AS (SELECT c, p, CASE WHEN h % 1000000 < 4000 + 4000 * c THEN substr(translate(b, 'ACGT', '0123'), 1, 1)::INTEGER + 1 + CAST(h // 1000000 % 3 AS INTEGER) ELSE strpos('ACGT', b) - 1 END % 4 AS x,
      ('0x' || substr(md5('7:i:' || c || ':' || p), 1, 8))::BIGINT AS e FROM clade),
    gapped AS (SELECT c, p, substr('ACGT', x + 1, 1) AS b, e % 1000000 < 60 AS del, CASE WHEN e % 1000000 BETWEEN 60 AND 119 THEN translate(substr(md5('7:s:' || c || ':' || p), 1, CAST(1 + e // 1000000 % 12 AS INTEGER)), '0123456789abcdef', 'ACGTACGTACGTACGT') ELSE '' END AS ins,
      CASE WHEN e % 1000000 < 60 THEN p + 1 + e // 1000000 % 9 END AS upto FROM changed),
    kept AS (SELECT c, string_agg(CASE WHEN p < coalesce(gone, 0) THEN '' WHEN upto IS NOT NULL THEN ins ELSE ins || b END, '' ORDER BY p) AS g FROM (SELECT *, max(upto) OVER (PARTITION BY c ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM gapped) GROUP BY c),
    own AS (SELECT i, ('0x' || substr(md5('7:n:' || i), 1, 8))::BIGINT AS h, ('0x' || substr(md5('7:m:' || i), 1, 8))::BIGINT AS m FROM n),
    of AS (SELECT *, CASE WHEN h % 100 < 35 THEN 0 WHEN h % 100 < 60 THEN 1 WHEN h % 100 < 75 THEN 2 WHEN h % 100 < 87 THEN 3 WHEN h % 100 < 95 THEN 4 ELSE 5 END AS c FROM own)"""


@query(
    "S23_S26_H16_demo_rows",
    _DEMO.replace("LENGTH", "1200") + """ SELECT CAST(i AS INTEGER) AS idx, 'GEN' || lpad(CAST(i AS VARCHAR), 5, '0') || '.1' AS name, substr('ABCDEF', c + 1, 1) AS clade, length(g) AS letters, length(g) - length(replace(g, 'G', '')) AS guanine, CAST(2005 + m % 20 AS INTEGER) AS year FROM of JOIN kept USING (c)
    UNION ALL SELECT 0, 'REF_genome', 'reference', 1200, (SELECT count(*) FROM ref WHERE b = 'G'), NULL""",
)
def s23(spark, d):
    """Genomes without noise of their own: as clades have them, with metadata."""
    g = demo(spark, 1200, table(spark, d, "customer").count(), noise=False)
    return g.select("idx", "name", R.meta_value("clade").alias("clade"), F.length("data").cast("long").alias("letters"), S.occurrences(F.col("data"), "G").cast("long").alias("guanine"), R.meta_value("year").cast("int").alias("year"))


_CLADES, _COUNTRIES = "ABCDEF", ("DE", "US", "BR", "IN", "ZA", "CN", "FR", "KE")  # fixed values of the demo data


def demo(spark: SparkSession, length: int, n: int, seed: int = 7, noise: bool = True) -> DataFrame:
    """A reference as row 0 and n genomes of six clades, all by hashes of their place: any row is made without the others.

    The reference has stretches rich in G and C. A clade changes, deletes and inserts bases; a genome has changes of its own,
    and some have a run of N, are partial, or are reversed. Weights and shares are those of the demo set.
    """
    h = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long")
    pick = lambda x: F.substring(F.lit("ACGT"), (x % 4).cast("int") + 1, F.lit(1))
    div = lambda x, y: F.floor(x / y)
    p = F.col("p")
    places = spark.range(0, length, 1, max(1, length // 5000)).select(F.col("id").alias("p"))
    r = h(F.lit("r"), p)
    rich = (h(F.lit("g"), div(p, 800)) % 2 == 0) & (r % 100 < 30)
    ref = places.select("p", F.when(rich, F.when(div(r, 100) % 2 == 0, "G").otherwise("C")).otherwise(pick(div(r, 200))).alias("b"))
    clades = ref.select("p", "b", F.explode(F.array(*(F.lit(c) for c in range(6)))).alias("c"))
    a, e = h(F.lit("c"), F.col("c"), p), h(F.lit("i"), F.col("c"), p)
    place = F.position(F.col("b"), F.lit("ACGT")) - 1
    b = F.when(a % 1_000_000 < 4000 + 4000 * F.col("c"), pick(place + 1 + div(a, 1_000_000) % 3)).otherwise(F.col("b"))
    more = F.translate(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("s"), F.col("c"), p)), F.lit(1), (1 + div(e, 1_000_000) % 12).cast("int")), "0123456789abcdef", "ACGTACGTACGTACGT")
    edited = clades.select("c", "p", b.alias("b"), F.when((e % 1_000_000 >= 60) & (e % 1_000_000 < 120), more).otherwise("").alias("ins"), F.when(e % 1_000_000 < 60, p + 1 + div(e, 1_000_000) % 9).alias("upto"))
    genomes = applied(edited)  # six rows
    i = F.col("i")
    own = spark.range(1, n + 1, 1, max(1, min(n // 50 + 1, 2 * spark.sparkContext.defaultParallelism))).select(F.col("id").alias("i"))
    u, m = h(F.lit("n"), i) % 100, h(F.lit("m"), i)
    clade = F.when(u < 35, 0).when(u < 60, 1).when(u < 75, 2).when(u < 87, 3).when(u < 95, 4).otherwise(5)
    each = own.withColumn("c", clade).join(F.broadcast(genomes), "c")
    if noise:
        each = each.withColumn("g", _noisy(h, pick, div))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    country = F.element_at(F.array(*(F.lit(x) for x in _COUNTRIES)), (div(m, 20) % 8).cast("int") + 1)
    letter = F.substring(F.lit(_CLADES), F.col("c") + 1, F.lit(1))
    year = (2005 + m % 20).cast("string")
    told = F.concat(F.lit("[clade="), letter, F.lit("] [country="), country, F.lit("] [year="), year, F.lit("]"))
    made = each.select(F.lit(1).cast("long").alias("doc_id"), i.cast("int").alias("idx"), F.concat(F.lit("GEN"), F.lpad(i.cast("string"), 5, "0"), F.lit(".1")).alias("name"), told.alias("description"), F.lit(0).alias("start"), F.col("g").alias("data"), F.array(entry("clade", letter), entry("country", country), entry("year", year)).alias("meta"))
    whole = ref.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "b"))), lambda x: x["b"]), "").alias("g"))
    first = whole.select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("idx"), F.lit("REF_genome").alias("name"), F.lit("synthetic reference").alias("description"), F.lit(0).alias("start"), F.col("g").alias("data"), F.array(entry("clade", F.lit("reference"))).alias("meta"))
    return first.unionByName(made)


def applied(edits: DataFrame) -> DataFrame:
    """(c, g): texts of the letters (c, p, b, ins, upto): ins comes before a letter, and what is from p to upto is deleted.

    Edits apply from left to right: those within what is deleted are passed over, insertions and deletions alike.
    """
    cuts = edits.where("upto is not null").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("p", "upto"))).alias("all"))
    none = F.array().cast("array<struct<p: long, upto: long>>")
    apart = F.aggregate("all", none, lambda kept, x: F.when((F.size(kept) > 0) & (x["p"] < F.element_at(kept, -1)["upto"]), kept).otherwise(F.concat(kept, F.array(x))))
    each = edits.join(F.broadcast(cuts.select("c", apart.alias("cuts"))), "c", "left").withColumn("cuts", F.coalesce("cuts", none))
    p = F.col("p")
    piece = F.when(F.exists("cuts", lambda x: (x["p"] < p) & (p < x["upto"])), "").otherwise(F.concat("ins", F.when(F.exists("cuts", lambda x: x["p"] == p), "").otherwise(F.col("b"))))
    return each.select("c", "p", piece.alias("piece")).groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "piece"))), lambda x: x["piece"]), "").alias("g"))


def _noisy(h, pick, div):
    """A genome with changes of its own: single bases, a run of N in 3 %, a part of it in 15 %, reversed in 10 %."""
    i, g = F.col("i"), F.col("g")
    # a block of 1,250 bases has one changed base: 0.0008 of all
    blocks = F.sequence(F.lit(0), F.floor((F.length("g") - 1) / 1250).cast("int"))
    at = lambda k: (h(F.lit("b"), i, k.cast("string")) % 1250).cast("int")
    piece = lambda k: F.substring(g, k * 1250 + 1, F.lit(1250))
    one = lambda k: F.when(at(k) < F.length(piece(k)), F.concat(F.substring(piece(k), F.lit(1), at(k)), pick(div(h(F.lit("b"), i, k.cast("string")), 1250)), F.substring(piece(k), at(k) + 2, F.lit(1250)))).otherwise(piece(k))
    out = F.array_join(F.transform(blocks, one), "")
    size, u, v = F.length(g), h(F.lit("u"), i), h(F.lit("v"), i)
    start, run = (v % size).cast("int"), F.least((20 + div(v, 7) % 200).cast("int"), (size - v % size).cast("int"))
    out = F.when(u % 100 < 3, F.concat(F.substring(out, F.lit(1), start), F.repeat(F.lit("N"), run), F.substring(out, start + run + 1, size))).otherwise(out)
    third = F.greatest(F.floor(size / 3), F.lit(1))
    low = (div(v, 11) % third).cast("int")
    high = F.least(F.greatest((size - div(v, 13) % third).cast("int"), low + 1000), size)
    out = F.when(div(u, 100) % 100 < 15, F.substring(out, low + 1, high - low)).otherwise(out)
    return F.when(div(u, 10_000) % 100 < 10, S.revcomp(out)).otherwise(out)


@query("C32_quality_track", READS_SQL + ", q AS (SELECT file, read_no, unnest(range(length(qual))) AS col, read_no % 40 AS q FROM reads) SELECT file, read_no, CAST(col // 7 AS INTEGER) AS bin, CAST((sum(q) + count(*) // 2) // count(*) AS INTEGER) AS q FROM q GROUP BY 1, 2, 3")
def c32(spark, d):
    r = reads(spark, d)
    quals = F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    return C.quality_track(r.select("file", "read_no", quals.alias("quals")), 7)
