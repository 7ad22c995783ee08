"""Read sets: per-file scans, summaries, pairing of files, technology and samples."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import sequence as S
from . import rows as R

PREVIEW_READS = 1000
PREVIEW_SEQUENCES, PREVIEW_BASES = 100_000, 100_000_000


def record_counts(seq: Column) -> dict[str, Column]:
    """Counts of one sequence: A, C, G, T, other bases, its length in bases, and its width with gaps."""
    up = F.upper(seq)
    bases = F.regexp_replace(up, r"[-.~ \t\n\f\r0-9*]", "")
    n = {b: S.occurrences(up, b) for b in "ACG"} | {"T": S.occurrences(up, "T") + S.occurrences(up, "U")}
    return {f"n_{b.lower()}": c for b, c in n.items()} | {"n_other": F.length(bases) - sum(n.values(), F.lit(0)), "bases": F.length(bases), "width": F.length(seq), "gapped": seq.rlike("[-.~]")}


def quality_sum(qual: Column) -> Column:
    """Sum of Phred qualities, each at least 0."""
    return F.aggregate(F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.greatest(F.ascii(c) - 33, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)


def scan(reads: DataFrame) -> DataFrame:
    """One row a file: records, counts, quality sum, widths, and first headers. names: an order-sensitive hash of read names."""
    c = record_counts(F.col("seq"))
    each = reads.select("file", "read_no", "head", *(v.alias(k) for k, v in c.items()), (quality_sum(F.col("qual")) if "qual" in reads.columns else F.lit(0).cast("long")).alias("quality"))
    # position and name of every read enter a sum, which any order of partial aggregation gives alike
    named = F.sum(F.xxhash64("read_no", S.mate_name(S.read_id(F.col("head")))).cast("decimal(38,0)"))
    total = lambda k: F.sum(k).cast("long").alias(k)
    return each.groupBy("file").agg(
        F.count("*").alias("records"), *(total(f"n_{b}") for b in "acgt"), total("n_other"), total("bases"), total("quality"), F.min("bases").alias("min_len"), F.max("bases").alias("max_len"), F.min("width").alias("min_width"), F.max("width").alias("max_width"), F.bool_or("gapped").alias("gapped"),
        (named % F.lit(10**18)).cast("long").alias("names"), F.transform(F.array_sort(F.collect_list(F.when(F.col("read_no") < 50, F.struct("read_no", "head")))), lambda x: x["head"]).alias("heads"),
    )


def length_histogram(reads: DataFrame, by: str = "file") -> DataFrame:
    return reads.groupBy(by, record_counts(F.col("seq"))["bases"].alias("len")).agg(F.count("*").alias("n"))


def n50(histogram: DataFrame, by: str = "file") -> DataFrame:
    """Length at which reads that long or longer hold half of all bases; 0 for nothing. Works on distinct lengths only."""
    w = Window.partitionBy(by).orderBy(F.desc("len"))
    mass = histogram.withColumn("mass", F.col("len") * F.col("n")).withColumn("upto", F.sum("mass").over(w)).withColumn("total", F.sum("mass").over(Window.partitionBy(by)))
    return mass.groupBy(by).agg(F.coalesce(F.max(F.when((F.col("total") > 0) & (2 * F.col("upto") >= F.col("total")), F.col("len"))), F.lit(0)).cast("long").alias("n50"))


def summarize(scans: DataFrame, histogram: DataFrame, fastq: bool = True, by: str = "set") -> DataFrame:
    """Totals of sets: scans and histogram (set, len, n) carry the set of each file."""
    acgt = sum((F.sum(f"n_{b}") for b in "cgt"), F.sum("n_a"))
    bases = F.sum("bases")
    aligned = F.lit(not fastq) & (F.bool_or("gapped") | ((F.sum("records") > 1) & (F.min("min_width") == F.max("max_width"))))
    out = scans.groupBy(by).agg(
        F.sum("records").alias("records"), bases.alias("bases"), F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"), F.max("max_width").alias("width"), (F.when(bases > 0, F.sum("quality") / bases) if fastq else F.lit(None).cast("double")).alias("mean_quality"),
        F.coalesce(100.0 * (F.sum("n_c") + F.sum("n_g")) / F.nullif(acgt, F.lit(0)), F.lit(0.0)).alias("gc_percent"), F.coalesce(100.0 * F.sum("n_other") / F.nullif(bases, F.lit(0)), F.lit(0.0)).alias("n_percent"), aligned.alias("aligned"),
    )
    return out.join(n50(histogram.groupBy(by, "len").agg(F.sum("n").alias("n")), by), by)


def technology(heads: Column, records: Column, max_len: Column, n50_: Column) -> Column:
    """Nanopore, Illumina or Unknown from read headers, else from lengths."""
    nano = F.exists(heads, lambda h: F.contains(h, F.lit("runid=")) | F.contains(h, F.lit("start_time=")) | S.is_uuid(S.read_id(h)))
    illumina = (F.size(heads) > 0) & F.forall(heads, lambda h: S.occurrences(S.read_id(h), ":") >= 4)
    return F.when(nano, "Nanopore").when(illumina, "Illumina").when(records == 0, "Unknown").when(max_len <= 600, "Illumina").when(n50_ >= 1000, "Nanopore").otherwise("Unknown")


def pair_problems(scans: DataFrame) -> DataFrame:
    """Pairs (set, lane; roles R1 and R2) whose read numbers or read names differ."""
    one = lambda role: scans.where(F.col("role") == role).select("set", "lane", F.col("file").alias(f"file{role[-1]}"), F.col("records").alias(f"n{role[-1]}"), F.col("names").alias(f"names{role[-1]}"))
    both = one("R1").join(one("R2"), ["set", "lane"], "full_outer")
    problem = F.when(F.col("n1").isNull() | F.col("n2").isNull(), "Paired files must come in R1/R2 pairs").when(F.col("n1") != F.col("n2"), "different numbers of reads").when(F.col("names1") != F.col("names2"), "read names do not match")
    return both.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("set", "lane", "file1", "file2", "problem")


def parsed_names(paths: DataFrame) -> DataFrame:
    """path, dir, stem, tokens, mate (R1, R2 or null) and mate_at (number of its token) of (path)."""
    stem = S.stem(F.col("path"))
    tokens = F.split(stem, "[_.]")
    upper = F.transform(tokens, lambda t: F.upper(t))
    at = F.array_max(F.filter(F.transform(upper, lambda t, i: F.when(t.isin("R1", "R2"), i)), lambda i: i.isNotNull()))
    each = paths.select("path", S.parent(F.col("path")).alias("dir"), stem.alias("stem"), tokens.alias("tokens"), at.alias("mate_at"))
    each = each.withColumn("mate", F.upper(F.try_element_at("tokens", F.col("mate_at") + 1)))
    # _1 and _2 are mates where a folder and prefix have exactly these two numeric endings
    last = F.element_at("tokens", -1)
    prefix = F.expr("left(stem, length(stem) - length(element_at(tokens, -1)))")
    plain = F.col("mate").isNull() & (F.size("tokens") > 1)
    each = each.withColumns({"plain": plain, "prefix": prefix, "last": last})
    # a group's endings are told apart by bounded sums; its mates alone are looked up, since a prefix may have any number of files
    ends = each.where(F.col("plain") & F.col("last").rlike("^[0-9]+$")).groupBy("dir", "prefix").agg(F.bool_and(F.col("last").isin("1", "2")).alias("only"), F.bool_or(F.col("last") == "1").alias("one"), F.bool_or(F.col("last") == "2").alias("two"))
    mates = ends.where("only and one and two").select("dir", "prefix", F.lit(True).alias("plain"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("last"), F.lit(True).alias("numbered"))
    each = each.join(mates, ["dir", "prefix", "plain", "last"], "left").withColumn("numbered", F.col("numbered").isNotNull())
    last = F.col("last")
    return each.withColumns({"mate": F.when(F.col("numbered"), F.concat(F.lit("R"), last)).otherwise(F.col("mate")), "mate_at": F.when(F.col("numbered"), F.size("tokens") - 1).otherwise(F.col("mate_at"))}).select("path", "dir", "stem", "tokens", "mate_at", "mate")


def _separators() -> Column:
    """The separator before each token of stem; the first has none."""
    return F.concat(F.array(F.lit("")), F.regexp_extract_all("stem", F.lit("([_.])"), 1))


def sample_name() -> Column:
    """Name without mate, lane and chunk tokens; expects the columns of parsed_names()."""
    number = lambda t: t.rlike("^[0-9]+$")
    nano = F.exists("tokens", lambda t: t.isin("pass", "fail", "runid"))
    last_text = F.array_max(F.transform("tokens", lambda t, i: F.when((i == 0) | ~number(t), i).otherwise(-1)))
    after = F.try_element_at("tokens", F.col("mate_at") + 2)
    chunk = F.coalesce(number(after) & (F.length(after) == 3), F.lit(False))

    def keep(z: Column, i: Column, of: Column) -> Column:
        gone = F.coalesce(i == F.col("mate_at"), F.lit(False)) | F.coalesce((i == F.col("mate_at") + 1) & of["chunk"], F.lit(False))
        return ~(gone | z["t"].rlike("^L[0-9]{3}$") | (of["nano"] & (i > of["last_text"])))

    pairs = F.arrays_zip(F.col("tokens").alias("t"), _separators().alias("s"))
    # what is known of the whole name is computed once, not for each token
    kept = N.let(F.struct(nano.alias("nano"), last_text.alias("last_text"), chunk.alias("chunk")), lambda of: F.filter(pairs, lambda z, i: keep(z, i, of)))
    name = F.array_join(F.transform(kept, lambda z, i: F.when(i == 0, z["t"]).otherwise(F.concat(z["s"], z["t"]))), "")
    return F.when(name == "", F.col("stem")).otherwise(name)


def mate_key() -> Column:
    """stem with its mate token blanked; expects the columns of parsed_names()."""
    pairs = F.arrays_zip(F.col("tokens").alias("t"), _separators().alias("s"))
    blank = F.array_join(F.transform(pairs, lambda z, i: F.concat(z["s"], F.when(i == F.col("mate_at"), F.lit("\u0000")).otherwise(z["t"]))), "")
    return F.when(F.col("mate_at").isNull(), F.col("stem")).otherwise(blank)


def common_name(names: list[str]) -> str:
    return os.path.commonprefix(names).rstrip("_.- ") if names else ""


def propose(paths: DataFrame, pair: bool = True, grouping: str = "BySample") -> DataFrame:
    """Read sets to make of files: name, dir, layout, files as array of (path, role), R1 and R2 of a pair side by side.

    Paired only if every file of a group has exactly one mate. grouping: BySample, Separate or Together.
    """
    each = parsed_names(paths.select("path").distinct())
    if not pair:
        each = each.withColumns({"mate": F.lit(None).cast("string"), "mate_at": F.lit(None).cast("int")})
    each = each.withColumns({"sample": sample_name(), "key": mate_key()})
    group = {"BySample": F.col("sample"), "Separate": F.col("key"), "Together": F.lit("")}[grouping]
    each = each.withColumns({"group": group, "folder": F.lit("") if grouping == "Together" else F.col("dir")})
    lanes = each.groupBy("folder", "group", "key").agg(F.count("*").alias("n"), F.count_if(F.col("mate") == "R1").alias("r1"), F.count_if(F.col("mate") == "R2").alias("r2"), F.min(F.struct("mate", "path")).alias("one"), F.max(F.struct("mate", "path")).alias("two"), F.array_sort(F.collect_list("path")).alias("paths"), F.min("sample").alias("name"))
    sets = lanes.groupBy("folder", "group").agg((F.lit(pair) & F.bool_and((F.col("r1") == 1) & (F.col("r2") == 1) & (F.col("n") == 2))).alias("paired"), F.array_sort(F.collect_list(F.struct("key", "one", "two"))).alias("pairs"), F.array_sort(F.flatten(F.collect_list("paths"))).alias("paths"), F.min("name").alias("name"))
    file = lambda p, role: F.struct(p.alias("path"), F.lit(role).alias("role"))
    files = F.when(F.col("paired"), F.flatten(F.transform("pairs", lambda p: F.array(file(p["one"]["path"], "R1"), file(p["two"]["path"], "R2"))))).otherwise(F.transform("paths", lambda p: file(p, "Single")))
    return sets.select("name", F.col("folder").alias("dir"), F.when(F.col("paired"), "Paired").otherwise("Single").alias("layout"), files.alias("files"))


def shows_all(fastq: Column, records: Column, bases: Column) -> Column:
    return F.when(fastq, records <= PREVIEW_READS).otherwise((records <= PREVIEW_SEQUENCES) & (bases <= PREVIEW_BASES))


def sample_size(paired: bool) -> int:
    return PREVIEW_READS // 2 if paired else PREVIEW_READS


def preview(reads: DataFrame, paired: bool = False) -> DataFrame:
    """The first reads (pairs) of each file."""
    return reads.where(F.col("read_no") < sample_size(paired))


def draw_key(seed: int, number: Column) -> Column:
    """What read numbers are drawn by: 60 bits of the MD5 of `seed:number`, which SQL can repeat."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), number.cast("string"))), 1, 15)


def draw(n: int, k: int, seed: int, spark: SparkSession) -> DataFrame:
    """(number): k numbers below n, each set of k being as likely; all of them if n <= k.

    The k least by key, and by number where keys are equal. Only keys below a bound that far more than k numbers are
    expected under are sorted; the bound rises in the rare case that fewer are.
    """
    numbers = spark.range(n).select(F.col("id").alias("number"))
    share = 4.0 * k / max(n, 1) + 64.0 / max(n, 1)
    while share < 1:
        bound = f"{int(share * 16**15):015x}"
        some = numbers.where(draw_key(seed, F.col("number")) < bound)
        if some.count() >= k:
            numbers = some
            break
        share *= 4
    return numbers.orderBy(draw_key(seed, F.col("number")), "number").limit(k)


def sample_numbers(spark: SparkSession, sources: list[tuple[list[str], int]], seed: int, paired: bool = False) -> DataFrame:
    """(file, read_no) of a sample over all sources in order: sources are (files read in step, number of reads)."""
    starts, rows = 0, []
    for files, n in sources:
        rows += [(f, starts, starts + n) for f in files]
        starts += n
    spans = spark.createDataFrame(rows, "file string, first long, after long")  # a row a file
    picks = draw(starts, sample_size(paired), seed, spark)
    return F.broadcast(picks).join(spans, (F.col("number") >= F.col("first")) & (F.col("number") < F.col("after"))).select("file", (F.col("number") - F.col("first")).alias("read_no"))


def sample(reads: DataFrame, sources: list[tuple[list[str], int]], seed: int, paired: bool = False) -> DataFrame:
    """A sample of reads (file, read_no) over all sources in order."""
    return reads.join(F.broadcast(sample_numbers(reads.sparkSession, sources, seed, paired)), ["file", "read_no"], "left_semi")  # at most 1,000


def sample_files(spark: SparkSession, index: str, sources: list[tuple[list[str], int]] | None, seed: int, paired: bool = False) -> DataFrame:
    """sample() from the files of an index of FASTQ ranges: of the files only the stretches of marks around chosen reads are read.

    Without sources each file is one of its own, in order.
    """
    from ..sources.blocks import ranges_of
    from ..sources.fastq import read_chosen

    if sources is None:
        totals: dict[str, int] = {}
        for r in ranges_of(index):
            totals[r["file"]] = totals.get(r["file"], 0) + r["records"]
        sources = [([f], n) for f, n in sorted(totals.items())]
    return read_chosen(spark, index, sample_numbers(spark, sources, seed, paired))


def link_problems(files: DataFrame, by: str) -> DataFrame:
    """How many files (status) of each set are missing and how many have changed."""
    return files.groupBy(by).agg(F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "changed").alias("changed"))


def read_rows(shown: DataFrame, mate: str = "") -> DataFrame:
    """Shown reads as rows, with their file and mate as metadata."""
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    meta = F.array(entry("Mate", F.lit(mate)), entry("File", S.file_name(F.col("file")))) if mate else F.array(entry("File", S.file_name(F.col("file"))))
    start, data = R.from_gapped(F.col("seq"))
    return shown.select(F.xxhash64("file").alias("doc_id"), F.col("read_no").cast("int").alias("idx"), "name", "description", start.alias("start"), data.alias("data"), meta.alias("meta"))


def reads_done(line: Column) -> Column:
    """Number in a progress line such as `read 2,000,000 pairs`; null for others."""
    said = F.regexp_extract(line, "^\\s*read ([0-9,]+) (?:reads|pairs)", 1)
    return F.when(said != "", F.replace(said, F.lit(","), F.lit("")).cast("long"))


def input_stats(rows: DataFrame) -> DataFrame:
    """Written rows with gaps, with ambiguous letters, and usable ones, in that order of precedence."""
    kind = F.when(F.contains("data", F.lit("-")), "gaps").when(F.col("data").rlike("[^ACGT]"), "ambiguous").otherwise("usable")
    return rows.groupBy("doc_id").agg(F.count("*").alias("written"), *(F.count_if(kind == k).alias(k) for k in ("gaps", "ambiguous", "usable")))


