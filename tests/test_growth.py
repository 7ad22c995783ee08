"""Steps whose work has to grow with the input: results stay, and tasks share the work."""

import numpy as np
from pyspark.sql import functions as F

from colonnade.functions import numeric as N
from colonnade.functions import sequence as S
from colonnade.operators import actions as A
from colonnade.operators import columns as C
from colonnade.operators import library as B
from colonnade.operators import reads as E
from colonnade.operators import rows as R
from colonnade.operators import search as Q
from colonnade.operators import words as K
from colonnade.plans import fixtures as X
from colonnade.plans import all_queries, more_queries, queries, registry  # noqa: F401
from colonnade.sources.shared import spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def small(spark, path, n, **columns):
    """A table of n rows in one file."""
    spark.range(0, n, 1, 1).select(*(F.expr(v).alias(k) for k, v in columns.items())).write.parquet(str(path))


def test_spread_deals_rows_of_one_file(spark, tmp_path):
    small(spark, tmp_path / "t", 100, k="id")
    got = spread(spark.read.parquet(str(tmp_path / "t")), "k", share=10)
    assert got.rdd.getNumPartitions() == 10 and got.distinct().count() == 100
    assert spread(got.where("k < 0"), "k").rdd.getNumPartitions() == 1


def test_fixture_is_dealt_over_tasks(spark, tmp_path):
    small(spark, tmp_path / "customer.parquet", 25_000, c_custkey="id", c_mktsegment="'A'", c_nationkey="id % 25")
    got = X.derived(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 2
    row = got.where("idx = 24").first()
    digits = spark.range(1).select(F.concat(*(F.md5(F.lit(f"23:{i}")) for i in range(4)))).first()[0]
    cell = lambda x: "-" if digits[x] == "f" and x % 7 == 0 else X.REFERENCE[x].translate(str.maketrans("ACGT", "CGTA")) if digits[x] == "e" else "N" if digits[x] == "d" and x % 11 == 0 else X.REFERENCE[x]
    raw = "".join(map(cell, range(3, X.WIDTH)))
    assert (row["start"], row["data"]) == (3 + len(raw) - len(raw.lstrip("-")), raw.strip("-"))


def test_melting_range_is_dealt_over_tasks(spark, tmp_path):
    small(spark, tmp_path / "customer.parquet", 25_000, c_custkey="id")
    assert registry.QUERIES["F04_F05_tm_range"](spark, str(tmp_path)).rdd.getNumPartitions() > 2
    seqs = spark.createDataFrame([("ACGTRACGTY",), ("AAAAAAAA",), ("AC",), ("A",), ("AC-GT",), ("AAZ",)], "s string")
    got = [r["t"] for r in seqs.select(N.tm_range(F.col("s")).alias("t")).collect()]
    each = [r["t"] for r in spark.createDataFrame([(a + b,) for a in ("ACGTAACGT", "ACGTGACGT") for b in "CT"], "s string").select(N.tm(F.col("s")).alias("t")).collect()]
    assert (got[0]["lo"], got[0]["hi"]) == (min(each), max(each))
    assert [x is None for x in got] == [False, False, False, True, False, True]
    pairs = seqs.where("s = 'AAAAAAAA'").select(N.dinucleotides(F.col("s"), "AA").alias("n")).first()["n"]
    assert pairs == 7
    assert seqs.where("s = 'ACGTRACGTY'").select(F.size(S.expand(F.col("s"))).alias("n")).first()["n"] == 4


def test_one_prefix_with_many_files(spark):
    """Endings of a prefix are not gathered beside each of its files."""
    paths = [f"/d/FAX_pass_x_{i}.fastq" for i in range(500)] + ["/d/S_1.fq", "/d/S_2.fq", "/d/T_1.fq", "/d/U_1.fq", "/d/U_2.fq", "/d/U_3.fq"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert "Window" not in plan(E.propose(df))
    got = {r["name"]: (r["layout"], len(r["files"])) for r in E.propose(df).collect()}
    assert got["FAX_pass_x"] == ("Single", 500) and got["S"] == ("Paired", 2) and got["T_1"] == ("Single", 1) and got["U_1"] == ("Single", 1)


def test_copy_is_counted_as_sql_does(spark, tmp_path):
    small(spark, tmp_path / "customer.parquet", 9_100, c_custkey="id", c_mktsegment="'A'", c_nationkey="id % 25")
    got = registry.QUERIES["M15_M16_copy_of_rows"](spark, str(tmp_path))
    assert got.select("doc").distinct().first()["doc"] == "all [1011 sequences]"


def test_row_track_has_no_shuffle_of_cells(spark):
    rows = spark.createDataFrame([(1, 0, "a", "", 0, "ACGT", []), (1, 1, "b", "", 2, "-CTA", []), (2, 3, "c", "", 1, "ACC", []), (1, 4, "d", "", 1, "-GT", []), (1, 5, "e", "", 0, "", [])], R.ROWS)
    got = C.row_track(rows, 2, 0)
    assert "posexplode" not in plan(got) and "dealt" in plan(got) and "dealt" in plan(C.row_identity(rows, 0))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0, "same"), (1, 0, 1, "same"), (1, 1, 1, "C"), (1, 1, 2, "T"), (1, 4, 0, "-"), (1, 4, 1, "same"), (2, 3, 0, "A"), (2, 3, 1, "C")]


def test_lanes_hold_one_document(spark):
    """No group is gathered in pandas; documents are told apart also where they touch."""
    rng = np.random.default_rng(5)
    spans = [(int(d), i, int(s), int(s) + int(n)) for i, (d, s, n) in enumerate(zip(rng.integers(0, 9, 300), rng.integers(0, 40, 300), rng.integers(1, 30, 300), strict=True))]
    got = B.lanes(spark.createDataFrame(spans, "doc_id long, id long, start int, end int"), 3)
    assert "FlatMapGroupsInPandas" not in plan(got)
    want = {}
    for d in range(9):
        free = []
        for _, i, s, e in sorted((x for x in spans if x[0] == d), key=lambda x: (x[2], x[3], x[1])):
            k = next((j for j, f in enumerate(free) if f <= s), None)
            if k is None:
                k = min(len(free), 2)
                if len(free) < 3:
                    free.append(e)
            free[k] = max(free[k], e)
            want[i] = (d, k)
    assert {r["id"]: (r["doc_id"], r["lane"]) for r in got.collect()} == want


def test_quality_track_has_no_shuffle(spark):
    reads = spark.createDataFrame([("f", 1, [10, 11, 12, 40, 40]), ("f", 2, []), ("g", 3, [5])], "file string, read_no long, quals array<int>")
    got = C.quality_track(reads, 3)
    assert "Exchange" not in plan(got)
    assert sorted(tuple(r) for r in got.collect()) == [("f", 1, 0, 11), ("f", 1, 1, 40), ("g", 3, 0, 5)]


def test_kinds_of_words_without_a_shuffle(spark):
    seqs = [(1, "ACGTACGTN"), (2, "AC"), (3, "NNACGACG"), (4, "AAAAA"), (5, "")]
    df = spark.createDataFrame(seqs, "id int, seq string")
    got = K.kinds(df, 3)
    assert "Exchange" not in plan(got)
    want = K.words(df, 3).groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("word").alias("kinds"), F.min("pos").alias("first"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, 6, 4, 0), (3, 4, 3, 2), (4, 3, 1, 0)]


def test_windows_are_those_of_search(spark):
    rows = spark.createDataFrame([(1, 0, "a", "", 2, "AC-GTNACRT", []), (1, 1, "b", "", 0, "TTT", [])], R.ROWS)
    got = Q.windows(rows, "ACRT", 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, Q.search(rows, "ACRT", 1).collect()))


def test_queries_of_customers_are_dealt_over_tasks(spark, tmp_path):
    small(spark, tmp_path / "customer.parquet", 25_000, c_custkey="id")
    assert more_queries.reads(spark, str(tmp_path)).rdd.getNumPartitions() > 2 and more_queries.records(spark, str(tmp_path)).rdd.getNumPartitions() > 2
    assert queries.f03(spark, str(tmp_path)).rdd.getNumPartitions() > 2


def test_features_keep_their_order(spark):
    part = F.array(F.struct((F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 10).cast("int").alias("end")))
    got = A.ordered_features(spark.range(1, 6).select((F.col("id") % 2).alias("doc_id"), "id", part.alias("parts")))
    assert sorted((r["doc_id"], r["ord"], r["id"], r["lane"]) for r in got.collect()) == [(0, 1, 2, 0), (0, 2, 4, 0), (1, 1, 1, 0), (1, 2, 3, 0), (1, 3, 5, 0)]


def test_short_templates_are_placed_on_together(spark):
    """Templates that lie one after another give what each gives alone, and no place crosses from one into the next."""
    whole = "ACGTTGCAAGCTAGGCTTACCGATAGGC"
    rows = [(1, 3, "AC-GTTGCAAGCTAGG"), (2, 0, "CTTACCGATAGGC"), (3, 5, whole), (4, 0, whole.replace("A", "R")), (5, 2, "N" * 30), (6, 1, ""), (7, 0, Q.revcomp(whole) + whole), (8, 0, "ACGTTGCAAGCTNGGCTTACCGATAGG")]
    oligos = spark.createDataFrame([("all", whole), ("part", whole[2:20]), ("short", "GGC"), ("any", "ACNTTGCRAG")], "name string, oligo string")
    templates = spark.createDataFrame(rows, "doc_id long, start int, data string").coalesce(1)
    alone = [tuple(r) for row in rows for r in Q.best_placement(spark.createDataFrame([row], templates.schema), oligos, 2).collect()]
    got = [tuple(r) for r in Q.best_placement(templates, oligos, 2).collect()]
    assert sorted(got) == sorted(alone) and len(got) > 8
    place = Q.Seeds([(0, 0, "ACGTTGCA"), (1, 0, "GC")], 1).places(b"ACGTTG\nACGTTGCAA\n", np.array([0] * 6 + [-1] + [1] * 9 + [-1]))
    assert [(o, p) for o, p in zip(place[0].tolist(), place[1].tolist()) if o == 0] == [(0, 7)]
