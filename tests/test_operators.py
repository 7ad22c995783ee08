"""Literal cases with known results, and properties that hold for any input."""

import gzip

import pytest
from pyspark.sql import functions as F

from colonnade.functions import numeric as N
from colonnade.functions import sequence as S
from colonnade.operators import columns as C
from colonnade.operators import display as D
from colonnade.operators import library as B
from colonnade.operators import mapper as M
from colonnade.operators import oligo as O
from colonnade.operators import reads as E
from colonnade.operators import rows as R
from colonnade.operators import search as Q
from colonnade.sources import fasta, fastq, genbank


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows_of(spark, texts, metas=None, names=None):
    """Rows from gapped texts; gaps at the ends are no coverage."""
    out = []
    for i, t in enumerate(texts):
        body = t.strip("-")
        out.append((1, i, names[i] if names else f"s{i}", "", len(t) - len(t.lstrip("-")) if body else 0, body, metas[i] if metas else []))
    return spark.createDataFrame(out, R.ROWS)


def test_letters(spark):
    assert one(spark, S.normalize(F.lit("acgu. \n~?x-12"))) == "ACGT--NN-"
    assert one(spark, S.revcomp(F.lit("ACGTRN-"))) == "-NYACGT"
    assert one(spark, S.gc_percent(F.lit("GGCCAATT"))) == one(spark, S.gc_percent(F.lit("SSWW"))) == 50 and one(spark, S.gc_percent(F.lit(""))) == 0
    assert one(spark, S.expand(F.lit("ARY"), 100)) == ["AAC", "AAT", "AGC", "AGT"] and one(spark, S.expand(F.lit("NNNNN"), 100)) is None
    for i, b in enumerate(S.MASK_ORDER, 1):
        assert one(spark, S.mask(F.lit(b))) == i and one(spark, S.code(F.lit(i))) == b
    assert one(spark, S.mask(F.lit("-"))) == one(spark, S.mask(F.lit("Z"))) == one(spark, S.mask(F.lit(""))) == 0


def test_names(spark):
    assert [one(spark, S.stem(F.lit(p))) for p in ("/a/reads.fastq.gz", "x.fq", "b.GZ", "noext", ".hidden")] == ["reads", "x", "b", "noext", ".hidden"]
    assert one(spark, S.accession_in(F.lit("gi|12|MN908947.3| x"))) == "MN908947.3"
    assert [one(spark, S.valid_email(F.lit(m))) for m in ("a@b.c", "a@b", "@b.c", "a b@c.d", "a@.c", "a@b.")] == [True, False, False, False, False, False]
    assert one(spark, S.ellipsize_middle(F.lit("abcdefghij"), 5)) == "ab…ij" and one(spark, S.shorten(F.lit(" ab \ncd"), 9)) == "ab"


@pytest.mark.parametrize(
    ("oligo", "a", "b", "c"),
    [
        ("TGCTCGATGCTAGCTAGCTC", 59.404412, None, None), ("CCCCCATCCGATCAGGGGG", 63.840326, None, None), ("ACGTACGTACGTACGTAC", 53.713452, 57.655866, 53.466352), ("GGGGGGGGGGCCCCCCCCCC", 79.425446, 83.940241, 78.861769),
        ("ATATATATATATATATATAT", 30.791977, 34.690355, 30.305271), ("AGCTTGCAAGCTTGCA", 54.485419, 58.909188, 54.510770), ("TTGACCTGATCGGAATTCCA", 56.535221, 60.553669, 56.033170), ("GCGCAAATTTGCGCAT", 55.077538, 59.309059, 55.101802),
        ("CAGTCAGTTTGGGACCATAGG", 58.008750, 61.888345, 57.410889), ("ACCGTTAGCATTGACCAGTTGCAAT", 63.739508, 67.342774, 62.805888),
    ],
)
def test_melting_temperature(spark, oligo, a, b, c):
    for want, cond in ((a, {}), (b, {"oligo_nm": 250.0, "divalent_mm": 3.0, "dntp_mm": 0.8}), (c, {"oligo_nm": 200.0, "monovalent_mm": 100.0, "divalent_mm": 0.0, "dntp_mm": 0.0})):
        if want is not None:
            assert abs(one(spark, N.tm(F.lit(oligo), **cond)) - want) < 0.01


def test_tm_range(spark):
    r = one(spark, N.tm_range(F.lit("TGCTCGATGCTAGCTAGCTS")))
    assert r["lo"] < r["hi"] and one(spark, N.tm(F.lit("ACGN"))) is None and one(spark, N.tm(F.lit("A"))) is None
    assert one(spark, N.format_tm(F.lit(59.404), F.lit(59.41))) == "59.4 °C" and one(spark, N.format_tm(F.lit(None).cast("double"), F.lit(1.0))) == "–"


def test_labels(spark):
    assert [one(spark, N.size_label(F.lit(v))) for v in (830, 12_400_000, 1_270_000_000, 999_499, 999_500)] == ["830 bytes", "12.4 MB", "1.27 GB", "999 KB", "1.00 MB"]
    assert [one(spark, N.duration(F.lit(v))) for v in (4.2, 38.0, 252.0, 3900.0)] == ["4.2 s", "38 s", "4 min 12 s", "1 h 05 min"]
    color = N.parse_color(F.lit(" #0af"))
    assert one(spark, N.color_hex(color["r"], color["g"], color["b"])) == "#00AAFF" and one(spark, N.parse_color(F.lit("#12"))) is None
    assert one(spark, N.version(F.lit("primersearch 0.1.1\nx"))) == [0, 1, 1] and one(spark, N.version(F.lit("x v2.3"))) == [2, 3, 0] and one(spark, N.version(F.lit("none"))) is None
    assert one(spark, N.problem_label(F.lit(1), F.lit(1))) == "1 file missing, 1 changed" and one(spark, N.join_and(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b and c"


def test_terminal_gaps(spark):
    r = spark.createDataFrame([("--AC-G--",), ("----",)], "d string").select(*(c.alias(n) for c, n in zip(R.from_gapped(F.col("d")), ("start", "data"), strict=True))).collect()
    assert [tuple(x) for x in r] == [(2, "AC-G"), (0, "")]


def columns_by(df, *names):
    return {r["col"]: tuple(r[n] for n in names) for r in df.collect()}


def test_consensus(spark):
    rows = rows_of(spark, ["ACGT", "ACGA", "ACCA", "A-CA"])
    counts = C.column_counts(rows)
    assert columns_by(counts, *C.COUNTS)[0] == (4, 0, 0, 0, 0, 0)
    assert C.consensus(counts).first()["consensus"] == "ACSA" and C.consensus(counts, 100).first()["consensus"] == "ACSW"
    got = columns_by(counts.select("col", C.conservation(F.lit("A")).alias("a"), C.conservation(F.lit("T")).alias("t")), "a", "t")
    assert got[3] == (0.75, 0.25)
    assert sum(sum(v) for v in columns_by(counts, *C.COUNTS).values()) == 16


def test_gap_columns(spark):
    counts = C.column_counts(rows_of(spark, ["AAA", "A-A", "A-A", "A-A", "ACA"])).withColumn("state", C.majority_state())
    got = columns_by(counts.select("col", "state", C.identity(F.col("state")).alias("i"), C.conservation(F.col("state")).alias("c"), C.conservation(F.lit("A")).alias("a")), "state", "i", "c", "a")
    assert got[1] == ("-", 0.0, 0.0, 0.2)


def test_slice(spark):
    rows = rows_of(spark, ["ACGTAC", "AC-TAC", "--GTA-", "A-----"])
    got = {r["idx"]: (r["start"], r["data"]) for r in R.slice_rows(rows.where("idx <> 0"), 1, 5).collect()}
    assert got == {1: (0, "C-TA"), 2: (1, "GTA")}


def test_coordinates(spark):
    rows = rows_of(spark, ["AC--GT", "ACGTGTA"])
    coords = C.reference_coords(rows, 0)
    assert [r["pos"] for r in coords.orderBy("col").collect()] == [1, 2, 2, 2, 3, 4, 4]
    assert tuple(C.reference_range(coords, 1, 5).first())[1:] == (2, 3) and C.reference_range(coords, 2, 4).count() == 0
    m = C.column_map(coords.select("doc_id", "col", F.col("is_base").alias("keep"))).orderBy("col").collect()
    assert [r["col"] for r in m if r["shown"]] == [0, 1, 4, 5] and [r["disp"] for r in m] == [0, 1, 2, 2, 2, 3, 4]
    assert C.column_of(coords, 99).first()["col"] == 5 and tuple(C.columns_of(coords, 2, 3).first())[1:] == (1, 5)


def test_oligo_report(spark):
    rows = rows_of(spark, ["ACGTACGT", "ACGTACGT", "ACGTACGA", "TCGAACGT", "----ACGT", "ACG-ACGT"])
    for window, three in ((5, 3), (2, 1)):
        t = O.totals(O.evaluated(rows, O.Oligo("ACGTACGT", 0, 8, window=window), 0)).first()
        assert (t["sequences"], t["no_coverage"], t["mm0"], t["mm1"], t["mm2"], t["mm3"], t["three_prime"]) == (4, 1, 1, 2, 1, 0, three)
    o = O.Oligo("ACGTACGT", 0, 8, reverse=True)
    each = O.evaluated(rows_of(spark, ["ACGTACGT", "TCGTACGT"]), o, 0)
    assert O.totals(each).first()["three_prime"] == 1
    assert {r["position"]: r["mismatches"] for r in O.per_position(each, o).collect()}[7] == 1
    assert O.variants(each, o).first()["display"] == ".......A"


def test_search(spark):
    rows = rows_of(spark, ["AACG-TTGGG", "AACCCTTGGG"])
    got = {(r["idx"], r["c0"], r["c1"], r["reverse"]) for r in Q.search(rows, "CGTT").collect()}
    assert (0, 2, 7, False) in got and (0, 0, 4, True) in got
    assert [tuple(r) for r in Q.search(rows, "CCCN", both=False).collect()] == [(1, 1, 2, 6, False, 0)]
    a, b = (sorted(map(tuple, f(rows, "RNTT", 1).collect())) for f in (Q.search, Q.windows))
    assert a == b and Q.search(rows, " - ").count() == 0


def test_placement(spark):
    t = spark.createDataFrame([(1, 2, "GATTACAGG--CCTTAGACCNNNN"), (2, 0, "ACGTTTACGTTTTTCGTA")], "doc_id long, start int, data string")
    oligos = spark.createDataFrame([("a", "CAGGCCTT"), ("b", "GTAATC"), ("c", "ACCAAAA"), ("d", "ACGT")], "name string, oligo string")
    got = {(r["doc_id"], r["name"]): tuple(r)[2:] for r in Q.best_placement(t, oligos, 0).collect()}
    assert got[1, "a"][:3] == (7, 17, False) and got[1, "b"][:3] == (2, 8, True) and got[2, "d"] == (0, 4, False, 0, 1)
    assert (1, "c") not in {(r["doc_id"], r["name"]) for r in Q.best_placement(t.where("doc_id = 1"), oligos, 3).collect() if r["mismatches"] <= 2}


def test_serial_annotations(spark):
    t = spark.createDataFrame([(1, 0, "GATTACAGGCCTTAGACC")], "doc_id long, start int, data string")
    listed = [("", "GATTACA"), ("p", "GATTACA"), ("q", "GGTCTAA"), ("q", "ACAGG"), ("x", ""), ("y", "TTTTTTTTTTT"), ("old", "GATT"), ("", "ACAGG"), ("y", "GATT")]
    out = Q.serial_outcomes(listed, ["old", "Oligo 2"], t, 0)
    rows = [tuple(r) for r in out.orderBy("n").collect()]
    assert [r[1:3] for r in rows] == [("Oligo 3", "Placed"), ("p", "Placed"), ("q", "Placed"), ("q", "Duplicate"), ("x", "Empty"), ("y", "NotFound"), ("old", "NameExists"), ("Oligo 4", "Placed"), ("y", "Duplicate")]
    assert rows[2][3:] == (11, 18, True) and rows[5][3:] == (None, None, None)
    assert tuple(Q.not_placed(out).first()) == (1, 4)
    notes = {r["name"]: (r["kind"], r["note"]) for r in Q.serial_annotations(out, t).collect()}
    assert notes == {"Oligo 3": ("Forward primer", "GATTACA"), "p": ("Forward primer", "GATTACA"), "q": ("Reverse primer", "GGTCTAA"), "Oligo 4": ("Forward primer", "ACAGG")}
    jump = lambda t: one(spark, Q.jump(F.lit(t)))
    assert jump("12 - 7") == (7, 12) and jump("x") is None and jump("go 5") == (5, 5) and jump("1-2-3") == (1, 2)


@pytest.mark.parametrize("most", [0, 2, 3])
def test_seeded_places_equal_a_full_scan(spark, monkeypatch, most):
    import random

    rng = random.Random(most)
    made = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    base = made(300)
    texts = [base, base[:100] + "N" * 30 + base[100:200] + "---" + base[200:], made(250, "ACGTACGTACGTRYN"), made(90, "RYSWKM"), "ACG", "", base[::-1] + base, "".join("R" if i % 41 == 0 else b for i, b in enumerate(base))]
    templates = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)], "doc_id long, start int, data string")
    oligos = {}
    for i in range(80):
        a, n = rng.randrange(280), rng.choice([4, 9, 16, 20, 25, 60])
        o = list(base[a : a + n])
        for _ in range(rng.randrange(4)):
            o[rng.randrange(len(o))] = rng.choice("ACGTACGTRYNB")
        oligos[f"o{i}"] = Q.revcomp("".join(o)) if i % 3 == 0 else "".join(o)
    oligos |= {"none": "", "gap": base[:10] + "-" + base[10:20], "palindrome": "GAATTC", "n": "N" * 6}
    listed = spark.createDataFrame(list(oligos.items()), "name string, oligo string")
    for strand in ("both", "plus", "minus"):
        want = []
        for doc, text in enumerate(texts):
            masks, at = Q._bases(text.encode())
            for name, o in oligos.items():
                o = o.replace("-", "")
                if not o or len(o) > len(masks):
                    continue
                use = Q.strands(o) if strand == "both" else [(o, False)] if strand == "plus" else [(Q.revcomp(o), True)]
                wrong = {(int(m), i, reverse) for one, reverse in use for i, m in enumerate(Q.mismatches(masks, one, True))}
                least, i, reverse = min(wrong)
                if least <= most:
                    want.append((doc, name, doc % 3 + int(at[i]), doc % 3 + int(at[i + len(o) - 1]) + 1, reverse, least, sum(w[0] == least for w in wrong) - 1))
        monkeypatch.setattr(Q, "OLIGOS", rng.choice([10_000, 30]))
        assert sorted(map(tuple, Q.best_placement(templates, listed, most, strand).collect())) == sorted(want) and len(want) > 30


def test_kmers_and_anchors(spark):
    t = spark.createDataFrame([(0, "GATTATT")], "id int, seq string")
    q = spark.createDataFrame([(1, "TTAT")], "id int, seq string")
    want = [(0, 2), (0, 5), (1, 3), (2, 1), (2, 4)]
    assert sorted((r["qpos"], r["tpos"]) for r in Q.anchors(t, q, 2).collect()) == want
    assert [tuple(x) for x in M.anchors(M.word_index(b"GATTATT", 2, 0), b"TTAT", 2).tolist()] == want


def test_natural_order(spark):
    order = ["1.25", "1.5", "10", "a", "Seq_010", "seq_10", "seq_11"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(order)], "i int, s string").orderBy(F.rand(3))
    assert [r["s"].lower().replace("010", "10") for r in df.orderBy(D.natural_key(F.col("s")), "i").collect()] == ["1.25", "1.5", "10", "a", "seq_10", "seq_10", "seq_11"]


def test_display(spark):
    meta = lambda g: [("g", g)] if g else []
    rows = rows_of(spark, ["ACGT", "ACGT", "ACGT", "ACGA"], [meta(""), meta("x"), meta("x"), meta("")], ["ref", "b10", "b9", "a"])
    names = {1: "b10", 2: "b9", 3: "a"}
    show = lambda **o: [names.get(r["row"], r["label"]) for r in D.build(rows, D.Options(**o), 0).orderBy("ord").collect()]
    assert show(sort="Name") == ["a", "b9", "b10"] and show(sort="Name", descending=True) == ["b10", "b9", "a"]
    assert len(show(collapse=True)) == 2 and show(group_by="g", sort="Name") == ["(none)", "a", "x", "b9", "b10"]
    assert show(group_by="g", folded=["x"]) == ["(none)", "a", "x"] and show(name_filter="B1") == ["b10"]


def test_crop_and_lanes(spark):
    rows = rows_of(spark, ["---AC-G---", "------TAC-"])
    assert tuple(R.base_window(rows).first()) == (1, 3, 9)
    got = {r["idx"]: (r["start"], r["data"], r["change"]) for r in R.crop(rows, 3, 9).collect()}
    assert got == {0: (0, "AC-G", "Moved"), 1: (3, "TAC", "Moved")}
    spans = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 15), (1, 3, 10, 20)], "doc_id long, id long, start int, end int")
    assert [r["lane"] for r in B.lanes(spans).orderBy("id").collect()] == [0, 1, 0]
    assert [r["lane"] for r in B.lanes(spans, 1).orderBy("id").collect()] == [0, 0, 0]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a [host=human] [year=2019]\n--ACGT\nAC\n>b host=pig\nACACGTAC\n")
    got = fasta.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("idx").collect()
    assert [(r["name"], r["start"], r["data"]) for r in got] == [("a", 2, "ACGTAC"), ("b", 0, "ACACGTAC")]
    assert [tuple(m) for m in got[0]["meta"]] == [("host", "human"), ("year", "2019")] and [tuple(m) for m in got[1]["meta"]] == [("host", "pig")]
    assert R.alignment_kind(fasta.read_fasta(spark, str(tmp_path / "a.fa"))).first()["kind"] == "Alignment"
    (tmp_path / "b.bin").write_bytes(gzip.compress(b">x\nAC\n") + gzip.compress(b">y d\nGT\n"))
    assert [(r["name"], r["data"]) for r in fasta.read_fasta_bytes(spark, str(tmp_path / "b.bin")).orderBy("idx").collect()] == [("x", "AC"), ("y", "GT")]
    fasta.write_fasta(fasta.read_fasta(spark, str(tmp_path / "a.fa")), str(tmp_path / "out"))
    again = fasta.read_fasta(spark, str(tmp_path / "out"))
    assert sorted(r["data"] for r in again.collect()) == ["ACACGTAC", "ACGTAC"]
    limited = fasta.limited(fasta.read_fasta(spark, str(tmp_path / "a.fa")), 1, 100).collect()
    assert len(limited) == 1 and limited[0]["more"]


def test_pasted(spark):
    df = spark.createDataFrame([(1, "  1 acgtacgtac gtnnta\n 61 cgt"), (2, "AC-GJ?–T"), (3, ">x y\nAC\n>\nGT")], "id long, text string")
    got = {(r["id"], r["n"]): (r["name"], r["seq"], r["unknown"]) for r in fasta.pasted(df).collect()}
    assert got[1, 1][1] == "ACGTACGTACGTNNTACGT" and got[2, 1][1:] == ("AC-GNNNT", 2) and got[3, 1][:2] == ("x", "AC")
    names = {r["idx"]: r["name"] for r in fasta.pasted_document(fasta.pasted(df.where("id = 3")), "n", "d").collect()}
    assert names == {0: "x", 1: "Sequence 2"}


def test_meta_table(spark, tmp_path):
    (tmp_path / "m.csv").write_text('﻿name,"genotype","place, country"\na,"x ""y""","b, c"\n\nd,z\n')
    got = {(r["name"], r["key"]): r["value"] for r in fasta.read_meta_table(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {("a", "genotype"): 'x "y"', ("a", "place, country"): "b, c", ("d", "genotype"): "z", ("d", "place, country"): ""}


def test_fastq(spark, tmp_path):
    text = "@a/1 x\r\nACGT\r\nAC\r\n+\r\nIIII\r\nII\r\n\n@b\n\n+\n\n@c\nGG\n+c\n!I\n@d\nT\n+\nI"
    assert [(h, s) for h, s, _ in fastq.parse(iter(text.splitlines()))] == [("a/1 x", "ACGTAC"), ("b", ""), ("c", "GG"), ("d", "T")]
    for bad in ("x", "@a\nAC", "@a\nAC\n+\nI", "@a\nAC\n+\nIII"):
        with pytest.raises(ValueError):
            list(fastq.parse(iter(bad.splitlines())))
    (tmp_path / "r_R1.fastq.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "r_R2.fq").write_text(text)
    a = sorted(map(tuple, fastq.read_fastq(spark, str(tmp_path)).select("read_no", "seq", "qual").collect()))
    b = sorted(map(tuple, fastq.read_fastq_bytes(spark, str(tmp_path / "r_R1.fastq.gz")).select("read_no", "seq", "qual").collect()))
    assert len(a) == 8 and b == sorted(set(a))
    scan = E.scan(fastq.read_fastq(spark, str(tmp_path / "sub"))).first()
    assert (scan["records"], scan["bases"], scan["quality"]) == (4, 9, 40 * 6 + 0 + 40 + 40)
    assert fastq.trimmed(fastq.read_fastq(spark, str(tmp_path / "sub"))).where("read_no = 2").first()["quals"] == [0, 40]


def test_read_sets(spark):
    h = spark.createDataFrame([("f", 2, 3), ("f", 10, 1), ("f", 5, 2)], "file string, len long, n long")
    assert E.n50(h).first()["n50"] == 5
    paths = ["/d/A_S1_L001_R1_001.fastq.gz", "/d/A_S1_L001_R2_001.fastq.gz", "/d/A_S1_L002_R1_001.fastq.gz", "/d/A_S1_L002_R2_001.fastq.gz", "/d/SRR1_1.fastq", "/d/SRR1_2.fastq", "/d/FAX_pass_ab_0.fastq", "/d/FAX_pass_ab_1.fastq", "/d/FAX_pass_ab_2.fastq", "/d/x_R1.fq"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["name"]: (r["layout"], [f["role"] for f in r["files"]]) for r in E.propose(df).collect()}
    assert got == {"A_S1": ("Paired", ["R1", "R2"] * 2), "SRR1": ("Paired", ["R1", "R2"]), "FAX_pass_ab": ("Single", ["Single"] * 3), "x": ("Single", ["Single"])}
    assert len(E.propose(df, grouping="Separate").collect()) == 7 and E.propose(df, pair=False).where("layout = 'Paired'").count() == 0
    assert E.common_name(["run_1", "run_2"]) == "run"
    assert one(spark, E.reads_done(F.lit("read 2,000,000 pairs"))) == 2_000_000 and one(spark, E.reads_done(F.lit("wrote 2 reads"))) is None


def test_locations():
    parts = lambda t: [(p["start"], p["end"]) for p in genbank.parse_location(t)["parts"]]
    assert parts("5..9") == [(4, 9)] and parts("7") == [(6, 7)] and parts("<3..>8") == [(2, 8)] and parts("join(10..12,1..2)") == [(0, 2), (9, 12)]
    assert genbank.parse_location("complement(join(1..2,5..6))")["complement"] == 2 and genbank.parse_location("join(X1.1:3..4,5..6)")["remote"] == 1
    assert [genbank.parse_location(t) for t in ("", "0..3", "5..2", "join(1..2", "foo(1)")] == [None] * 5


def test_genbank_features():
    text = """skipped
LOCUS\tX1 40 bp DNA
DEFINITION\ta thing
            of two lines.
VERSION     X1.1
FEATURES             Location/Qualifiers
     source\t1..40
                     /organism="a ""b"" c
                     /not a key"
                     /pseudo
     CDS             join(1..5,
                     7..9)
                     /translation="MK
                     LV"
                     /note=no quotes
                     here
                     /product="open
ORIGIN
        1 acgt acgtn
LOCUS       Y2 7 aa
"""
    one, two = genbank.parse(text)
    assert [(f["key"], f["location"], [(q["key"], q["value"]) for q in f["qualifiers"]]) for f in one["features"]] == [
        ("source", "1..40", [("organism", 'a "b" c /not a key'), ("pseudo", "")]),
        ("CDS", "join(1..5,7..9)", [("translation", "MKLV"), ("note", "no quotes here"), ("product", "open")]),
    ]
    assert (one["locus"], one["definition"], one["version"], one["sequence"]) == ("X1", "a thing of two lines", "X1.1", "ACGTACGTN") and two["locus"] == "Y2" and two["features"] == []


def test_mapper_recovers_planted_changes():
    import random

    rng = random.Random(5)
    t = "".join(rng.choice("ACGT") for _ in range(3000))
    q = t[400:1000] + ("A" if t[1000] != "A" else "C") + t[1001:1500] + t[1503:2000] + "GATTA" + t[2000:2600]
    index = M.word_index(t.encode(), 13, 20)
    for text, reverse in ((q, False), (Q.revcomp(q), True)):
        a = M.map_query(text.encode(), t.encode(), index, 13, True, True)
        assert (a.reverse, a.t_start, a.t_end, a.mismatches) == (reverse, 400, 2600, 1)
        assert a.gaps == 8 and sum(len(b) for _, b in a.ins) == 5 and a.aligned.count(b"-") == 3
    assert M.map_query(b"ACGT" * 3, t.encode(), index, 13, True, True) is not None


def test_contig_merge():
    lay = M.layout_of(8, [(3, 2), (8, 1), (0, 1)])
    assert lay.width == 12
    a = M.Alignment(0, b"ACGTACGT", [(0, b"T"), (3, b"G")])
    assert lay.render(a) == (0, b"TACGG-TACGT") and lay.render(M.Alignment(2, b"GT-C", [])) == (3, b"G--T-C")


def test_next_target():
    import numpy as np

    counts = np.zeros((6, 6), np.int64)
    for row in ("ACC-TA", "AC--TA", "A-G-TA"):
        for i, b in enumerate(row):
            counts[i]["ACGT-".index(b)] += 1
    target, ref = M.next_target(counts, (0, b"ACG-TA"))
    assert target == b"ACGTA" and ref.aligned == b"ACGTA" and ref.ins == []


def test_map_to_reference(spark):
    import random

    rng = random.Random(9)
    t = "".join(rng.choice("ACGT") for _ in range(3000))
    ins = t[:1500] + "GATT" + t[1500:]
    rows = rows_of(spark, [t, ins, Q.revcomp(t), "".join(rng.choice("ACGT") for _ in range(800))])
    contig, unmapped, report = M.map_to_reference(rows, 0, M.Params.preset("Medium", fine_tuning=1))
    got = contig.orderBy("ord").collect()
    assert (report["mapped"], report["reverse"], report["width"]) == (2, 1, 3004) and [r["idx"] for r in got] == [0, 1, 2] and unmapped.first()["idx"] == 3
    assert got[0]["data"] == t[:1500] + "----" + t[1500:] and got[1]["data"] == ins
    assert ("Direction", "Reverse") in [tuple(m) for m in got[2]["meta"]]


def test_library(spark, tmp_path):
    lib = B.Library(spark, f"file://{tmp_path}/lib")
    id_ = lib.insert_document("d", "Alignment", rows_of(spark, ["ACGT", "A-GT", "ACG"]), 1)
    note = lib.add_annotation(id_, "p", "Region", 0, 4)
    lib.reorder_rows(id_, [2, 0, 1])
    info, rows, tracks = lib.load(id_)
    assert info["reference"] == 2 and [r["data"] for r in rows.collect()] == ["ACG", "ACGT", "A-GT"] and tracks.count() == 1
    lib.delete_rows(id_, [1, 2])
    info, rows, tracks = B.Library(spark, f"file://{tmp_path}/lib").load(id_)
    assert (info["n_rows"], info["width"], info["reference"]) == (1, 3, None) and tracks.count() == 0 and note == 1
    with pytest.raises(ValueError):
        lib.delete_rows(id_, [0])
    a = lib.create_folder("b")
    b = lib.create_folder("A", a)
    assert [r["name"] for r in lib.folders().collect()] == ["A", "b"] and sorted(lib.subtree(a)) == [a, b]
    with pytest.raises(ValueError):
        lib.move_folder(a, b)
    lib.move_document(id_, b)
    assert lib.folder_count(a) == 1
    lib.delete_folder(b)
    assert lib.document(id_)["folder_id"] == a
    lib.set_setting("k", "1")
    lib.set_setting("k", "2")
    assert lib.setting("k") == "2" and lib.setting("x") is None
    t = lib.insert_text("t", "words")
    assert lib.text(t) == "words"
    lib.delete_document(t)
    assert lib.document(t) is None
    copy = lib.insert_copy(id_, [0], "c")
    assert lib.load(copy)[1].count() == 1
    up = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id long, parent_id long")
    docs = spark.createDataFrame([(1, 1), (2, None), (3, 3)], "id long, folder_id long")
    items = spark.createDataFrame([("folder", 2), ("document", 1), ("document", 2), ("document", 3)], "kind string, id long")
    with pytest.raises(ValueError):
        B.planned_moves(items, 3, up, docs)
    assert sorted(map(tuple, B.planned_moves(items, 1, up, docs).collect())) == [("document", 2)]
    assert sorted(map(tuple, B.planned_moves(items, None, up, docs).collect())) == [("document", 1), ("folder", 2)]


def test_entry_and_oracles_name_the_same_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
