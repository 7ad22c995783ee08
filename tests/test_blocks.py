"""Ranges of compressed and plain sequence files: same records as from the beginning, wherever files are cut."""

import gzip
import random

import pytest

from colonnade.plans import all_queries, registry  # noqa: F401
from colonnade.sources import blocks, fasta, fastq

DATA = "/root/testdata/sf0.001"


def made(rng, n=300, wrapped=False):
    """FASTQ text whose quality lines often begin with the marks of records."""
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 80, 700]) if wrapped else rng.choice([1, 40, 90])
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        qual = "".join(rng.choice("@@@@+IFA>") for _ in range(size))
        width = rng.choice([7, 60]) if wrapped else max(1, size)
        fold = lambda s, w: "\n".join(s[a : a + w] for a in range(0, len(s), w)) or ""
        end = "\r\n" if rng.random() < 0.1 else "\n"
        out.append(f"@read{i} @x +y\n{fold(seq, width)}\n+\n{fold(qual, width)}\n".replace("\n", end) + ("\n" if rng.random() < 0.1 else ""))
    return "".join(out)


def wanted(text):
    return list(fastq.parse(iter(text.split("\n"))))


def put(path, text, kind):
    data = text.encode()
    if kind == "blocks":
        data = b"".join(blocks.compressed([data], 997)) + blocks.END
    elif kind == "gzip":
        data = gzip.compress(data[:5000]) + gzip.compress(data[5000:]) + bytes(20)
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("kind", ["blocks", "plain", "gzip"])
@pytest.mark.parametrize("wrapped", [False, True])
def test_ranges_have_all_records_once(spark, tmp_path, kind, wrapped, monkeypatch):
    if kind == "plain":
        monkeypatch.setattr(blocks, "TEXT", 1 << 16)
    text = made(random.Random(5), 1500 if kind == "plain" else 300, wrapped)
    path = put(tmp_path / "x.fastq.gz", text, kind)
    size = blocks.size_and_kind(path)
    assert size[1] == kind
    for step in (70_000,) if kind == "plain" else (1500, 4000, 1 << 20):
        index = blocks.index(spark, [path], fastq.FASTQ, step)
        ranges = blocks.ranges_of(index)
        got = [x for r in ranges for x in blocks.between(r["file"], r["first"], r["after"], fastq.FASTQ)]
        assert got == wanted(text)
        assert [r["base"] for r in ranges] == [sum(x["records"] for x in ranges[:i]) for i in range(len(ranges))]
        assert len(ranges) > 1 or kind == "gzip" or step > 100_000 or wrapped
    read = fastq.read_fastq(spark, path, range_bytes=70_000 if kind == "plain" else 2000)
    assert [tuple(r) for r in read.orderBy("read_no").select("head", "seq", "qual").collect()] == wanted(text)
    assert kind == "gzip" or read.rdd.getNumPartitions() > 1
    assert fastq.read_fastq(spark, path, limit=7).count() == 7


def test_wrong_entry_is_proved_and_mended(spark, tmp_path):
    """A member that begins within a header, where the rest looks like a header: the range before says where it begins."""
    text = "".join(f"@a{i} {'p' * 30}@b{i}\nACGT\n+\nIIII\n" for i in range(200))
    at = text.index("@b60")
    data = text.encode()
    path = tmp_path / "y.fq.gz"
    path.write_bytes(b"".join(blocks.compressed([data[:at]], 500)) + b"".join(blocks.compressed([data[at:]], 500)) + blocks.END)
    file = blocks.File(str(path))
    cut = sum(map(len, blocks.compressed([data[:at]], 500)))
    assert blocks.enter(file, cut, fastq.FASTQ) == cut << 16  # misled
    index = blocks.index(spark, [str(path)], fastq.FASTQ, cut)
    got = [x for r in blocks.ranges_of(index) for x in blocks.between(r["file"], r["first"], r["after"], fastq.FASTQ)]
    assert got == wanted(text)


def test_damage_is_told(tmp_path):
    whole = b"".join(blocks.compressed([made(random.Random(1)).encode()], 997)) + blocks.END
    for i, bad in enumerate((whole[:4000], whole[:700] + b"\0\0\0" + whole[703:])):
        (tmp_path / f"{i}.fq.gz").write_bytes(bad)
        with pytest.raises(ValueError, match="damaged"):
            list(blocks.between(str(tmp_path / f"{i}.fq.gz"), 0, blocks.END_OF_FILE, fastq.FASTQ))
    (tmp_path / "t.fq.gz").write_bytes(gzip.compress(b"@a\nAC\n+\nII\n" * 9000)[:-9])
    with pytest.raises(ValueError, match="early"):
        list(blocks.between(str(tmp_path / "t.fq.gz"), 0, blocks.END_OF_FILE, fastq.FASTQ))
    (tmp_path / "none.fq").write_bytes(b"")
    assert list(blocks.between(str(tmp_path / "none.fq"), 0, blocks.END_OF_FILE, fastq.FASTQ)) == []


def test_gzip_reads_it_too():
    text = made(random.Random(2)).encode() + bytes(random.Random(3).randrange(256) for _ in range(200_000))
    assert gzip.decompress(b"".join(blocks.compressed([text[:10], b"", text[10:]])) + blocks.END) == text


def test_long_line_and_member_edges(tmp_path):
    """A record over many members, and lines that end with theirs."""
    text = ">a x=1\n" + "ACGT\n" * 4 + ">b\n" + "G" * 50_000 + "\n>c\n\n>d\nAC"
    (tmp_path / "s.fa.gz").write_bytes(b"".join(blocks.compressed([text.encode()], 27)) + blocks.END)
    file = blocks.File(str(tmp_path / "s.fa.gz"))
    ends, want = [], [("a x=1", "ACGT" * 4, ""), ("b", "G" * 50_000, ""), ("c", "", ""), ("d", "AC", "")]
    assert list(blocks.between(file.path, 0, blocks.END_OF_FILE, fasta.FASTA)) == want
    for a in range(0, file.size, 3000):
        start = blocks.enter(file, a, fasta.FASTA)
        *records, (after, *_) = blocks.scan(file, start, min(a + 3000, file.size), fasta.FASTA) if start >> 16 < a + 3000 else [(start,)]
        assert not ends or ends[-1][1] == start
        ends.append((records, after))
    assert [tuple(r[1:]) for records, _ in ends for r in records] == want


def test_fasta_ranges(spark, tmp_path):
    rng = random.Random(4)
    text = "".join(f">s{i} [n={i}]\n" + "\n".join("".join(rng.choice("ACGT-") for _ in range(60)) for _ in range(rng.randrange(1, 9))) + "\n" for i in range(200))
    (tmp_path / "p.fa").write_text(text)
    (tmp_path / "q.fa.gz").write_bytes(b"".join(blocks.compressed([text.encode()], 997)) + blocks.END)
    names = ["idx", "name", "description", "start", "data", "meta"]
    got = fasta.read_fasta_ranges(spark, [str(tmp_path / "q.fa.gz")], 3000)
    assert got.rdd.getNumPartitions() > 3
    assert sorted(got.select(names).collect()) == sorted(fasta.read_fasta(spark, str(tmp_path / "p.fa")).select(names).collect())
    (tmp_path / "e.fa").write_text("no mark")
    with pytest.raises(ValueError, match="no sequences"):
        fasta.read_fasta_ranges(spark, [str(tmp_path / "e.fa")])


def test_delimited():
    cut = fasta.split_delimited
    assert cut('a,"b, c",d', ",") == ["a", "b, c", "d"] and cut("", ",") == [""] and cut("a;;b;", ";") == ["a", "", "b", ""]
    assert cut('"x ""y""",z', ",") == ['x "y"', "z"] and cut('"",""""', ",") == ["", '"'] and cut('a"b,c"d,e', ",") == ["ab,cd", "e"]
    assert cut('"open, to the end', ",") == ["open, to the end"] and cut('"a""', ",") == ['a"']
