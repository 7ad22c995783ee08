"""Linked files that stay, change and move; samples of reads; edits of a text."""

import os
import random

import pytest

from colonnade.operators import actions as A
from colonnade.operators import library as B
from colonnade.operators import links as K
from colonnade.operators import reads as E
from colonnade.plans.more_queries import applied, demo
from colonnade.sources import blocks, fastq


def put(path, data, when=1_600_000_000):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    os.utime(path, (when, when))
    return str(path)


def known(spark, paths, sets=None):
    got = {r["path"]: r for r in K.remembered(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    return spark.createDataFrame([(sets[i] if sets else 1, i, p, got[p]["size"], got[p]["modified"], got[p]["digest"]) for i, p in enumerate(paths)], "set long, idx int, path string, size long, modified long, digest string")


def test_fingerprints_read_both_ends(spark, tmp_path):
    import xxhash

    rng = random.Random(1)
    for n in (0, 10, 1 << 20, (1 << 20) + 5, 3_000_000):
        data = rng.randbytes(n)
        path = put(tmp_path / f"f{n}", data)
        tail = data[-min(n - (1 << 20), 1 << 20) :] if n > 1 << 20 else b""
        want = (path, n, xxhash.xxh3_64_hexdigest(n.to_bytes(8, "little") + data[: 1 << 20] + tail))
        assert [tuple(r) for r in K.fingerprints(spark.createDataFrame([(path,), (path,), ("/none",), (None,)], "path string")).collect()] == [want]


def test_states(spark, tmp_path):
    paths = [put(tmp_path / n, n.encode() * 100) for n in ("same", "touched", "longer", "other", "gone", "kept")]
    files = known(spark, paths)
    put(tmp_path / "touched", b"touched" * 100, 1_700_000_000)
    put(tmp_path / "longer", b"longer" * 101, 1_700_000_000)
    put(tmp_path / "other", b"OTHER" * 100, 1_700_000_000)
    put(tmp_path / "kept", b"KEPT" * 100)  # of the same size and time: not read
    os.unlink(tmp_path / "gone")
    got = {os.path.basename(r["path"]): (r["state"], r["modified_now"]) for r in K.states(files).collect()}
    assert {k: v[0] for k, v in got.items()} == {"same": "ok", "touched": "ok", "longer": "changed", "other": "changed", "gone": "missing", "kept": "ok"}
    assert got["touched"][1] == 1_700_000_000 and got["gone"][1] is None


def test_relink_takes_neighbours_of_all_sets(spark, tmp_path):
    names = ["a", "b", "c", "d", "e"]
    paths = [put(tmp_path / "old" / n, n.encode() * 50) for n in names] + [put(tmp_path / "far" / "f", b"f" * 50)]
    lib = B.Library(spark, f"file://{tmp_path}/lib")
    files = known(spark, paths, [1, 1, 2, 2, 2, 2]).collect()
    for set_ in (1, 2):
        own = [{"path": r["path"], "size": r["size"], "modified": r["modified"], "digest": r["digest"]} for r in files if r["set"] == set_]
        lib.insert_linked(f"s{set_}", {"files": own, "summary": {"records": 1, "width": 1}})
    for n in "abce":
        (tmp_path / "new").mkdir(exist_ok=True)
        os.rename(tmp_path / "old" / n, tmp_path / "new" / n)
    put(tmp_path / "new" / "e", b"E" * 50)  # another file of that name and size
    put(tmp_path / "new" / "d", b"d" * 50)  # the one in the old folder is still right
    put(tmp_path / "elsewhere" / "any name", b"e" * 50)
    with pytest.raises(ValueError, match="not the same"):
        A.relink(lib, 1, 0, str(tmp_path / "new" / "b"))
    assert A.relink(lib, 1, 0, str(tmp_path / "new" / "a")) == 3
    state = {os.path.relpath(r["path"], tmp_path): r["state"] for r in A.check_links(lib).collect()}
    assert state == {"new/a": "ok", "new/b": "ok", "new/c": "ok", "old/d": "ok", "old/e": "missing", "far/f": "ok"}
    there = spark.createDataFrame([(str(p),) for p in tmp_path.rglob("*") if p.is_file() and "lib" not in p.parts], "path string")
    found = K.located(A.linked_table(lib), there).collect()
    assert [(os.path.basename(r["path"]), os.path.basename(r["new_path"])) for r in found] == [("e", "any name")]


def test_draws_are_distinct_even_and_repeatable(spark):
    numbers = lambda n, k, seed: sorted(r["number"] for r in E.draw(n, k, seed, spark).collect())
    assert numbers(3, 5, 1) == [0, 1, 2] and numbers(0, 5, 1) == []
    a = numbers(10_000, 1000, 7)
    assert len(set(a)) == 1000 and a == numbers(10_000, 1000, 7) != numbers(10_000, 1000, 8)
    assert 400 < sum(x < 5000 for x in a) < 600


def test_sample_of_files_reads_what_a_scan_would(spark, tmp_path):
    for i, n in enumerate((700, 40, 900)):
        text = "".join(f"@f{i}:{j}\nACGT\n+\nIIII\n" for j in range(n))
        (tmp_path / f"{i}.fq.gz").write_bytes(b"".join(blocks.compressed([text.encode()], 2000)) + blocks.END)
    files = fastq.files_in(str(tmp_path))
    index = blocks.index(spark, files, fastq.FASTQ, 700)
    for paired in (False, True):
        sources = [(files[:2], 40), ([files[2]], 900)] if paired else None
        got = sorted(r["head"] for r in E.sample_files(spark, index, sources, 5, paired).collect())
        want = E.sample(fastq.read_fastq(spark, str(tmp_path)), sources or [([f], n) for f, n in zip(files, (700, 40, 900), strict=True)], 5, paired)
        assert got == sorted(r["head"] for r in want.collect()) and len(got) >= (500 if paired else 1000)


def test_edits_apply_from_left_to_right(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for c in range(20):
        i, out, letters = 0, "", [(rng.choice("ACGT"), "tt" if rng.random() < 0.2 else "", rng.randrange(1, 6) if rng.random() < 0.2 else 0) for _ in range(40)]
        rows += [(c, p, b, ins, p + n if n else None) for p, (b, ins, n) in enumerate(letters)]
        while i < 40:
            b, ins, n = letters[i]
            out += ins + ("" if n else b)
            i += n or 1
        want[c] = out
    got = applied(spark.createDataFrame(rows, "c int, p long, b string, ins string, upto long"))
    assert {r["c"]: r["g"] for r in got.collect()} == want


def test_demo_genomes(spark):
    rows = {r["idx"]: r for r in demo(spark, 4000, 300).collect()}
    assert len(rows) == 301 and rows[0]["name"] == "REF_genome" and len(rows[0]["data"]) == 4000 and rows[7]["name"] == "GEN00007.1"
    clades = [dict(map(tuple, r["meta"]))["clade"] for i, r in rows.items() if i]
    assert 70 < clades.count("A") < 140 and set(clades) == set("ABCDEF")
    assert 2 <= sum("N" * 15 in r["data"] for r in rows.values()) < 30 and 20 < sum(len(r["data"]) < 3800 for r in rows.values()) < 80
    assert all(set(r["data"]) <= set("ACGTN") for r in rows.values())
