"""The library under several writers, and what an edit reads and writes."""

import os
import threading

import pytest

from colonnade.operators import library as B
from colonnade.operators import rows as R


def rows_of(spark, texts):
    return spark.createDataFrame([(9, i, f"s{i}", "", 0, t, []) for i, t in enumerate(texts)], R.ROWS)


def files(path):
    return {os.path.join(top, n) for top, _, names in os.walk(path) for n in names}


def test_one_claim_wins(spark, tmp_path):
    store, won = B.Store(spark, f"file://{tmp_path}/s"), []
    threads = [threading.Thread(target=lambda i=i: won.append((store.claim("versions/1.json", str(i)), i))) for i in range(16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    (winner,) = [i for made, i in won if made]
    assert store.read("versions/1.json") == str(winner) and store.names("versions") == ["1.json"]


def test_two_writers_lose_no_edit(spark, tmp_path):
    path = f"file://{tmp_path}/lib"
    id_ = B.Library(spark, path).insert_document("d", "Sequences", rows_of(spark, ["ACGT", "AC"]))
    failed = []

    def write(who):
        try:
            lib = B.Library(spark, path)
            for i in range(4):
                lib.add_annotation(id_, f"{who}{i}", "Region", i, i + 1)
                lib.create_folder(f"{who}{i}")
                lib.set_setting(f"{who}{i}", "x")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    lib = B.Library(spark, path)
    names = sorted(f"{w}{i}" for w in "ab" for i in range(4))
    assert not failed
    got = lib.annotations(id_).collect()
    assert sorted(r["name"] for r in got) == names and sorted(r["id"] for r in got) == list(range(1, 9))
    folders = lib.folders().collect()
    assert [r["name"] for r in folders] == names and sorted(r["id"] for r in folders) == list(range(1, 9))
    assert all(lib.setting(n) == "x" for n in names)


def test_an_edit_is_applied_again_to_what_another_left(spark, tmp_path):
    lib = B.Library(spark, f"file://{tmp_path}/lib")
    id_ = lib.insert_document("d", "Sequences", rows_of(spark, ["ACGT"]))
    other, seen = B.Library(spark, f"file://{tmp_path}/lib"), []

    def act(v):
        seen.append(v.document(id_)["name"])
        if len(seen) == 1:
            other.rename_document(id_, "by another")
        v.edit_document(id_)["description"] = "mine"

    lib.edit(act)
    got = lib.document(id_)
    assert seen == ["d", "by another"] and (got["name"], got["description"]) == ("by another", "mine")


def test_an_edit_writes_one_document(spark, tmp_path):
    lib = B.Library(spark, f"file://{tmp_path}/lib")
    ids = [lib.insert_document(f"d{i}", "Sequences", rows_of(spark, ["ACGT", "GG"])) for i in range(3)]
    before = files(tmp_path)
    lib.add_annotation(ids[1], "a", "Region", 0, 2)
    lib.rename_document(ids[2], "new")
    new = {os.path.relpath(f, f"{tmp_path}/lib") for f in files(tmp_path) - before if not os.path.basename(f).startswith((".", "_"))}
    assert {f.split("/")[1] for f in new if f.startswith("data/")} == {str(ids[1])} and not any("rows" in f for f in new)
    assert before <= files(tmp_path)  # nothing that a reader may hold is changed
    assert len([f for f in new if f.startswith("parts/")]) == 2


def test_a_failed_edit_leaves_the_version(spark, tmp_path):
    lib = B.Library(spark, f"file://{tmp_path}/lib")
    id_ = lib.insert_document("d", "Alignment", rows_of(spark, ["ACGT", "GGGG"]), 1)
    number = lib.now().number
    for act in (lambda: lib.delete_rows(id_, [0, 1]), lambda: lib.reorder_rows(id_, [0, 0]), lambda: lib.rename_document(77, "x"), lambda: lib.text(id_)):
        with pytest.raises((ValueError, KeyError)):
            act()
    assert lib.now().number == number and lib.load(id_)[1].count() == 2
    assert lib.document(99) is None


def test_sort_rows_and_tables(spark, tmp_path):
    lib = B.Library(spark, f"file://{tmp_path}/lib")
    rows = spark.createDataFrame([(1, i, n, "", 0, "ACGT"[: i + 1], []) for i, n in enumerate(["s10", "s2", "s1"])], R.ROWS)
    lib.load_tables({"rows": rows, "documents": spark.createDataFrame([(1, "d", "Sequences", 3, 3, 1, "", None, None)], B.TABLES["documents"])})
    lib.sort_rows(1, "Name")
    assert [r["name"] for r in lib.load(1)[1].collect()] == ["s2", "s1", "s10"] and lib.document(1)["reference"] == 0
    assert lib.insert_document("e", "Sequences", rows) == 2 and lib.table("rows").count() == 6


def test_counts_after_edits_equal_a_recount(spark, tmp_path, monkeypatch):
    import random

    from colonnade.operators import columns as C

    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGTN-") for _ in range(rng.randrange(5, 30))) for _ in range(20)]
    lib = B.Library(spark, f"file://{tmp_path}/lib")
    id_ = lib.insert_document("d", "Alignment", rows_of(spark, texts), 3)
    counted = sorted(map(tuple, lib.column_counts(id_).collect()))
    calls = []
    covered = C.covered_counts
    monkeypatch.setattr(C, "covered_counts", lambda rows: calls.append(rows) or covered(rows))
    want = lambda: sorted(map(tuple, C.column_counts(lib.load(id_)[1], lib.document(id_)["reference"]).collect()))
    assert counted == want()
    longest = max(range(20), key=lambda i: len(texts[i]))
    changes = [
        (lambda: lib.delete_rows(id_, [0, 5, 7]), 3), (lambda: lib.set_reference(id_, 4), 2), (lambda: lib.set_reference(id_, None), 1), (lambda: lib.append_rows(id_, rows_of(spark, ["ACGTNNNN-A" * 5, "A"])), 2),
        (lambda: lib.reorder_rows(id_, list(range(19))[::-1]), 0), (lambda: lib.set_reference(id_, 1), 1), (lambda: lib.delete_rows(id_, [1, 0]), 1), (lambda: lib.sort_rows(id_, "Length", True), 0),
    ]
    for act, n in changes:
        calls.clear()
        act()
        assert sum(r.count() for r in calls) == n  # only rows that change are counted
        assert sorted(map(tuple, lib.column_counts(id_).collect())) == want(), longest
    lib.replace_rows(id_, rows_of(spark, ["ACG"]), reference=None)
    assert "counts" not in lib.now().document(id_)["files"] and sorted(map(tuple, lib.column_counts(id_).collect())) == want()
