"""Literal cases of messages and actions."""

import pytest
from pyspark.sql import functions as F

from colonnade.functions import messages as T
from colonnade.operators import actions as A
from colonnade.operators import display as D
from colonnade.operators import library as B
from colonnade.operators import rows as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_typed_values(spark):
    field = lambda t: one(spark, T.number_field(F.lit(t), "Na⁺", 0, 1e6))
    assert field("1,5")["value"] == 1.5 and field("1e3")["value"] == 1000 and field("1e9")["problem"] == "Na⁺ must be a number from 0 to 1000000."
    assert all(field(t)["value"] is None for t in ("", " 1", "1d", "nan", "-1", "1,000.5"))
    whole = lambda t, least: one(spark, T.whole_field(F.lit(t), "Threads", least))
    assert whole("1_000 000", 0)["value"] == 1_000_000 and whole("0", 1)["problem"] == "Threads must be a whole number of at least 1."
    assert all(whole(t, 0)["problem"] == "Threads must be a whole number." for t in ("", "-1", "1.0", "99999999999999999999"))


def test_tool_texts(spark):
    status = lambda t: one(spark, T.status_line(F.lit(t)))
    assert status(" Reading up to 1,000 pairs ...\n") == "Reading up to 1,000 pairs" and status("error: x") is None and status(" ") is None
    assert one(spark, T.command_line("t", F.array(F.lit("a b"), F.lit("c")))) == 't "a b" c'
    check = lambda t: one(spark, T.tool_status(F.lit(t), (1, 10, 0)))
    assert check("tool 1.10.0")["version"] == "1.10.0" and "too old" in check("tool 1.9.9")["problem"] and check("?")["problem"] == "unexpected answer to --version: ?"
    p = one(spark, T.progress(F.lit('{"type":"progress","phase":"round","covered":1,"total":0,"pct":250,"message":"m"}')))
    assert (p["fraction"], p["text"]) == (1.0, "m")


def test_position_notes(spark):
    ends = lambda *e: spark.createDataFrame([(x,) for x in e], "end int")
    note = lambda e, *more: B.position_note(ends(*e), *more).first()["note"]
    assert note([5], 9, "annotation") == "This document has 1 annotation; its position is not shifted when bases are inserted or removed."
    assert note([5, 12], 9, "imported feature").endswith(" 1 of them extends past the new end and will be removed.")
    assert note([12, 13, 4], 9).endswith(" 2 of them extend past the new end and will be removed.")
    assert note([12], 9).endswith(" It extends past the new end and will be removed.") and A.end_notes(ends(), ends(), 9).count() == 0


def test_keep_view():
    old = D.Options(sort="meta:a", group_by="b", name_filter="x")
    assert A.keep_view(old, ["a", "b"]) == old
    new = A.keep_view(old, ["c"])
    assert (new.sort, new.group_by, new.name_filter) == ("Original", None, "x")


def test_run_records_pad_with_gaps(spark):
    rows = spark.createDataFrame([(1, 0, "a", "", 0, "AC-T", []), (1, 1, "b", "", 2, "GG", []), (1, 2, "c", "", 9, "A", [])], R.ROWS)
    got = {r["name"]: r["text"] for r in A.run_records(rows, rows, 0, 6).collect()}
    assert got == {"a": "AC-T", "b": "--GG"}


def test_read_only(spark, tmp_path):
    lib = B.Library(spark, f"file://{tmp_path}/lib")
    id_ = lib.insert_linked("set", {"summary": {"records": 1, "width": 1}, "files": []})
    with pytest.raises(ValueError, match="read-only"):
        A.trim(lib, id_)
    assert A.check_links(lib, [id_]).count() == 0
