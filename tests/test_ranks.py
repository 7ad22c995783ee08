"""Running numbers of documents that are too large for one task equal those of a window."""

import random

import pytest
from pyspark.sql import functions as F

from colonnade.operators import columns as C
from colonnade.operators import display as D
from colonnade.operators import ranks
from colonnade.operators import rows as R


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    made = [(d, i, f"s{rng.randrange(40)}", rng.choice(["", "x"]), rng.randrange(3), "".join(rng.choice("ACGT-") for _ in range(20)) + "A", [("g", rng.choice("abc"))] if rng.random() < 0.8 else []) for d in (1, 2) for i in range(300 if d == 1 else 5)]
    return spark.createDataFrame(made, R.ROWS).repartition(6)


def test_running_sums(spark, rows, monkeypatch):
    keyed = rows.select("doc_id", "idx", F.when(F.col("idx") % 3 > 0, F.col("name")).alias("label"), F.length("data").cast("long").alias("v"))
    for by in (["doc_id"], ["doc_id", "label"]):
        for upto in (0, -1):
            want = sorted(map(tuple, ranks.running(keyed, by, [F.desc("idx")], F.col("v"), "sum", upto).collect()), key=str)
            monkeypatch.setattr(ranks, "FEW", 0)
            got = ranks.running(keyed, by, [F.desc("idx")], F.col("v"), "sum", upto)
            assert sorted(map(tuple, got.collect()), key=str) == want
            monkeypatch.undo()
    assert ranks.numbered(keyed.limit(0), ["doc_id"], [F.col("idx")], "n").count() == 0


def test_operators_do_not_depend_on_it(rows, monkeypatch):
    options = D.Options(sort="Name", descending=True, group_by="g", folded=["a"])
    some = {
        "sort": lambda: D.sort_order(rows, "Name", 0), "build": lambda: D.build(rows, options), "collapse": lambda: D.build(rows, D.Options(collapse=True)), "prefix": lambda: D.group_prefix(D.build(rows, options)),
        "coords": lambda: C.reference_coords(rows, 0), "map": lambda: C.column_map(C.reference_coords(rows, 0).select("doc_id", "col", F.col("is_base").alias("keep"))),
        "slice": lambda: R.slice_columns(rows, 3, 15), "rows": lambda: R.slice_rows(rows, 3, 15).select("doc_id", "idx", "start", "data"), "delete": lambda: R.delete_rows(rows, rows.where("idx % 4 = 1")).select("doc_id", "idx", "old_idx"),
    }
    want = {k: (f().dtypes, sorted(map(tuple, f().collect()), key=str)) for k, f in some.items()}
    monkeypatch.setattr(ranks, "FEW", 0)
    for k, f in some.items():
        assert (f().dtypes, sorted(map(tuple, f().collect()), key=str)) == want[k], k
