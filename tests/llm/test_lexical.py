"""Ranked lexical search against brute force and SQL, and the bounds of the byte impacts."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.llm import common, entry, lexical
from test_corpus_operators import DATA, DOCS, odd_docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, k=10):
    docs = [(d, Counter(terms(t))) for d, t in rows]
    docs = [(d, c, c.total()) for d, c in docs if c]
    n_docs, all_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in docs:
            m = 25 + (75 * n * n_docs) // all_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def made(seed=6, n=120):
    rng = random.Random(seed)
    vocabulary = [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 40, 300])))) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(25)]  # ties beyond the k-th
    items = [(f"q{i}", " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 20])))) for i in range(30)]
    return rows, items + [("q0", items[0][1]), ("empty", ""), ("null", None), (None, rows[3][1][:300]), ("ünknown", "ünknown ... nowhere"), ("twice", "t1 T1 t1 alpha-beta")]


@pytest.mark.parametrize("shard", [lexical.SHARD_DOCS, 7])
def test_search_equals_brute_force(spark, monkeypatch, shard, tmp_path):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 20)
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    rows, items = made()
    rows += [(r[0], r[1]) for r in odd_docs()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"term": F.lit("clash"), "shard": F.lit(1), "id": F.lit(2)}).repartition(3)
    asked = spark.createDataFrame(items, "item_id string, text string").withColumns({"rank": F.lit(1), "item": F.lit("clash")})
    lexical.build(docs, f"file://{tmp_path}/i")
    got = lexical.search(spark, f"file://{tmp_path}/i", asked)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, items)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    tf, n = rng.integers(1, 2000, 5000), rng.integers(1, 100_000, 5000)
    exact = lexical.impacts(tf, n, 1000, 700_000)
    level = -(-exact // lexical.UNIT)
    assert 0 < level.min() and level.max() <= 255
    assert (exact <= level * lexical.UNIT).all() and (exact > (level - 1) * lexical.UNIT).all()


def test_long_text_in_slices(monkeypatch):
    text = " ".join(f"word{i % 97}, X{i % 5}" for i in range(2000)) + "-" * 500 + "y" * 700
    monkeypatch.setattr(common, "SLICE", 64)
    shard = lexical.Shard()
    shard.add(1, text.encode())
    got = {t.decode(): int(c) for t, c in zip([list(shard.number)[i] for i in shard.terms[0]], shard.counts[0], strict=True)}
    assert got == Counter(terms(text)) and shard.lengths == [len(terms(text))]


def test_empty_tables(spark, tmp_path):
    items = spark.createDataFrame([("a", "alpha")], "item_id string, text string")
    lexical.build(spark.createDataFrame([], DOCS), f"file://{tmp_path}/none")
    assert lexical.search(spark, f"file://{tmp_path}/none", items).collect() == []
    lexical.build(spark.createDataFrame(odd_docs(), DOCS), f"file://{tmp_path}/some")
    assert lexical.search(spark, f"file://{tmp_path}/some", items.limit(0)).collect() == []


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    got = entry.op11_lexical_search(spark, DATA)
    want = con.sql(entry.ORACLE_SQL["op11_lexical_search"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
