"""Importance resampling against brute force and SQL; the hashing of runs against zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from colonnade.llm import common, entry, resampling
from test_corpus_operators import DATA, DOCS, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target, percent=5):
    """{position: (n_words, n_features, weight, score)} and the drawn positions in order."""
    found = [features(t) for _, t in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10000)]
    out = []
    for (d, _), (n, f) in zip(rows, found, strict=True):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0]))
    return sorted(out, key=str), able[: percent * len(able) // 100]


def test_crc_of_joined_words():
    rng = random.Random(4)
    parts = [(bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 300]))), bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 255, 256, 2000])))) for _ in range(200)]
    a, b, size = (np.array(x) for x in zip(*((zlib.crc32(x), zlib.crc32(y), len(y)) for x, y in parts), strict=True))
    got = resampling.extended(a.astype(np.uint32), b.astype(np.uint32), size)
    assert got.tolist() == [zlib.crc32(x + y) for x, y in parts]


def test_features_in_small_blocks_and_slices(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bé", "C", "d" * 300, "9"]) + rng.choice(["", "1"]) for _ in range(rng.choice([0, 1, 2, 3, 50, 700]))) for _ in range(40)]
    monkeypatch.setattr(resampling, "TOKENS", 64)
    monkeypatch.setattr(resampling, "VOCABULARY", 100)
    monkeypatch.setattr(common, "SLICE", 1000)
    own = [[] for _ in texts]
    for of, start, found in resampling.Features().blocks([t.encode() for t in texts]):
        for i, a, b in zip(of.tolist(), start.tolist(), [*start[1:].tolist(), found.shape[1]], strict=True):
            own[i] += found[:, a:b][found[:, a:b] >= 0].tolist()
    assert [sorted(x) for x in own] == [sorted(features(t)[1]) for t in texts]


def test_sample_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(r[0], r[1]) for r in odd_docs()] + [(100 + i, " ".join(rng.choice(["red", "green", "blue", "Red-9", "x"]) for _ in range(rng.randrange(10, 60)))) for i in range(150)]
    rows += [(100, rows[-1][1])] * 3
    target = ["red green red", None, "", "blue! blue"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"weight": F.lit("clash"), "id": F.lit(1), "row": F.lit(2), "at": F.lit(3), "place": F.lit(4), "score": F.lit(5)})
    got = resampling.sample(docs, spark.createDataFrame([(t,) for t in target], "text string"), 20, keep=["doc_id"]).collect()
    all_, drawn = brute(rows, target, 20)
    assert sorted((tuple(r)[:5] for r in got), key=str) == all_
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [tuple(r)[:5] for r in ranked] == drawn and len(drawn) > 20


def test_empty_tables(spark):
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert resampling.sample(empty, none, keep=["doc_id"]).collect() == []
    got = resampling.sample(spark.createDataFrame(odd_docs(), DOCS), none, keep=["doc_id"]).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute([(r[0], r[1]) for r in odd_docs()], [])[0]


def test_ranks_do_not_meet_in_one_task(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("x"), "id").repartition(5)
    got = resampling.ranked(rows, [F.col("x").desc(), F.col("id")])
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    want = sorted(((i % 7, i) for i in range(1000)), key=lambda r: (-r[0], r[1]))
    assert [(r["x"], r["id"]) for r in sorted(got.collect(), key=lambda r: r["rank"])] == want


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    got = entry.op12_resampling(spark, DATA)
    want = con.sql(entry.ORACLE_SQL["op12_resampling"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
