"""SimHash near-dedup against brute force, and the Golay code against its definition."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colonnade.llm import common, simhash
from test_corpus_operators import DATA, DOCS, odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text, n=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    """Sorted (id, fingerprint, least id of the group) of rows (id, fingerprint)."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(rows)), key=str)


def test_codewords():
    words = np.random.default_rng(5).integers(0, 1 << 23, 300)
    codewords = (np.arange(4096) << 11) | simhash._REMAINDER
    apart = np.bitwise_count(words[:, None] ^ codewords[None, :])
    for w, near, all_, row in zip(words, simhash.nearest(words), simhash.within_four(words), apart, strict=True):
        assert row[near] <= 3 and near == row.argmin(), w
        assert sorted(x for x in all_ if x >= 0) == np.flatnonzero(row <= 4).tolist()


def test_linked_fingerprints_share_a_key():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b), dtype=np.uint64)
    held = []
    for fps in (a, b):
        own = [set() for _ in fps]
        for key, side, who in simhash.keys(fps):
            for k, s, w in zip(key.tolist(), side.tolist(), who.tolist(), strict=True):
                own[w].add((k, s))
        held.append(own)
    for x, y in zip(*held, strict=True):
        assert any((k, s if s == 2 else 1 - s) in y for k, s in x)


@pytest.mark.parametrize("many", [simhash.MANY, 3])
def test_join_equals_brute_force(spark, many):
    rng = random.Random(9)
    rows = [(r[0], r[1]) for r in odd_docs()]
    for g in range(8):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 40, 150, 400]))]
        for i in range(18):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
            rows.append((900 - 20 * g - i, (" " if i % 2 else "\n").join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "label": F.lit(1), "component_id": F.lit(2), "id": F.lit(3), "row": F.lit(4)})
    got = simhash.join(docs, keep=["doc_id"], many=many)
    want = brute_groups([(d, brute_print(t)) for d, t in rows])
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len({c for _, _, c in want}) < len(rows) - 40


@pytest.mark.parametrize("many", [simhash.MANY, 40])
def test_dense_fingerprints_equal_brute_force(spark, many):
    """One large group around a center, a chain, and single ones: hot keys go by cells."""
    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 1 << 62))
    fps = {center} | {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (250, 2))}
    fps |= {center ^ int(sum(1 << int(x) for x in set(rng.integers(0, 20, 9)))) for _ in range(150)}
    chain = int(rng.integers(0, 1 << 62))
    for i in range(20):
        chain ^= 7 << (3 * i)
        fps.add(chain)
    fps |= set(rng.integers(0, 1 << 62, 40).tolist())
    fps = sorted(fps)
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links, _ = simhash.links(table, many)
    links = [((r["a"] % (1 << 64)), (r["b"] % (1 << 64))) for r in links.collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in links)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    want = {int(f, 16): c for _, f, c in brute_groups(list(enumerate(fps)))}
    got = {}
    for i, x in enumerate(fps):
        got.setdefault(find(x), i)
    assert {x: got[find(x)] for x in fps} == want


def test_long_text_in_slices(monkeypatch):
    text = " ".join(f"word{i % 97} x{i % 5}" for i in range(3000)) + " " + "y" * 500 + " end"
    want = brute_print(text)
    monkeypatch.setattr(common, "SLICE", 64)
    assert simhash.fingerprint(text.encode().translate(simhash.PLAIN), 3) == want


def test_empty_table_and_query(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.join(empty, keep=["doc_id"]).collect() == []
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = simhash.join(docs, keep=["doc_id"])
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups([(r["doc_id"], brute_print(r["text"])) for r in docs.collect()])
