"""SimHash fingerprints of word shingles, and the groups of fingerprints that differ in a few bits, by Golay-code fuzzy hashing.

A fingerprint has 64 bits; two link at ERRORS = 3 or fewer differing bits. The binary Golay code of 23 bits is perfect: each
word of 23 bits is within 3 bits of exactly one codeword, and either that codeword is within 2 bits, or five others are 4 bits
away. A word's keys are the indices (12 bits) of all codewords within 4 bits, so one or six. Words that differ in one bit: the
nearest codeword of each is among the keys of the other. All steps are exact:

1. Fingerprints. Per text; only different fingerprints go on, each with its least id.
2. Keys. A fingerprint is three segments of 23, 23 and 18 bits (the last filled with zeros). Three errors fall on segments in one
   of three ways, each with tables of its own:
   all on one segment: the two others are equal - a key for each pair of segments (3 keys, 41 to 46 bits);
   on two segments, one of them getting one error: one segment is equal and another has one error - a key of the equal segment
   and a codeword's index (6 tables, 30 to 35 bits), entered under the nearest codeword and searched under all keys;
   one on each: a key of three codewords' indices (36 bits), where one side spreads the first segment over its keys and the other
   side the second and third.
   That is 74 keys a fingerprint on average; a key meets another side's only, so two equal keys of 30 bits or more are rare.
3. Join. Keys are dealt by hash and sorted; fingerprints under one key are compared in full (verify). A task passes on only the links
   that join groups it has not joined, so large groups of near copies never become all their pairs.
4. Hot keys. A key with more than MANY fingerprints is not held by a task: its rows go on as they are, are cut into blocks of at
   most MANY by count, and every two blocks meet in a cell of their own.
5. Groups of the links by star contraction; a document gets the least id of its fingerprint's group.

Defined results: null text and text without words have the fingerprint zero, which links like any other; texts of fewer words
than a shingle are one shingle; equal ids and null ids are kept as rows, and a null id never names a group unless all ids of the
group are null (the component is null then); an empty table gives an empty result. Texts are read in slices, so a long one
takes no more memory than its slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lowered, materialize, per_text, word_slices
from .ngram_join import groups

ERRORS = 3
SEED = 42
FEW = 32  # fingerprints under one key, up to which they are compared along with those under other keys
MANY = 4096  # fingerprints under one key that a task holds
ROWS = 1 << 19  # key rows that a task sorts on average
PER_KEY = 74  # keys of a fingerprint, about
PLAIN = lowered([0x20, *range(0x09, 0x0E)])
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit and number of bits

# fixed values of the binary Golay code: its length, the bits of a remainder, and its generator polynomial
LENGTH, CHECKS, GENERATOR = 23, 11, 0xC75


def _remainders() -> np.ndarray:
    """What each value of the 12 leading bits adds to the remainder by the generator."""
    out = np.zeros(1 << (LENGTH - CHECKS), np.int64)
    for message in range(1, len(out)):
        value = message << CHECKS
        for bit in range(LENGTH - 1, CHECKS - 1, -1):
            if value >> bit & 1:
                value ^= GENERATOR << (bit - CHECKS)
        out[message] = value
    return out


_REMAINDER = _remainders()


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each remainder its error pattern of at most 3 bits; and what leads from the nearest index to all indices within 4 bits, -1 where there are no more."""
    leader = np.zeros(1 << CHECKS, np.int64)
    for size in (1, 2, 3):
        for bits in combinations(range(LENGTH), size):
            error = sum(1 << b for b in bits)
            leader[remainder(np.array([error]))[0]] = error
    codewords = (np.arange(len(_REMAINDER)) << CHECKS) | _REMAINDER
    light = codewords[np.bitwise_count(codewords) == 7]
    steps = np.full((1 << CHECKS, 6), -1, np.int64)
    steps[:, 0] = 0
    for i in np.flatnonzero(np.bitwise_count(leader) == 3).tolist():
        steps[i, 1:] = light[light & leader[i] == leader[i]] >> CHECKS  # five codewords of weight 7 hold three given bits
    return leader, steps


def remainder(words: np.ndarray) -> np.ndarray:
    return _REMAINDER[words >> CHECKS] ^ (words & ((1 << CHECKS) - 1))


_LEADER, _STEPS = _tables()


def nearest(words: np.ndarray) -> np.ndarray:
    """Index of the codeword within 3 bits of each word of 23 bits."""
    return (words ^ _LEADER[remainder(words)]) >> CHECKS


def within_four(words: np.ndarray) -> np.ndarray:
    """Indices of all codewords within 4 bits of each word, the nearest first; -1 fills the rows."""
    steps = _STEPS[remainder(words)]
    return np.where(steps < 0, -1, nearest(words)[:, None] ^ steps)


def keys(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, side, number of the fingerprint) by table: linked fingerprints meet under some key on different sides. Side 2 meets any."""
    part = [(fps >> np.uint64(a)).astype(np.int64) & ((1 << n) - 1) for a, n in SEGMENTS]
    near, wide = [nearest(p) for p in part], [within_four(p) for p in part]
    own = np.arange(len(fps))
    table = iter(range(16))

    def row(value: np.ndarray, side: int, who: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return value | (table << 58), np.full(len(value), side, np.int8), who

    for x, y in ((0, 1), (0, 2), (1, 2)):
        yield row(part[x] << SEGMENTS[y][1] | part[y], 2, own, next(table))
    for equal in range(3):
        for other in range(3):
            if other != equal:
                t = next(table)
                yield row(part[equal] << 12 | near[other], 0, own, t)
                who, place = np.nonzero(wide[other] >= 0)
                yield row(part[equal][who] << 12 | wide[other][who, place], 1, who, t)
    t = next(table)
    who, place = np.nonzero(wide[0] >= 0)
    yield row(wide[0][who, place] << 24 | (near[1] << 12 | near[2])[who], 0, who, t)
    who, a, b = np.nonzero((wide[1][:, :, None] >= 0) & (wide[2][:, None, :] >= 0))
    yield row(near[0][who] << 24 | wide[1][who, a] << 12 | wide[2][who, b], 1, who, t)


class Forest:
    """Which fingerprints a task has joined. add() gives the links that join two groups."""

    def __init__(self, most: int = 500_000) -> None:
        self.up: dict[int, int] = {}
        self.most = most

    def root(self, x: int) -> int:
        at = x
        while (over := self.up.get(at, at)) != at:
            at = over
        while x != at:
            self.up[x], x = at, self.up.get(x, x)
        return at

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        if len(self.up) > self.most:  # a link found again is work, never a fault
            self.up.clear()
        out: tuple[list[int], list[int]] = [], []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[p] = q
                self.up.setdefault(q, q)
                out[0].append(x)
                out[1].append(y)
        return out


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= ERRORS


def pairs_in_runs(key: np.ndarray, side: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked fingerprints (a, b) under equal keys of sorted rows: each row against that one, two, three ... rows on."""
    at = np.arange(len(key))
    for step in range(1, len(key)):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            return
        go = at[((side[at] != side[at + step]) | (side[at] == 2)) & (fp[at] != fp[at + step])]
        go = go[close(fp[go], fp[go + step])]
        yield fp[go], fp[go + step]


def spanning(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) that join all of many different fingerprints that links reach: each reached one is compared with those not yet reached."""
    left = fps
    while len(left) > 1:
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            strip, reached = reached[:64], reached[64:]
            near = close(strip[:, None], left[None, :])
            hit = near.any(0)
            if hit.any():
                yield strip[near[:, hit].argmax(0)], left[hit]
                reached, left = np.concatenate((reached, left[hit])), left[~hit]


def _links(found: list[tuple[list[int], list[int]]], names: list[str]) -> pa.RecordBatch:
    a, b = (np.array([x for f in found for x in f[i]], np.uint64).view(np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int8())], names=names)


def links(fps: DataFrame, many: int = MANY) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of a table fp of different fingerprints: enough to join all that link. And the table they are read from, to discard."""
    spark = fps.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() * PER_KEY // ROWS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for start in range(0, len(own), 4096):
                some = own[start : start + 4096]
                for key, side, who in keys(some.view(np.uint64)):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(some[who])], names=["key", "side", "fp"])

    names = ["a", "b", "key", "side"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links under keys of at most `many` rows; the rows (fp, null, key, side) of the others."""
        forest = Forest()
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)]
        hot = None

        def passed(rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[2]), pa.nulls(len(rows[2]), pa.int64()), pa.array(rows[0]), pa.array(rows[1])], names=names)

        def settle(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, side, fp = rows[0], rows[1], rows[2].view(np.uint64)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            size = np.repeat(n := np.diff(np.append(first, len(key))), n)
            if (size > many).any():
                yield passed([x[size > many] for x in rows])
            some = (size > 1) & (size <= FEW)
            found = [forest.add(a, b) for a, b in pairs_in_runs(key[some], side[some], fp[some])]
            for a in first[(n > FEW) & (n <= many)].tolist():
                same = np.unique(fp[a : a + size[a]])
                found += [forest.add(x, y) for x, y in spanning(same)]
            yield _links(found, names)

        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if hot is not None:
                end = int(np.searchsorted(rows[0], hot, "right"))
                if end:
                    yield passed([x[:end] for x in rows])
                    rows = [x[end:] for x in rows]
                if len(rows[0]):
                    hot = None
            if not len(rows[0]):
                continue
            held = [np.concatenate((x, y)) for x, y in zip(held, rows, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
            yield from settle([x[:last] for x in held])
            held = [x[last:] for x in held]
            if len(held[0]) > many:
                hot = held[0][0]
                yield passed(held)
                held = [x[:0] for x in held]
        yield from settle(held)

    rows = fps.select("fp").mapInArrow(spread, "key long, side tinyint, fp long")
    rows = rows.repartition(parts, F.xxhash64("key")).sortWithinPartitions("key")
    found = materialize(rows.mapInArrow(meet, "a long, b long, key long, side tinyint"), "links")
    hot = found.where("key is not null").select("key", F.col("a").alias("fp")).distinct()
    size = hot.groupBy("key").agg(F.count("*").alias("n"))
    hot = hot.join(size, "key").withColumn("blocks", F.greatest(F.lit(2), F.ceil(F.col("n") / many).cast("int")))
    # cell (i, j) with i < j holds blocks i and j
    block = F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("blocks")).cast("int")
    cells = hot.select("key", "fp", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("block <> other")
    cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, at = Forest(), None
        held: list[int] = []

        def settle() -> pa.RecordBatch:
            return _links([forest.add(a, b) for a, b in spanning(np.array(held, np.int64).view(np.uint64))], names)

        for batch in batches:
            for *of, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != at:
                    yield settle()
                    at, held = of, []
                held.append(fp)
        yield settle()

    more = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(cell, "a long, b long, key long, side tinyint")
    return found.where("key is null").select("a", "b").union(more.select("a", "b")), found


def fingerprint(text: bytes, n: int) -> int:
    """Bits that are set in over half the hashes of the n-word shingles of a lower-cased text whose blanks are spaces."""
    ones, total, run = np.zeros(64, np.int64), 0, []
    for words in word_slices(text):
        run = run[max(0, len(run) - n + 1) :] + words
        if len(run) >= n:
            joined = b" ".join(run)
            sizes = np.fromiter(map(len, run), np.int64, len(run))
            end = np.cumsum(sizes + 1) - 1
            start = (end - sizes)[: len(run) - n + 1]
            total += len(start)
            ones += _ones([joined[a:b] for a, b in zip(start.tolist(), end[n - 1 :].tolist(), strict=True)])
    if run and not total:
        ones, total = _ones([b" ".join(run)]), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _ones(shingles: list[bytes]) -> np.ndarray:
    """How often each bit is set in the hashes of the shingles."""
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    out = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 14):
        out += np.unpackbits(h[a : a + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return out


def join(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, many: int = MANY) -> DataFrame:
    """Columns in keep, fingerprint (16 hexadecimal digits) and component_id of every document."""
    kept = docs.columns if keep is None else keep
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))

    def make():  # noqa: ANN202
        return lambda texts: [pa.array(np.array([fingerprint(t.translate(PLAIN), n) for t in texts], np.uint64).view(np.int64))]

    base = per_text(docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text")), "text", ["row", "id"], "fp long", make)
    base = materialize(base, "prints")
    classes = materialize(base.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    found, source = links(classes.select("fp"), many)
    label = groups(found)
    discard(source)
    named = classes.join(label, classes["fp"] == label["node"], "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    by_label = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    final = named.join(by_label, "label").select("fp", "component_id")
    out = base.join(final, "fp")
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)), digits("fp").alias("fingerprint"), "component_id")


def digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
