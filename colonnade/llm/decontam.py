"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as lower-cased letters and digits with single spaces between words. An item of m characters is found
where a region of a document differs from it by at most k = floor(m * budget) edits. One edit destroys at most q of the
item's q-grams, so a region within the budget keeps at least R - k q of any R of them, all within 2 k + 1 neighbouring
diagonals (place in the document less place in the item). Hits are counted in bands of 4 k + 2 diagonals that overlap by
half; bands that reach the bound are kept and verified by an alignment within the band. Very common q-grams of the
benchmark are left out of R where enough others remain, which the bound allows.

The benchmark goes to the executors in blocks of a fixed number of characters, each block against all documents, so that
what is broadcast is bounded however large the benchmark is.

q is 8; short items, of which k edits could destroy all q-grams of 8, have q-grams of 4 and the same budget.

Defined results: null or empty documents and items match nothing; an item with fewer than 4 characters matches nothing; of
several places of an item in a document the one with the fewest edits, then the first, is returned; repeated documents or
items give repeated rows; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, per_text, small_batches

Q = 8
_BASE = 0x9E3779B97F4A7C15
# its powers for joining hashes of two and of four characters
_BASE1, _BASE2, _BASE4 = (np.uint64(pow(_BASE, n, 1 << 64)) for n in (1, 2, 4))
_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BITS = 22


def normalise(text: str) -> np.ndarray:
    """Code points of the text as it is compared."""
    raw = b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACES).split())
    if raw.isascii():
        return np.frombuffer(raw, np.uint8).astype(np.uint32)
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)


def grams(a: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hashes of the q-grams, in order."""
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = a.astype(np.uint64)
    if q == 8:  # by doubling: 2, 4, then 8 characters
        h = h[:-1] * _BASE1 + h[1:]
        h = h[:-2] * _BASE2 + h[2:]
        h = h[:-4] * _BASE4 + h[4:]
    else:
        h = sum(h[i : i + n] * np.uint64(pow(_BASE, q - 1 - i, 1 << 64)) for i in range(q))
    return h * np.uint64(0xD6E8FEB86659FD93)


def gram_size(m: int, k: int) -> int:
    """q for an item of m characters and k edits: 8, or 4 where the lemma would leave no common q-gram of 8, or 0 for under 4 characters."""
    return next((q for q in (8, 4) if m - q + 1 - k * q >= 1), 0)


class Index:
    """The q-grams of a block of items, which are kept apart by their q."""

    def __init__(self, items: list[tuple[object, str]], budget: float = 0.1) -> None:
        texts = [(i, normalise(t or "")) for i, t in items]
        sizes = [gram_size(len(a), int(len(a) * budget)) for _, a in texts]
        self.parts = [Part([x for x, size in zip(texts, sizes, strict=True) if size == q], q, budget) for q in sorted({*sizes} - {0})]

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, edits, start, end) of each item in a text, places in the normalised text."""
        a = normalise(text) if self.parts else None
        return [x for part in self.parts for x in part.find(a)]


class Part:
    """The q-grams of items of one q."""

    def __init__(self, texts: list[tuple[object, np.ndarray]], q: int, budget: float, common: int = 8) -> None:
        self.q, self.ids, self.texts, self.k, self.need = q, [], [], [], []
        hashes, places, owners = [], [], []
        every = [grams(a, q) for _, a in texts]
        known, n = np.unique(np.concatenate(every) if every else np.zeros(0, np.uint64), return_counts=True)
        for (i, a), g in zip(texts, every, strict=True):
            k = int(len(a) * budget)
            rare = np.flatnonzero(n[np.searchsorted(known, g)] <= common)
            use = rare if len(rare) >= k * q + 12 else np.arange(len(g))
            hashes.append(g[use])
            places.append(use)
            owners.append(np.full(len(use), len(self.ids)))
            self.ids.append(i)
            self.texts.append(a)
            self.k.append(k)
            self.need.append(len(use) - k * q)
        h, p, o = np.concatenate(hashes), np.concatenate(places), np.concatenate(owners)
        by = np.argsort(h, kind="stable")
        h, self.place, self.owner = h[by], p[by].astype(np.int64), o[by].astype(np.int64)
        self.known, self.start, self.n = np.unique(h, return_index=True, return_counts=True)
        self.may = np.zeros(1 << _BITS, bool)
        self.may[self.known >> np.uint64(64 - _BITS)] = True
        self.k, self.need = np.array(self.k, np.int64), np.array(self.need, np.int64)
        self.step = 2 * self.k + 1

    def find(self, a: np.ndarray) -> list[tuple[object, int, int, int]]:
        g = grams(a, self.q)
        at = np.flatnonzero(self.may[g >> np.uint64(64 - _BITS)])
        if not len(at):
            return []
        i = np.searchsorted(self.known, g[at])
        i[i == len(self.known)] = 0
        same = self.known[i] == g[at]
        at, i = at[same], i[same]
        # the postings of every hit, EXPANDED at a time: how many of each item's are in each band
        n = self.n[i]
        if int(n.sum()) < int(self.need.min()):
            return []
        shift, parts = np.int64(1 << 32), []
        upto = np.cumsum(n)
        a0 = 0
        while a0 < len(at):
            a1 = max(a0 + 1, int(np.searchsorted(upto, (upto[a0 - 1] if a0 else 0) + EXPANDED, "right")))
            many = n[a0:a1]
            posting = np.repeat(self.start[i[a0:a1]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            owner, diagonal = self.owner[posting], np.repeat(at[a0:a1], many) - self.place[posting]
            band = np.floor_divide(diagonal, self.step[owner])
            parts.append(np.unique(np.concatenate((owner * shift + band, owner * shift + band - 1)) + (shift >> 1), return_counts=True))
            if len(parts) > 1 and len(parts[-1][0]) >= len(parts[0][0]) // 4:
                parts = [_added(parts)]
            a0 = a1
        key, count = _added(parts)
        owner, band = np.divmod(key, shift)
        band -= shift >> 1
        good = count >= self.need[owner]
        owner, band = owner[good], band[good]
        best: dict[int, tuple[int, int, int]] = {}
        # alignments of one width go together; regions of equal characters are aligned once
        known: dict[tuple[int, bytes], tuple[int, int, int] | None] = {}
        for k in np.unique(self.k[owner]).tolist():
            mine = np.flatnonzero(self.k[owner] == k)
            width = 2 * (2 * k + 1)
            for c in range(0, len(mine), TOGETHER):
                asked, waiting = [], []
                for o, low in zip(owner[mine[c : c + TOGETHER]].tolist(), (band[mine[c : c + TOGETHER]] * (2 * k + 1)).tolist(), strict=True):
                    end = low + len(self.texts[o]) + width
                    name = (o, a[low:end].tobytes()) if low >= 0 and end <= len(a) else None
                    if name in known:
                        got = known[name]
                        got = got and (got[0], got[1] + low, got[2] + low)
                    elif (got := exact(self.texts[o], a, low, low + width - 1)) is None:
                        if name is None or name not in (w for w, *_ in waiting[-1:]):
                            asked.append((o, low))
                            waiting.append((name, o, low))
                        continue
                    if got is not None and (o not in best or got < best[o]):
                        best[o] = got
                for (name, o, low), got in zip(waiting, align_many([self.texts[o] for o, _ in asked], a, [low for _, low in asked], width, k), strict=True):
                    if name is not None:
                        known[name] = got and (got[0], got[1] - low, got[2] - low)
                    if got is not None and (o not in best or got < best[o]):
                        best[o] = got
                if len(known) > KEPT:
                    known.clear()
        return [(self.ids[o], *x) for o, x in sorted(best.items())]


EXPANDED = 1 << 22  # postings of hits that are looked at together
TOGETHER = 1024  # regions that are aligned together
KEPT = 20_000  # alignments of a document that are kept for equal regions


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    if len(parts) == 1:
        return parts[0]
    key, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(which, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)


def exact(item: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """(0, start, end) of the first copy of an item on diagonals low..high."""
    m = len(item)
    lo, hi = max(0, low), min(len(doc), high + m)
    inside = doc[lo:hi]
    if len(inside) >= m:
        starts = np.flatnonzero((inside[: len(inside) - m + 1] == item[0]) & (inside[m - 1 :] == item[m - 1]))
        for s in starts.tolist():
            if np.array_equal(inside[s : s + m], item):
                return 0, lo + s, lo + s + m
    return None


def align_many(items: list[np.ndarray], doc: np.ndarray, lows: list[int], width: int, k: int) -> list[tuple[int, int, int] | None]:
    """align() of items on the `width` diagonals from their lows, all at once.

    A row of the arrays is what items with one beginning and one low have in common; it is parted where they differ.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(items)
    by = sorted(range(len(items)), key=lambda r: (lows[r], items[r].tolist()))
    if not by:
        return out
    sizes, low = np.array([len(items[r]) for r in by]), np.array([lows[r] for r in by], np.int64)
    longest = int(sizes.max())
    item = np.zeros((len(by), longest), np.uint32)
    for r, j in enumerate(by):
        item[r, : sizes[r]] = items[j]
    same = (item[1:] == item[:-1]) & (np.arange(longest) < np.minimum(sizes[1:], sizes[:-1])[:, None])
    common = np.where(low[1:] == low[:-1], np.where(same.all(1), longest, same.argmin(1)), -1)
    parted = np.append(-1, np.minimum(common, longest - 1))  # the step at which a row leaves the one before it; -1 from the start
    parted[1:][(common >= 0) & (sizes[1:] == sizes[:-1]) & (common >= sizes[1:])] = longest  # equal items never do
    first = np.flatnonzero(parted < 0)

    def region(r: np.ndarray) -> np.ndarray:
        places = low[r][:, None] + np.arange(longest + width + 1)
        there = (places >= 0) & (places < len(doc)) & (places < low[r][:, None] + longest + width)
        return np.where(there, doc[np.clip(places, 0, max(0, len(doc) - 1))], 0).astype(np.uint32) if len(doc) else np.zeros(places.shape, np.uint32)

    lane, big = np.arange(width, dtype=np.int32), np.int32(1 << 30)
    padded = region(first)
    start = low[first][:, None] + np.arange(width)
    d = np.where((start < 0) | (start > len(doc)), big, 0).astype(np.int32)
    dead = np.zeros(len(by), bool)
    for i in range(longest):
        new = np.flatnonzero((parted == i) & ~dead)
        if len(new):
            both = np.union1d(first, new)
            source = np.searchsorted(first, both, "right") - 1
            first, d, start, padded = both, d[source], start[source], padded[source]
        cost = d + (padded[:, i : i + width] != item[first, i : i + 1])
        up = np.concatenate((d[:, 1:], np.full((len(d), 1), big, np.int32)), 1) + 1  # a character of the item is missing
        better = up < cost
        begin = np.where(better, np.concatenate((start[:, 1:], np.zeros((len(d), 1), np.int64)), 1), start)
        cost = np.where(better, up, cost)
        # extra characters of the document
        run = np.minimum.accumulate(cost - lane, 1)
        extra = (run + lane < cost).any(1)
        if extra.any():
            source = np.maximum.accumulate(np.where(cost - lane == run, lane, 0), 1)
            begin = np.where(extra[:, None], np.take_along_axis(begin, source.astype(np.int64), 1), begin)
            cost = np.where(extra[:, None], run + lane, cost)
        d, start = cost.astype(np.int32), begin
        for r in np.flatnonzero((sizes == i + 1) & ~dead).tolist():
            g = int(np.searchsorted(first, r, "right")) - 1
            t = int(np.argmin(d[g]))
            if d[g, t] <= k:
                out[by[r]] = int(d[g, t]), max(0, int(start[g, t])), min(len(doc), int(sizes[r] + low[r] + t))
        if i % 32 == 31 and len(first):
            gone = d.min(1) > k
            if gone.any():
                ends = np.append(first[1:], len(by))
                for g in np.flatnonzero(gone).tolist():
                    dead[first[g] : ends[g]] = True
                # rows of a group that has gone are dead, so what is left keeps its places
                first, d, start, padded = first[~gone], d[~gone], start[~gone], padded[~gone]
                if not len(first):
                    break
    return out


def align(item: np.ndarray, doc: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best region of doc whose alignment with item stays on diagonals low..high, if within k."""
    m, width = len(item), high - low + 1
    # an exact copy needs no alignment
    lo, hi = max(0, low), min(len(doc), high + m)
    inside = doc[lo:hi]
    if len(inside) >= m:
        first = np.flatnonzero(inside[: len(inside) - m + 1] == item[0])
        for s in first[:64].tolist():
            if np.array_equal(inside[s : s + m], item):
                return 0, lo + s, lo + s + m
    big = np.int64(1 << 30)
    # padded so that every cell of the band has a character; 0 never equals an item's
    padded = np.zeros(m + width + 1, np.uint32)
    s, e = max(0, low), min(len(doc), low + m + width)
    if e <= s:
        return None
    padded[s - low : e - low] = doc[s:e]
    lane = np.arange(width, dtype=np.int64)
    d = np.zeros(width, np.int64)
    start = low + lane  # where the path of each diagonal began
    outside = (start < 0) | (start > len(doc))
    d[outside] = big
    for i in range(m):
        cost = d + (padded[i : i + width] != item[i])
        begin = start
        up = np.append(d[1:], big) + 1  # a character of the item is missing
        better = up < cost
        if better.any():
            cost = np.where(better, up, cost)
            begin = np.where(better, np.append(start[1:], 0), start)
        # extra characters of the document
        run = np.minimum.accumulate(cost - lane)
        extra = run + lane < cost
        if extra.any():
            source = np.maximum.accumulate(np.where(cost - lane == run, lane, 0))
            begin = begin[source]
            cost = run + lane
        d, start = cost, begin
        if i % 32 == 31 and d.min() > k:
            return None
    t = int(np.argmin(d))
    if d[t] > k:
        return None
    end = m + low + t
    return int(d[t]), max(0, int(start[t])), min(len(doc), end)


def _blocks(benchmark: DataFrame, block_chars: int) -> tuple[int, Iterator[list[tuple[object, str]]]]:
    """How many blocks of about block_chars characters the items make; and these, each read when it is needed."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    turn = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return blocks, ([(r[0], r[1]) for r in benchmark.where(turn == block).select("item_id", "text").collect()] for block in range(blocks))


def flag(docs: DataFrame, benchmark: DataFrame, budget: float = 0.1, block_chars: int = 16_000_000, name: str = "n_items") -> DataFrame:
    """The columns of docs and how many benchmark items each document holds."""
    spark, columns, out = docs.sparkSession, docs.columns, docs
    marks = []
    blocks, read = _blocks(benchmark, block_chars)
    for i, items in enumerate(read):
        sent = spark.sparkContext.broadcast(items)

        def make(sent=sent):
            index = Index(sent.value, budget)
            return lambda texts: [pa.array([len(index.find(t.decode("utf-8", "replace"))) if t else 0 for t in texts], pa.int64())]

        marks.append(f"_{name}_{i}")
        out = per_text(out, "text", None, f"{marks[-1]} long", make)
        if blocks > 1:  # one block is in memory at a time
            out = materialize(out, "flagged")
            if i:
                discard(before)
            before = out
            sent.unpersist()
    return out.select(*(F.col(f"`{c}`") for c in columns), sum((F.col(m) for m in marks), F.lit(0)).alias(name))


def find(docs: DataFrame, benchmark: DataFrame, budget: float = 0.1, block_chars: int = 16_000_000, id_col: str = "doc_id") -> DataFrame:
    """doc_id, item_id, edits, start, end, matched: one row for each benchmark item in each document."""
    spark = docs.sparkSession
    small_batches(spark)
    item_type = benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", item_type), T.StructField("edits", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("matched", T.StringType())])
    out = None
    blocks, read = _blocks(benchmark, block_chars)
    for items in read:
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, budget)
            types = [f.type for f in pa_schema(schema)]
            for batch in batches:
                got: list[tuple] = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for item_id, edits, start, end in index.find(text) if text else ():
                        said = "".join(map(chr, normalise(text)[start:end]))
                        got.append((doc_id, item_id, edits, start, end, said))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], types[i]) for i in range(6)], names=schema.names)

        one = docs.select(id_col, "text").mapInArrow(run, schema)
        if blocks > 1:  # one block is in memory at a time
            one = materialize(one, "found")
            sent.unpersist()
        out = one if out is None else out.unionByName(one)
    return out


def pa_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
