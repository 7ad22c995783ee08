"""N-gram Jaccard join by T-occurrence search with DivideSkip, and the groups that its links form.

A document is the set of its distinct word n-grams as 64-bit hashes (two n-grams of one hash count as one); documents with
the same set, by a 128-bit digest, are one class, and only classes are compared. Two sets link if their Jaccard similarity
reaches a threshold. A set of n elements shares T >= n p / 100 of them with all it links with. All steps are exact:

1. Order. One order of all elements, rarest first: by how many sets hold elements of the same slot of a table of COUNTERS
   counts over all documents, then by hash. Any order gives the same links; this one keeps lists short.
2. Short lists. DivideSkip leaves the longest lists of a set unmerged. In the inverted index a set is entered under its
   n - T + 1 + E first elements, E a third of n - T, so that linked sets are together on E + 1 lists. Entries are sent as
   arrays, by ranges of elements; lists of one set end there. Of a list that many sets of one task are on, two entries go to
   its range to show that it lives, the others go straight to the result: no list gathers in a task. Sets on fewer than
   E + 1 lists with others link with nothing. The others skip the last E of their lists; linked sets keep a common one.
3. Centers. Of each list the set that is on most lists (of near copies that is the text they vary) is the center. Each set
   is checked against the centers of its lists, and the links are contracted to groups.
4. The rest. Linked sets of different groups are both on lists of some center. Where the sets around a center are of more
   than one group, those outside its largest group are searched among all of them, in cells of bounded size. A cell gives
   only the links that join groups, so thousands of near copies never become all their pairs.

A check is a T-occurrence search in a block of sets: inverted lists over the block, the short ones merged, the long ones
probed by binary search for those sets that can still reach the overlap.

Defined results: null text and text without words give an empty set that links with nothing (its group is its own id);
texts shorter than n words are one shingle; equal sets always link; equal ids and null ids are kept as rows, and a null id
never names a group unless all ids of the group are null; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, rolling, text_bytes, word_hashes

BITS = 22
COUNTERS = 1 << BITS  # slots of the table that orders elements
CHUNK = 1 << 14
RANGE = 1 << 20  # entries of the index that a range has on average, and that a task holds
HOT = 8  # entries of a task on one list, beyond which they go straight to the result
BLOCK = 512
MARKS = 1 << 27  # slots that mark the sets to fetch


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text, ASCII-lower-cased; null is an empty text."""
    data, bounds = text_bytes(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + (1 << 18), "right")) - 1)
        ids, at, _, _ = word_hashes(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        runs = rolling(ids, n)
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if y - x >= n:
                s = np.sort(runs[x : y - n + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            elif y > x:
                yield rolling(ids[x:y], y - x) + np.uint64(y - x)
            else:
                yield ids[:0]
        a = b


def shingles(text: bytes, n: int) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.binary()), n))


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


class Once:
    """Which keys a task has met, as long as they are not too many; a key met again is work saved, never a result."""

    def __init__(self, most: int = 300_000) -> None:
        self.seen, self.most = set(), most

    def first(self, key: bytes) -> bool:
        if key in self.seen:
            return False
        if len(self.seen) < self.most:
            self.seen.add(key)
        return True


def slots(s: np.ndarray) -> np.ndarray:
    return ((s * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


def least_overlap(n: int, percent: int) -> int:
    """T of a set of n elements."""
    return -(-percent * n // 100)


def needed(a: int, b: int, percent: int) -> int:
    """Least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def spare(n: int, percent: int) -> int:
    """E: by how many lists a set of n elements is entered under more than it needs to."""
    return (n - least_overlap(n, percent)) // 3


def short_lists(s: np.ndarray, order: np.ndarray, percent: int) -> np.ndarray:
    """The elements under which a set is entered: the first ones in the order (slot's rank, hash)."""
    n = len(s)
    return s[np.argsort(order[slots(s)], kind="stable")[: n - least_overlap(n, percent) + 1 + spare(n, percent)]]


class Index:
    """Inverted lists over a block of sets."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent, self.sizes = percent, np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        by = np.argsort(values, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[by]
        self.known, self.start = np.unique(values[by], return_index=True)
        self.end = np.append(self.start[1:], len(values))

    def search(self, query: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Numbers of the allowed sets that link with the query: DivideSkip."""
        at = np.minimum(np.searchsorted(self.known, query), max(0, len(self.known) - 1))
        at = at[self.known[at] == query] if len(self.known) else at[:0]
        least = least_overlap(len(query), self.percent)
        if len(at) < least or not len(query):
            return at[:0]
        at = at[np.argsort(self.end[at] - self.start[at], kind="stable")]
        lists = [self.owners[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]
        short, long_ = lists[: len(lists) - least + 1], lists[len(lists) - least + 1 :]
        count = merged(short, len(self.sizes))
        need = -(-self.percent * (len(query) + self.sizes) // (100 + self.percent))
        left = len(long_)
        open_ = np.flatnonzero((count > 0) & allowed & (need <= np.minimum(self.sizes, len(query))) & (count + left >= need))
        count, need = count[open_], need[open_]
        for one in reversed(long_):
            if not len(open_):
                break
            place = np.searchsorted(one, open_)
            count += one[np.minimum(place, len(one) - 1)] == open_
            left -= 1
            can = count + left >= need
            if not can.all():
                open_, count, need = open_[can], count[can], need[can]
        return open_


def merged(lists: list[np.ndarray], n: int) -> np.ndarray:
    """How many of the lists each of n sets is on: by a heap over their heads if they are few and short, else in one pass."""
    if sum(map(len, lists)) > 64:
        return np.bincount(np.concatenate(lists), minlength=n)
    out = np.zeros(n, np.int64)
    for i in heapq.merge(*(x.tolist() for x in lists)):
        out[i] += 1
    return out


def divide_skip(center: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Numbers of the sets that link with the center."""
    return Index(sets, percent).search(center, np.ones(len(sets), bool)).tolist()


def groups(edges: DataFrame, limit: int = 40) -> DataFrame:
    """(node, label) of the nodes of edges (a, b): label is the least node that links reach. Large-star and small-star steps."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(limit):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        new = materialize(small, "edges")
        discard(now)
        discard(large)
        now = new
        # every node has one edge and no target has one: the stars are complete
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
        mark = state
    raise RuntimeError("links did not contract")


def _items(items: list[np.ndarray]) -> pa.ListArray:
    values = pa.array(np.concatenate(items).view(np.int64) if items else np.zeros(0, np.int64))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, items)]), pa.int32()), values)


def _set(item: pa.ListScalar) -> np.ndarray:
    return item.values.to_numpy().view(np.uint64)


def _shingled(named: DataFrame, n: int) -> DataFrame:
    """row, id, n (size of the set) and key of each document; and, in rows with a chunk, counts of the slots of sets."""
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in named.select("row", "id").schema), *T._parse_datatype_string("n long, key binary, chunk int, counts binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, once, kinds = np.zeros(COUNTERS, np.uint32), Once(), None
        for batch in batches:
            kinds = batch.column(0).type, batch.column(1).type
            sizes, keys, new = [], [], []
            for s in shingle_sets(batch.column(2), n):
                sizes.append(len(s))
                keys.append(digest(s) if len(s) else None)
                if len(s) and once.first(keys[-1]):
                    new.append(slots(s))
                    if len(new) >= 1000:
                        np.add.at(counts, np.concatenate(new), np.uint32(1))
                        new.clear()
            if new:
                np.add.at(counts, np.concatenate(new), np.uint32(1))
            m = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=schema.names)
        if kinds:
            chunks, packed = _packed({i: x for i, x in enumerate(counts.reshape(-1, CHUNK)) if x.any()})
            m = len(chunks)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, kinds[0]), pa.nulls(m, kinds[1]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), chunks, packed], names=schema.names)

    return materialize(named.select("row", "id", "text").mapInArrow(run, schema), "classes")


def _packed(sums: dict[int, np.ndarray]) -> tuple[pa.Array, pa.Array]:
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.array(list(sums), pa.int32()), pa.array([pack(x.tobytes()) for x in sums.values()], pa.binary())


def _order(shingled: DataFrame) -> np.ndarray:
    """Rank of each slot: eight steps for a doubling of its count. COUNTERS bytes at any size of the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint32)
                sums[chunk] = np.minimum(sums[chunk] + x.astype(np.uint64), 0xFFFFFFFF).astype(np.uint32) if chunk in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays(list(_packed(sums)), names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    parts = shingled.where("chunk is not null").select("chunk", "counts").mapInArrow(add, schema)
    out = np.zeros(COUNTERS, np.uint8)
    for r in parts.repartition(32, "chunk").mapInArrow(add, schema).collect():  # at most COUNTERS / CHUNK rows
        x = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), np.uint32)
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.minimum(np.round(8 * np.log2(1.0 + x)), 255)
    return out


def _lists(docs: DataFrame, order: np.ndarray, n: int, percent: int, ranges: int, text: str) -> DataFrame:
    """(rank, sig, key): the entries of all short lists that more than one set is on. An entry may be there more than once."""
    sent = docs.sparkSession.sparkContext.broadcast(order)
    schema = "part int, straight boolean, sigs binary, keys binary"

    def rows(part: list[int], straight: bool, sigs: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([straight] * len(part)), pa.array([x.tobytes() for x in sigs], pa.binary()), pa.array([x.tobytes() for x in keys], pa.binary())], names=["part", "straight", "sigs", "keys"])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, once = sent.value, Once()
        sigs, keys, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            names = np.frombuffer(b"".join(keys), "V16")
            sig, key = np.concatenate(sigs), np.repeat(np.arange(len(keys)), [len(x) for x in sigs])
            by = np.argsort(sig, kind="stable")
            sig, key = sig[by], key[by]
            first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            turn = np.arange(len(sig)) - np.repeat(first, np.diff(np.append(first, len(sig))))
            many = np.repeat(np.diff(np.append(first, len(sig))) > HOT, np.diff(np.append(first, len(sig))))
            aside = many & (turn > 1)
            go, stay = np.flatnonzero(~aside), np.flatnonzero(aside)
            of = ((sig[go] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            yield rows(of[cuts].tolist(), False, np.split(sig[go], cuts[1:]), np.split(names[key[go]], cuts[1:]))
            for a in range(0, len(stay), 1 << 16):
                some = stay[a : a + (1 << 16)]
                yield rows([int(sig[some[0]] % np.uint64(ranges))], True, [sig[some]], [names[key[some]]])
            sigs.clear()
            keys.clear()
            held = 0

        for batch in batches:
            for s in shingle_sets(batch.column(0), n):
                if len(s) and once.first(key := digest(s)):
                    sigs.append(short_lists(s, order, percent))
                    keys.append(key)
                    held += len(sigs[-1])
                    if held >= RANGE:
                        yield from flush()
        if held:
            yield from flush()

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sigs, keys = None, [], []

        def out(sig: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(sig), 1 << 16):
                names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(k := key[a : a + (1 << 16)]), [None, pa.py_buffer(k.tobytes())])
                some = sig[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(sent.value[slots(some)].astype(np.int16)), pa.array(some.view(np.int64)), names.cast(pa.binary())], names=["rank", "sig", "key"])

        def settle() -> Iterator[pa.RecordBatch]:
            if sigs:
                sig, key = np.concatenate(sigs), np.concatenate(keys)
                by = np.argsort(sig, kind="stable")
                sig, key = sig[by], key[by]
                same = sig[1:] == sig[:-1]
                at = np.flatnonzero(np.append(same, False) | np.append(False, same))
                sig, key = sig[at], key[at]
                half = key.view(np.uint64).reshape(-1, 2)
                by = np.lexsort((half[:, 1], half[:, 0], sig))
                sig, key, half = sig[by], key[by], half[by]
                same = sig[1:] == sig[:-1]
                other = np.append(True, ~same | (half[1:] != half[:-1]).any(1)) if len(sig) else np.zeros(0, bool)
                sig, key = sig[other], key[other]
                same = sig[1:] == sig[:-1]
                at = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(sig) else []
                yield from out(sig[at], key[at])
                sigs.clear()
                keys.clear()

        for batch in batches:
            for p, straight, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, "V16")
                if straight:
                    yield from out(x, y)
                    continue
                if p != part:
                    yield from settle()
                    part = p
                sigs.append(x)
                keys.append(y)
        yield from settle()

    sent_rows = docs.select(text).mapInArrow(enter, schema).repartition(ranges, "part").sortWithinPartitions("part")
    return materialize(sent_rows.mapInArrow(live, "rank smallint, sig long, key binary"), "lists")


def _sets(keys: DataFrame, docs: DataFrame, n: int, text: str) -> DataFrame:
    """(key, items) of at least the classes in keys, as a table. The marks that select them take MARKS bits at any size."""
    slot = F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), F.lit(MARKS))
    marks = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 15).cast("int").alias("i")).agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("bits"))
    table = np.zeros((MARKS >> 15, 4096), np.uint8)
    for r in marks.collect():  # at most MARKS / 32,768 rows
        table[r["i"]] = np.frombuffer(r["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(table.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, once = sent.value, Once()
        for batch in batches:
            found, items, held = [], [], 0
            for s in shingle_sets(batch.column(0), n):
                if len(s):
                    key = digest(s)
                    at = int.from_bytes(key[:4], "big") % MARKS
                    if table[at >> 3] >> (at & 7) & 1 and once.first(key):
                        found.append(key)
                        items.append(s)
                        held += len(s)
                        if held >= RANGE:
                            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), _items(items)], names=["key", "items"])
                            found, items, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), _items(items)], names=["key", "items"])

    found = docs.select(text).mapInArrow(run, "key binary, items array<long>")
    return materialize(found.join(keys, "key", "left_semi").groupBy("key").agg(F.first("items").alias("items")), "sets")


def _blocks(name: str, count: str) -> Column:
    """The block of a set among those that `count` of them make."""
    return F.pmod(F.xxhash64(name), F.ceil(F.col(count) / BLOCK)).cast("int")


def _in_groups(rows: DataFrame, by: list[str], found: Callable[[list[tuple]], list[tuple[bytes, bytes]]]) -> DataFrame:
    """Links (a, b) that found() gives for the rows of each value of the columns `by`, which come first; all rows of one are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            plain = [c.to_pylist() for c in batch.columns[:-1]]
            for i, row in enumerate(zip(*plain, strict=True)):
                if held and held[0][: len(by)] != row[: len(by)]:
                    yield _links(found(held))
                    held.clear()
                held.append((*row, _set(batch.columns[-1][i])))
        if held:
            yield _links(found(held))

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a binary, b binary")


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _to_centers(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (center, key) of the pairs (center, key) in met, searched in blocks of the sets around a center."""
    # as a table, so that Spark can split the sets of one center in the join
    size = materialize(met.groupBy("center").agg(F.count("*").alias("size")), "sizes")
    around = met.join(size, "center").join(sets, "key").select("center", _blocks("key", "size").alias("block"), F.lit(False).alias("is_center"), "key", "items")
    middle = size.join(sets, size["center"] == sets["key"]).select("center", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1)).alias("block"), F.lit(True).alias("is_center"), "key", "items")

    def found(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        (center,) = (r for r in rows if r[2])
        rest = [r for r in rows if not r[2]]
        return [(center[3], rest[i][3]) for i in divide_skip(center[4], [r[4] for r in rest], percent)]

    return _in_groups(around.union(middle), ["center", "block"], found)


def _around_centers(met: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between sets around one center that are in different groups: enough of them to join all groups that link."""
    named = materialize(met.join(label, met["key"] == label["node"], "left").select("center", "key", F.coalesce("label", "key").alias("label")), "met")
    many = named.groupBy("center", "label").agg(F.count("*").alias("n"))
    state = many.groupBy("center").agg(F.sum("n").alias("size"), F.max("n").alias("largest"), F.max_by("label", F.struct("n", "label")).alias("main")).where("size > largest")
    state = materialize(state.select("center", "main", "size", (F.col("size") - F.col("largest")).alias("others")), "sizes")
    rows = named.join(state, "center").withColumn("aside", F.col("label") != F.col("main")).join(sets, "key")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.ceil(F.col(count) / BLOCK).cast("int") - 1))
    asks = rows.where("aside").select("center", _blocks("key", "others").alias("q"), every("size").alias("d"), F.lit(True).alias("asks"), "aside", "key", "label", "items")
    told = rows.select("center", every("others").alias("q"), _blocks("key", "size").alias("d"), F.lit(False).alias("asks"), "aside", "key", "label", "items")

    def found(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        queries, data = [r for r in rows if r[3]], [r for r in rows if not r[3]]
        numbers = {x: i for i, x in enumerate({r[6]: 0 for r in rows})}
        root = np.arange(len(numbers))
        if len(root) < 2 or not data:
            return []
        keys, of = np.array([r[5] for r in data], object), np.array([numbers[r[6]] for r in data])
        aside = np.array([r[4] for r in data])
        index, out = Index([r[7] for r in data], percent), []
        for r in queries:
            own = root[numbers[r[6]]]
            allowed = (root[of] != own) & ~(aside & (keys < r[5]))  # of two sets that both ask the lesser key does
            if allowed.any():
                for i in index.search(r[7], allowed).tolist():
                    if root[of[i]] != root[numbers[r[6]]]:
                        out.append((r[5], data[i][5]))
                        root[root == root[of[i]]] = root[numbers[r[6]]]
        return out

    return _in_groups(asks.union(told), ["center", "q", "d"], found)


def join(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns in keep, n_shingles, set_key (equal for equal sets) and component_id of every document."""
    kept = docs.columns if keep is None else keep
    spark = docs.sparkSession
    base = _shingled(docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept))).alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text")), n)
    order = _order(base)
    base = base.where("chunk is null")
    entries = base.agg(F.coalesce(F.sum(F.col("n") * (100 - percent) / 75 + 1), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(entries) // RANGE))
    lists = _lists(docs, order, n, percent, ranges, text)
    classes = base.where("key is not null").groupBy("key").agg(F.min("id").alias("first_id"), F.max("n").alias("n"))
    own = lists.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("rank", "sig"))).alias("all")).withColumn("weight", F.size("all"))
    own = own.join(classes.select("key", F.expr(f"(n - ({percent} * n + 99) div 100) div 3").cast("int").alias("spare")), "key").where("weight > spare")
    short = materialize(own.select("key", "weight", F.explode(F.slice("all", F.lit(1), F.col("weight") - F.col("spare")).getField("sig")).alias("sig")), "lists")
    discard(lists)
    center = short.groupBy("sig").agg(F.max_by("key", F.struct("weight", "key")).alias("center"))
    met = materialize(short.join(center, "sig").where("key <> center").select("center", "key").distinct(), "met")
    discard(short)
    sets = _sets(met.select("key").union(met.select("center")).distinct(), docs, n, text)
    links = materialize(_to_centers(met, sets, percent), "links")
    label = groups(links)
    more = materialize(_around_centers(met, label, sets, percent), "links")
    discard(sets)
    discard(met)
    if not more.isEmpty():
        label = groups(links.union(more))
    named_by = classes.join(label, classes["key"] == label["node"], "left").select("key", "first_id", "label")
    by_label = named_by.where("label is not null").groupBy("label").agg(F.min("first_id").alias("component"))
    final = named_by.join(by_label, "label", "left").select("key", F.coalesce("component", "first_id").alias("component"))
    out = base.select("row", "id", "n", "key").join(final, "key", "left")
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)), F.col("n").alias("n_shingles"), F.col("key").alias("set_key"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))
