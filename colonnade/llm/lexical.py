"""Ranked lexical search in an inverted index of two levels: byte impacts for bounds, frequencies for exact integer scores.

Terms are runs of letters and digits of ASCII and of all other characters beyond ASCII; only A-Z are lower-cased. A document's
score is the sum, over an item's terms and with repeats, of the term's weight times an impact, an integer below SCALE from the
term's frequency in the document and the document's length relative to the mean.

The index. Documents are cut into shards of at most SHARD_DOCS documents and about SHARD_TERMS terms as they are read. A row of
the index is a term in a shard: which documents hold it (numbers in the shard), level 1 - a byte each, the impact over UNIT
rounded up - and level 2 - the frequencies. A row without a term lists the shard's ids and lengths. A frequent term has a row a
shard, so no list is long, however frequent the term. The two levels are columns: bounds do not read frequencies.

Search. Items are taken in blocks of at most BLOCK_ITEMS items and BLOCK_CHARS characters; the terms of a block are broadcast
(no more than its characters) and select the index rows that are sent, by shard. In each shard bytes add up to an upper bound of
every document for every item; a byte is above its impact by less than UNIT, which gives the lower bound. A task drops what does
not reach the k-th lower bound that it has met itself; then the k-th lower bound of all is known, and every document whose upper
bound reaches it is scored again with level 2, in 64-bit integers. So results are exact, ties included.

Defined results: null text and text without terms are documents without terms: they count neither in N nor in L and never score;
items without terms, or whose terms are in no document or in all, have no rows; rows that repeat an id or an item are documents
or items of their own; equal scores are ranked by id, null ids last; an empty table gives an empty result. Texts are read in
slices, whole.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binaries, discard, lowered, materialize, shared_dir, small_batches, word_slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
PLAIN = lowered([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
SHARD_DOCS, SHARD_TERMS = 4096, 1 << 20
BLOCK_ITEMS, BLOCK_CHARS = 256, 1 << 22
SCALE = 1_000_000  # impacts are below it
UNIT = -(-SCALE // 255)
SLOPE, LENGTH_SHARE = 8, 75  # of the scoring rule: how fast a frequency saturates, and the percentage of the length in it


def stretch(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents of n terms."""
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * docs) // max(1, terms)


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + SLOPE * stretch(n, docs, terms))


class Shard:
    """Documents that a task has read since its last shard."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.terms: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, id_, text: bytes) -> None:  # noqa: ANN001
        found: list[np.ndarray] = []
        n = 0
        for words in word_slices(text.translate(PLAIN)):
            found.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
            n += len(words)
            if len(found) > 1:  # of a long text only the counts are held
                found = [np.concatenate(found)]
        if n:
            terms, counts = np.unique(found[0], return_counts=True)
            self.terms.append(terms)
            self.counts.append(counts)
            self.docs.append(np.full(len(terms), len(self.ids)))
            self.held += len(terms)
            self.ids.append(id_)
            self.lengths.append(n)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.held >= SHARD_TERMS

    def rows(self, docs: int, terms: int) -> Iterator[tuple[pa.Array, ...]]:
        """(term, holders, docs, impacts, tfs) of all terms, some thousand terms at a time."""
        term, doc, tf = np.concatenate(self.terms), np.concatenate(self.docs), np.concatenate(self.counts)
        by = np.argsort(term, kind="stable")
        term, doc, tf = term[by], doc[by], tf[by]
        level = -(-impacts(tf, np.array(self.lengths)[doc], docs, terms) // UNIT)
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        end, names = np.append(first[1:], len(term)), list(self.number)
        for a in range(0, len(first), 1 << 14):
            lo, hi = int(first[a]), int(end[min(a + (1 << 14), len(first)) - 1])
            cuts = np.append(first[a : a + (1 << 14)], hi) - lo
            offsets = pa.array(cuts.astype(np.int32))
            bytes_ = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets.buffers()[1], pa.py_buffer(level[lo:hi].astype(np.uint8).tobytes())])
            yield (
                pa.array(names[a : a + (1 << 14)], pa.binary()).cast(pa.string()),
                pa.array(np.diff(cuts).astype(np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(doc[lo:hi].astype(np.int32))),
                bytes_,
                pa.ListArray.from_arrays(offsets, pa.array(tf[lo:hi].astype(np.int32))),
            )


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> None:
    """Write the index of all documents to path. Two passes over the texts: sizes, then shards; nothing is shuffled."""
    small_batches(docs.sparkSession)
    n = F.regexp_count(F.col(text), F.lit(TERM)).cast("long")
    size = docs.select(n.alias("n")).where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    all_docs, all_terms = size["docs"], size["terms"]
    inside = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))
    kind = inside.schema["id"].dataType
    schema = T._parse_datatype_string("shard long, term string, holders int, docs array<int>, impacts binary, tfs array<int>")
    schema = T.StructType([*schema.fields, T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made = Shard(), 0

        def flush(part: int, like: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal shard, made
            if shard.ids:
                number = (part << 32) + made
                ids = pa.ListArray.from_arrays(pa.array([0, len(shard.ids)], pa.int32()), pa.array(shard.ids, like))
                lengths = pa.ListArray.from_arrays(pa.array([0, len(shard.ids)], pa.int32()), pa.array(shard.lengths, pa.int64()))
                none = [pa.nulls(1, k) for k in (pa.string(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *none, ids, lengths], names=schema.names)
                for row in shard.rows(all_docs, all_terms):
                    m = len(row[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), *row, pa.nulls(m, ids.type), pa.nulls(m, lengths.type)], names=schema.names)
                shard, made = Shard(), made + 1

        part, like = 0, None
        for batch in batches:
            like = batch.column(0).type
            for id_, t, part in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                shard.add(id_, t)
                if shard.full():
                    yield from flush(part, like)
        yield from flush(part, like)

    inside.mapInArrow(run, schema).write.parquet(f"{path}/index")
    totals = docs.sparkSession.createDataFrame([(all_docs, all_terms)], "docs long, terms long")
    totals.coalesce(1).write.parquet(f"{path}/totals")


def terms_of(text: str | None) -> Counter:
    """An item's terms and how often it has them."""
    return Counter(w for words in word_slices((text or "").encode().translate(PLAIN)) for w in words)


def weight(docs: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holders + 1)))


def _blocks(items: DataFrame, item_col: str, text: str) -> Iterator[list[tuple[object, str | None]]]:
    """Items in blocks of bounded size, as they come; the driver holds one block and one partition's batch."""
    block, chars = [], 0
    for r in items.select(F.col(item_col), F.col(text)).toLocalIterator():
        block.append((r[0], r[1]))
        chars += len(r[1] or "")
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _bounds(rows: DataFrame, wants: dict[str, list[tuple[int, int]]], n_items: int, k: int) -> DataFrame:
    """(item, shard, doc, id, length, upper, lower) of documents whose upper bound reaches the k-th lower bound that their task has met."""
    kind = rows.schema["ids"].dataType.elementType
    schema = T._parse_datatype_string("item int, shard long, doc int, length long, upper long, lower long")
    schema = T.StructType([*schema.fields, T.StructField("id", kind)])
    sent = rows.sparkSession.sparkContext.broadcast({t: (np.array([i for i, _ in w]), np.array([x for _, x in w])) for t, w in wants.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64) for _ in range(n_items)]  # lower bounds, the largest k
        shard, held, head = None, [], None

        def settle() -> Iterator[pa.RecordBatch]:
            if head is None or not held:
                return
            ids, lengths = head
            sums, most = (np.zeros((n_items, len(lengths)), np.int64) for _ in range(2))
            for term, docs, levels in held:
                item, w = sent.value[term]
                sums[item[:, None], docs] += w[:, None] * levels.astype(np.int64)
                most[item[:, None], docs] += w[:, None]
            upper, lower = sums * UNIT, sums * UNIT - most * (UNIT - 1)
            rows_ = [[], [], []]
            for i in np.flatnonzero(sums.any(1)).tolist():
                there = np.flatnonzero(sums[i])
                top = np.sort(np.concatenate((best[i], lower[i, there])))[-k:]
                best[i] = top
                go = there[upper[i, there] >= top[0]] if len(top) == k else there
                rows_[0].append(np.full(len(go), i))
                rows_[1].append(go)
            if rows_[0]:
                i, d = np.concatenate(rows_[0]), np.concatenate(rows_[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i.astype(np.int32)), pa.array(np.full(len(i), shard)), pa.array(d.astype(np.int32)), pa.array(lengths[d]), pa.array(upper[i, d]), pa.array(lower[i, d]), ids.take(pa.array(d))],
                    names=schema.names,
                )

        for batch in batches:
            shards, terms = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for j, (s, term) in enumerate(zip(shards.tolist(), terms, strict=True)):
                if s != shard:
                    yield from settle()
                    shard, held, head = s, [], None
                if term is None:
                    head = batch.column(4)[j].values, batch.column(5)[j].values.to_numpy()
                else:
                    held.append((term, batch.column(2)[j].values.to_numpy(), np.frombuffer(batch.column(3)[j].as_buffer(), np.uint8)))
        yield from settle()

    sent_rows = rows.select("shard", "term", "docs", "impacts", "ids", "lengths").repartition("shard").sortWithinPartitions("shard")
    return sent_rows.mapInArrow(run, schema)


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 10, item_col: str = "item_id", id_name: str = "doc_id", text: str = "text") -> DataFrame:
    """item_id, rank, id and score of the k documents of the index at path that score highest for each item."""
    index = spark.read.parquet(f"{path}/index")
    all_docs = spark.read.parquet(f"{path}/totals").first()["docs"]
    kind = items.schema[item_col].dataType
    out = []
    for block in _blocks(items, item_col, text):
        counts = [terms_of(t) for _, t in block]
        asked = spark.createDataFrame([(t.decode(),) for t in sorted({t for c in counts for t in c})], "term string")
        asked = F.broadcast(asked)
        holders = index.join(asked, "term").groupBy("term").agg(F.sum("holders").alias("n")).collect()  # at most the block's terms
        weights = {r["term"]: w for r in holders if (w := weight(all_docs, r["n"]))}
        wants: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, c in enumerate(counts):
            for t, times in c.items():
                if (t := t.decode()) in weights:
                    wants[t].append((i, times * weights[t]))
        if not wants:
            continue
        asked = F.broadcast(spark.createDataFrame([(t,) for t in wants], "term string"))
        rows = index.where("term is null").drop("tfs").unionByName(index.drop("tfs").join(asked, "term", "left_semi"))
        near = bounds = materialize(_bounds(rows, wants, len(block), k), "bounds")
        place = W.partitionBy("item").orderBy(F.col("lower").desc())
        least = near.select("item", "lower", F.row_number().over(place).alias("place")).where(F.col("place") <= k).groupBy("item").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(1).alias("least"))
        near = near.join(F.broadcast(least), "item").where("upper >= least")  # least: at most BLOCK_ITEMS rows
        told = spark.createDataFrame([(i, t, w) for t, many in wants.items() for i, w in many], "item int, term string, w long")
        pairs = near.join(F.broadcast(told), "item").select("item", "shard", "doc", "id", "length", "term", "w")
        level2 = index.join(asked, "term", "left_semi").select("shard", "term", "docs", "tfs")
        scored = pairs.join(level2, ["shard", "term"]).withColumn("at", F.array_position("docs", F.col("doc"))).where("at > 0")
        scored = scored.withColumn("impact", _impact(F.element_at("tfs", F.col("at").cast("int")).cast("long"), F.col("length"), spark, path))
        scored = scored.groupBy("item", "shard", "doc", "id").agg(F.sum(F.col("w") * F.col("impact")).alias("score")).where("score > 0")
        order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        first = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        out.append(materialize(first.join(F.broadcast(named), "item").select("item_id", "rank", F.col("id").alias(id_name), "score"), "found"))
        discard(bounds)
    if not out:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField(id_name, index.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())]))
    whole = out[0]
    for one in out[1:]:
        whole = whole.union(one)
    return whole


def _impact(tf: Column, n: Column, spark: SparkSession, path: str) -> Column:
    """The same as impacts(), in 64-bit integers of Spark."""
    total = spark.read.parquet(f"{path}/totals").first()
    m = F.lit(100 - LENGTH_SHARE) + F.call_function("div", LENGTH_SHARE * total["docs"] * n, F.lit(max(1, total["terms"])))
    return F.call_function("div", 1_000_000_000 * tf, 1000 * tf + SLOPE * m)


def oracle(k: int = 10) -> str:
    """SQL over documents and benchmark that scores every pair with a common term."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
docs AS (SELECT r, doc_id, len(words) AS n FROM d WHERE len(words) > 0),
size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, size GROUP BY term, docs),
items AS (SELECT row_number() OVER () AS i, item_id, {words} AS words FROM benchmark),
asked AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(words) AS term FROM items) GROUP BY ALL),
scored AS (SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + {SLOPE} * ({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN docs USING (r), size GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= {k}
"""


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
