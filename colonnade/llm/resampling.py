"""Importance resampling towards a target distribution, over hashed features found by word-id suffix arrays.

Features are all runs of 1 to N = 3 consecutive words. A bucket of features has a gain, the logarithm of how much more of the
target's features than of the documents' fall in it; a document weighs the sum of its features' gains, and documents are drawn
without return by weight plus Gumbel noise from a hash of the id.

Suffix arrays. A task turns words into ids in blocks of about TOKENS words and sorts the suffixes of a block by their first N ids
(no feature is longer, so suffixes are told apart no further). Neighbours with a common prefix (LCP) of n or more words form a
run: one n-gram, repeated. The bytes of a run are hashed once: the CRC-32 of a joined n-gram follows from those of its words,
as appending zero bytes is linear. The run's bucket is then scattered back to all its occurrences, which are counted (first
pass, one row a bucket and task is shuffled) or looked up in the table of gains and summed by document (second pass).

The draw. Documents are ranked by a range partition on score, id and row, numbered within ranges, and ranges get the number of
rows before them: no task holds more than its range, however many rows tie.

Defined results: null text and text without words have no features and weight 0; a null id is the empty text in its hash and
comes after other ids; rows that repeat an id are ranked one by one; an empty target gains by S alone; an empty table gives an
empty result. Very long texts are read in slices that keep the last words before them.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binaries, lowered, materialize, per_text, small_batches, word_slices

N = 3
BUCKETS = 10_000
SEED = 42
TOKENS = 1 << 18  # words of a block
VOCABULARY = 1 << 20  # ids that a task holds; N of them fit in 63 bits
POLYNOMIAL = 0xEDB88320  # fixed value: of CRC-32, lowest bit first
PLAIN = lowered([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def _shift_tables() -> np.ndarray:
    """[n, i, v]: what n zero bytes make of a CRC whose byte i is v and whose other bytes are zero, for n up to 255."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(POLYNOMIAL), step >> 1)
    out = np.zeros((256, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(255):
        out[n + 1] = out[n] >> 8 ^ step[out[n] & 255]
    return out


_SHIFT = _shift_tables()


def extended(crc: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of a joined to b, from that of a, that of b and the bytes of b."""
    crc, size = crc.copy(), size.copy()
    while True:
        now = np.minimum(size, 255)
        crc = _SHIFT[now, 0, crc & 255] ^ _SHIFT[now, 1, crc >> 8 & 255] ^ _SHIFT[now, 2, crc >> 16 & 255] ^ _SHIFT[now, 3, crc >> 24]
        size -= now
        if not size.any():
            return crc ^ tail


class Features:
    """Buckets of all features of texts. One is made per task and keeps the ids of words."""

    def __init__(self, buckets: int = BUCKETS) -> None:
        self.buckets = buckets
        self._forget()

    def _forget(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.crc, self.spaced, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _number(self, words: list[bytes]) -> np.ndarray:
        if len(self.ids) + len(words) > VOCABULARY:
            self._forget()
        known = len(self.ids)
        out = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if len(self.ids) > known:
            new = list(self.ids)[known:]
            self.crc = np.append(self.crc, np.fromiter(map(zlib.crc32, new), np.uint32, len(new)))
            self.spaced = np.append(self.spaced, np.fromiter((zlib.crc32(b" " + w) for w in new), np.uint32, len(new)))
            self.size = np.append(self.size, np.fromiter(map(len, new), np.int64, len(new)) + 1)
        return out

    def blocks(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By block: the text of each of its pieces, where each piece begins, and buckets[n - 1, i] of the n words from word i, -1 if there are none.

        A long text is in several pieces. A piece begins with the last words of the one before, and features of these alone do not count again.
        """
        words: list[bytes] = []
        of, start, again = [], [], []
        for i, text in enumerate(texts):
            before: list[bytes] = []
            for some in word_slices(text.translate(PLAIN)):
                for a in range(0, len(some), TOKENS):
                    piece = before + some[a : a + TOKENS]
                    of.append(i)
                    start.append(len(words))
                    again.append(len(before))
                    words += piece
                    before = piece[-N + 1 :]
                    if len(words) >= TOKENS:
                        yield np.array(of), np.array(start), self._buckets(words, start, again)
                        words, of, start, again = [], [], [], []
        if words:
            yield np.array(of), np.array(start), self._buckets(words, start, again)

    def _buckets(self, words: list[bytes], start: list[int], again: list[int]) -> np.ndarray:
        ids = self._number(words)
        n = len(ids)
        begin, end = np.array(start), np.array([*start[1:], n])
        left = np.repeat(end, end - begin) - np.arange(n)  # words from each word to the end of its piece
        suffix = ids.copy()
        for k in range(1, N):
            suffix <<= 21
            suffix[: n - k] += np.where(left[: n - k] > k, ids[k:] + 1, 0)
        order = np.argsort(suffix)
        suffix, left = suffix[order], left[order]
        inside = np.arange(n) - np.repeat(begin, end - begin)
        again = np.repeat(np.array(again), end - begin)
        out = np.full((N, n), -1, np.int64)
        for k in range(1, N + 1):
            prefix = suffix >> (21 * (N - k))
            head = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))  # LCP under k begins a run
            long_ = left[head] >= k
            runs = prefix[head[long_]]
            word = [(runs >> (21 * (k - 1 - j)) & ((1 << 21) - 1)) - (j > 0) for j in range(k)]
            crc = self.crc[word[0]]
            for w in word[1:]:
                crc = extended(crc, self.spaced[w], self.size[w])
            found = np.full(len(head), -1, np.int64)
            found[long_] = crc % self.buckets
            out[k - 1, order] = np.repeat(found, np.diff(np.append(head, n)))
            out[k - 1, inside + k <= again] = -1
        return out


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket: one row a bucket and task is shuffled, one a bucket collected."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts = Features(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in features.blocks(binaries(batch.column(0))):
                counts += np.bincount(found[found >= 0], minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of target share over source share by bucket, one feature added to each, rounded down."""
    s, t = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((y + 1.0) * s / ((x + 1.0) * t))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_words, n_features and weight."""

    def make():  # noqa: ANN202
        features = Features(len(gain))

        def run(texts: list[bytes]) -> list[pa.Array]:
            n_words, n_features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for of, start, found in features.blocks(texts):
                there = found >= 0
                worth = np.where(there, gain[found], 0)
                np.add.at(n_words, of, np.add.reduceat(there[0].astype(np.int64), start))
                np.add.at(n_features, of, np.add.reduceat(there.sum(0), start))
                np.add.at(weight, of, np.add.reduceat(worth.sum(0), start))
            return [pa.array(x) for x in (n_words, n_features, weight)]

        return run

    return per_text(docs, text, keep, "n_words long, n_features long, weight long", make)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from a hash of the id, rounded down."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the number of each row from 1 in an order, which must be of columns of rows. rows is read twice: it should be a table."""
    within = F.monotonically_increasing_id()
    dealt = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", within.alias("at")), "ranked")
    part = F.shiftright("at", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # one row a partition
    before, total = [], 0
    for r in sorted(sizes):
        before.append((r["part"], total))
        total += r["n"]
    before = rows.sparkSession.createDataFrame(before, "part long, before long")
    numbered = dealt.join(F.broadcast(before), part == before["part"])
    return numbered.withColumn(name, F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("at", "part", "before")


def sample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns in keep, n_words, n_features, weight, score and rank of every document; rank is null for those that are not drawn."""
    kept = docs.columns if keep is None else keep
    gain = gains(bucket_counts(docs, text), bucket_counts(target, "text"))
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    inside = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    scored = weigh(inside, gain, keep=["row", "id"]).withColumn("score", F.col("weight") + noise(F.col("id")))
    scored = scored.select("*", (F.col("n_words") >= least_words).alias("counts"), F.monotonically_increasing_id().alias("number"))
    scored = materialize(scored, "scored")
    quota = scored.where("counts").count() * percent // 100
    order = [F.col("counts").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("number")]
    place = ranked(scored, order, "place")
    rank = F.when(F.col("counts") & (F.col("place") <= quota), F.col("place"))
    return place.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)), "n_words", "n_features", "weight", "score", rank.alias("rank"))


def oracle() -> str:
    """SQL that hashes each different feature byte by byte."""
    digit = "strpos('123456789ABCDEF', substr({0}, {1}, 1))"
    byte = f"16 * {digit.format('h', '2 * k + 1')} + {digit.format('h', '2 * k + 2')}"
    number = " + ".join(f"{16 ** (7 - k)} * strpos('123456789abcdef', substr(h, {k + 1}, 1))" for k in range(8))
    grams = " UNION ALL ".join(
        f"SELECT part, doc_id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM words" for n in range(1, N + 1)
    )
    return f"""
WITH texts AS (SELECT 's' AS part, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark),
words AS (SELECT part, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
grams AS (SELECT part, doc_id, g, count(*) AS n FROM ({grams}) GROUP BY ALL),
steps AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
named AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM grams)),
hashed AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: {byte})),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM named, steps),
counted AS (SELECT bucket, sum(n) FILTER (part = 's') AS s, sum(n) FILTER (part = 't') AS t FROM grams JOIN hashed USING (g) GROUP BY bucket),
sizes AS (SELECT sum(coalesce(s, 0)) AS all_s, sum(coalesce(t, 0)) AS all_t FROM counted),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM counted, sizes),
weights AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM grams JOIN hashed USING (g) JOIN gain USING (bucket) WHERE part = 's' GROUP BY doc_id),
noise AS (SELECT doc_id, len(w) AS n_words, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM words WHERE part = 's'),
scored AS (SELECT doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((({number}) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM noise LEFT JOIN weights USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""
