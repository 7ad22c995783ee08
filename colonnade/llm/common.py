"""Helpers shared by the corpus operators: shared storage, Arrow plumbing and word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A word is a run of characters outside space and U+0009..U+000D. bytes.split() uses the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir; where it is unset and Spark is local, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='colonnade-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, of which a JVM and a Python worker hold several at once, where the session has not.

    The default counts rows, and 10,000 long texts are a hundred MB. A longer text is a batch of its own.
    """
    if spark.conf.get(BATCH_BYTES) == spark.newSession().conf.get(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, "4m")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._colonnade_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that no later result reads."""
    remove(df.sparkSession, df._colonnade_path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def hash_bound(share: float) -> int:
    """The 64-bit hash up to which a share of all hashes is; a share so small that 64 bits do not tell it from none is one hash in all."""
    return min((1 << 63) - 1, -(1 << 63) + max(0, int(min(1.0, share) * (1 << 64)) - 1))


def binaries(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string array; null gives empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


SLICE = 1 << 22  # bytes of a text that are split into words at a time


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, whose only blanks are spaces, in lists of about SLICE bytes; a longer word is whole."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE:
            end = text.rfind(b" ", at, at + SLICE) + 1 or text.find(b" ", at + SLICE) + 1 or end
        if words := text[at:end].split():
            yield words
        at = end


def lowered(blank: Iterable[int]) -> bytes:
    """Table for bytes.translate() that lower-cases A-Z and then turns the given bytes into spaces."""
    blank = set(blank)
    return bytes(0x20 if b in blank else b for b in bytes(range(256)).lower())


def per_text(df: DataFrame, text: str, keep: list[str] | None, schema: str, make: Callable[[], Callable[[list[bytes]], list[pa.Array]]]) -> DataFrame:
    """Add columns computed from the bytes of a text column in Arrow batches.

    keep: columns that stay (None: all, in their order; names may repeat those of the added columns only if keep leaves
    them out). make() is called once a task and returns a function from the texts of a batch to the added arrays.
    """
    small_batches(df.sparkSession)
    kept = df.select(*(df.columns if keep is None else keep))
    added = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = [T.StructField("kept", T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept.schema)])), *added.fields]
    inside = df.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept.columns))).alias("kept"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *work(binaries(batch.column(1)))], names=[f.name for f in fields])

    out = inside.mapInArrow(run, T.StructType(fields))
    return out.select(*(F.col(f"kept.c{i}").alias(c) for i, c in enumerate(kept.columns)), *(F.col(f.name) for f in added.fields))


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words in this process only."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def rolling(ids: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hash of each run of n ids."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    size = len(ids) - n + 1
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = (out * np.uint64(base)) + ids[i : i + size]
        out ^= out >> np.uint64(29)
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts that lie one after another, and where each begins and the last ends; null is an empty text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), bounds


# fixed values of the word hash: a number for each byte after A-Z are lower-cased, and the base of its powers
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_VALUE = np.array([xxhash.xxh3_64_intdigest(bytes([i]).lower()) for i in range(256)], np.uint64) * ~_BLANK
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least n of them."""
    global _powers
    while len(_powers[0]) < n:
        more = len(_powers[0])
        step = [np.uint64(pow(x, more, 1 << 64)) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
        _powers = tuple(np.concatenate((x, x * y)) for x, y in zip(_powers, step, strict=True))
    return _powers


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts that lie one after another, where the words of each text begin, and the place of each word."""
    word = ~_BLANK[data]
    joined = word[1:] & word[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    joined[inner - 1] = False
    start = np.flatnonzero(word & ~np.append(False, joined)[: len(word)])
    end = np.flatnonzero(word & ~np.append(joined, False)[: len(word)]) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h, np.searchsorted(start, bounds), start, end
