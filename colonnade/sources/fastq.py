"""FASTQ reads as a Python data source: files and ranges of files, wrapped records, gzip and block-gzip by their first bytes."""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .blocks import END, END_OF_FILE, PROOF, RANGE_BYTES, SEQUENCE, STRIDE, TEXT, Format, Line, Record, between, compressed, index, ranges_of, size_and_kind

SCHEMA = "file string, read_no long, head string, seq string, qual string"


def records(lines: Iterator[Line], file: str = "", unit: str = "byte", strict: bool = False) -> Iterator[Record]:
    """(place, header, sequence, quality) of each record of (place, line); sequence and quality may be wrapped. Errors name the place.

    strict refuses sequences with characters that no sequence has: for lines of which it is not known where records begin.
    """
    place = 0

    def following() -> tuple[int, str | None]:
        nonlocal place
        at, line = next(lines, (place + (unit == "line"), None))
        place = at
        return at, line if line is None else line.rstrip("\r")

    def fail(what: str) -> ValueError:
        return ValueError(f"{file} {unit} {place >> 16 if unit == 'byte' else place}: {what}".strip())

    while True:
        at, line = following()
        if line is None:
            return
        if not line:
            continue
        if not line.startswith("@"):
            raise fail("a record must start with @")
        head, seq = line[1:], []
        while True:
            _, line = following()
            if line is None:
                raise fail("the record ends without +")
            if line.startswith("+"):
                break
            if strict and not SEQUENCE.fullmatch(line):
                raise fail("no sequence")
            seq.append(line)
        want, qual, got = sum(map(len, seq)), [], 0
        while not qual or got < want:
            _, line = following()
            if line is None:
                if want == 0:
                    break
                raise fail("the record ends within its qualities")
            qual.append(line)
            got += len(line)
        if got != want:
            raise fail(f"{want} bases but {got} qualities")
        yield at, head, "".join(seq), "".join(qual)


def parse(lines: Iterator[str], file: str = "") -> Iterator[tuple[str, str, str]]:
    """(header, sequence, quality) of each record of lines; errors name the line."""
    for _, *record in records(((i, x.rstrip("\r\n")) for i, x in enumerate(lines, 1)), file, "line"):
        yield tuple(record)


def in_order(lines: Iterator[Line]) -> bool:
    """Whether the first records of lines are whole: that tells a header from a line of qualities that begins with its mark."""
    try:
        for _ in islice(records(lines, strict=True), PROOF):
            pass
    except ValueError:
        return False
    return True


FASTQ = Format("@", records, in_order)


def files_in(path: str, depth: int = 3) -> list[str]:
    """FASTQ files of a folder and its subfolders to a depth, in order; or the file itself."""
    if os.path.isfile(path):
        return [path]
    out = []
    for top, dirs, names in os.walk(path):
        if os.path.relpath(top, path).count(os.sep) + (top != path) >= depth:
            dirs.clear()
        out += [os.path.join(top, n) for n in names if n.lower().removesuffix(".gz").endswith((".fastq", ".fq"))]
    return sorted(out)


class _Reader(DataSourceReader):
    """A partition is a range of the index, or a file where there is none."""

    def __init__(self, paths: list[str], limit: int | None, index: str | None) -> None:
        self.limit = limit
        ranges = ranges_of(index) if index else [{"file": p, "first": 0, "after": END_OF_FILE, "base": 0} for p in paths]
        self.ranges = [(r["file"], r["first"], r["after"], r["base"]) for r in ranges if r.get("records") != 0 and (limit is None or r["base"] < limit)]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self.ranges]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, first, after, base = partition.value
        rows, held = [], 0
        for i, record in enumerate(between(path, first, after, FASTQ), base):
            if self.limit is not None and i >= self.limit:
                break
            rows.append((path, i, *record))
            held += len(record[1])
            if len(rows) >= 10_000 or held >= 1 << 22:
                yield _batch(rows)
                rows, held = [], 0
        yield _batch(rows)


class FastqSource(DataSource):
    """spark.read.format("fastq").load(path): files of local or mounted folders, or URIs that pyarrow opens.

    Options: limit stops early in each file; index is the table of ranges that blocks.index() has written for these files.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        limit = self.options.get("limit")
        return _Reader(paths_in(self.options["path"]), int(limit) if limit else None, self.options.get("index"))


def paths_in(path: str) -> list[str]:
    return [f for p in path.split(",") for f in ([p] if "://" in p and not p.startswith("file://") else files_in(p.removeprefix("file://")))]


def read_fastq(spark: SparkSession, path: str, limit: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Reads by the data source. Files that are longer than range_bytes are indexed first and then read by many tasks, block-gzip ones too."""
    spark.dataSource.register(FastqSource)
    reader = spark.read.format("fastq")
    if limit:
        return reader.option("limit", limit).load(path)
    files = paths_in(path)
    if any(size > range_bytes and kind != "gzip" for size, kind in map(size_and_kind, files)):
        reader = reader.option("index", index(spark, files, FASTQ, range_bytes))
    return reader.load(path)


def read_chosen(spark: SparkSession, index_path: str, chosen: DataFrame) -> DataFrame:
    """The reads (file, read_no) of a table from files of an index: a task opens a file at the mark before a read, and reads no further than the last one chosen there."""
    ranges = spark.read.parquet(index_path)
    inside = (F.col("read_no") >= F.col("base")) & (F.col("read_no") < F.col("base") + F.col("records"))
    at = chosen.distinct().join(ranges, "file").where(inside)
    mark = F.floor((F.col("read_no") - F.col("base")) / STRIDE).cast("int")
    starts = at.select("file", "read_no", F.element_at("marks", mark + 1).alias("place"), (F.col("base") + mark * STRIDE).alias("first"))
    stretches = starts.groupBy("file", "place", "first").agg(F.sort_array(F.collect_set("read_no")).alias("numbers"))  # at most STRIDE of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, place, first, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted, rows = set(numbers), []
                for i, record in enumerate(between(path, place, END_OF_FILE, FASTQ), first):
                    if i in wanted:
                        rows.append((path, i, *record))
                    if i >= numbers[-1]:
                        break
                yield _batch(rows)

    return stretches.select("file", "place", "first", "numbers").repartition("file", "place").mapInArrow(run, SCHEMA)


def write_fastq(reads: DataFrame, path: str, member: int = TEXT - 256) -> None:
    """Block-gzip files of reads in a folder, one a partition, in the order of its rows; names are of the partition's number.

    A task writes under a name of its own and renames at its end, so an attempt that fails or is repeated leaves no part of a file.
    """
    store, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    store.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
        task = TaskContext.get()
        own = f"{at}/.{task.partitionId()}-{task.taskAttemptId()}"
        n = 0

        def texts() -> Iterator[bytes]:
            nonlocal n
            for batch in batches:
                for head, seq, qual in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    n += 1
                    yield f"@{head}\n{seq}\n+\n{qual}\n".encode()

        with store.open_output_stream(own, compression=None) as out:
            for block in compressed(texts(), member):
                out.write(block)
            out.write(END)
        if n:
            store.move(own, f"{at}/part-{task.partitionId():05d}.fastq.gz")
        else:
            store.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    reads.select("head", "seq", "qual").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_fastq_bytes(spark: SparkSession, path: str) -> DataFrame:
    """The same rows for any store that Spark reads; a file is one task and must fit in its memory."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                part: list[tuple] = []
                for i, (head, seq, qual) in enumerate(parse(iter(data.decode("utf-8", "replace").splitlines()), file)):
                    part.append((file, i, head, seq, qual))
                    if len(part) == 20_000:
                        yield _batch(part)
                        part = []
                yield _batch(part)

    return files.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "read_no", "head", "seq", "qual"])


def trimmed(reads: DataFrame) -> DataFrame:
    """Reads as they are shown: bases that normalization drops lose their qualities too, gaps at the ends as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = set("ABCDGHKMNRSTVWYU.-~?X")
        for batch in batches:
            seqs, quals = [], []
            for s, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                cells = []
                for b, p in zip(s.upper(), q, strict=True):
                    if b in " \t\n\f\r0123456789*":
                        continue
                    b = {"U": "T", ".": "-", "~": "-", "?": "N", "X": "N"}.get(b, b) if b in keep else "-" if b == "-" else "N"
                    cells.append((b, max(0, ord(p) - 33)))
                while cells and cells[0][0] == "-":
                    cells.pop(0)
                while cells and cells[-1][0] == "-":
                    cells.pop()
                seqs.append("".join(c[0] for c in cells))
                quals.append([c[1] for c in cells])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seqs, pa.string()), pa.array(quals, pa.list_(pa.int32()))], names=["file", "read_no", "seq", "quals"])

    return reads.select("file", "read_no", "seq", "qual").mapInArrow(run, "file string, read_no long, seq string, quals array<int>")


def with_names(reads: DataFrame) -> DataFrame:
    from ..functions import sequence as S

    return reads.withColumns({"name": S.read_id(F.col("head")), "description": S.read_desc(F.col("head"))})
