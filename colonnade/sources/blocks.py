"""Byte ranges of sequence files, compressed or not, that tasks read on their own.

A block-gzip file is a row of gzip members of at most 64 KiB of text, each with its own size in an extra field. A place in
such a file is a virtual offset: the first byte of a member, times 65,536, plus the place in its text. A plain file counts as
members of 64 KiB. So a file is cut anywhere:

- A range [a, b) of a file's bytes has the records whose first character lies in a member that begins there. A task finds the
  first member from a by its header, the header after it and its checksum, and there the first line that begins a record.
- In FASTA that is any line with its mark. In FASTQ a quality line may begin with the mark too, so the records from the line on
  must be in order: no mark in the sequence, as many qualities as bases, over several records.
- Ranges are then proved: each must begin where the one before it ended. As the first begins with its file, that leaves no
  doubt; a range that was entered wrongly is read again from the right place.

index() is that first pass: a row a range, with its first place, the place after it, its number of records and the place of every
STRIDE-th one. Its rows say where each record is, so ranges are numbered and single records are read without the others.
Other gzip files (one member, or members without sizes) cannot be entered in the middle: they are one range.

Files are opened by pyarrow's file systems: local and mounted paths, and URIs of the stores it knows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir

RANGE_BYTES = 32 << 20
STRIDE = 256
TEXT = 1 << 16  # most text of a member; offsets in it take 16 bits
PROOF = 4  # records that must be in order where a range is entered
READ = 1 << 20
END_OF_FILE = 1 << 62
# fixed values of the format: a gzip header with extra fields, and the mark of the field that holds the member's size
HEADER, FIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"

Line = tuple[int, str]
Record = tuple[int, str, str, str]


class File:
    """A file of some store, read by place. Bytes are fetched READ at a time."""

    def __init__(self, path: str) -> None:
        if "://" in path or path.startswith("file:"):
            store, at = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        else:
            store, at = pafs.LocalFileSystem(), path
        self.path, self.data = path, store.open_input_file(at)
        self.size = self.data.size()
        self.start, self.held = 0, b""
        head = self.bytes(0, 18)
        self.kind = "plain" if head[:2] != HEADER[:2] else "blocks" if member_size(head) else "gzip"

    def bytes(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not (self.start <= at and at + n <= self.start + len(self.held)):
            self.data.seek(at)
            self.start, self.held = at, self.data.read(max(n, READ))
        return self.held[at - self.start : at - self.start + n]

    def close(self) -> None:
        self.data.close()


def size_and_kind(path: str) -> tuple[int, str]:
    file = File(path)
    file.close()
    return file.size, file.kind


def member_size(head: bytes) -> int:
    """Bytes of a block-gzip member by its header; 0 if it is none."""
    if head[:4] != HEADER:
        return 0
    extra = head[12 : 12 + int.from_bytes(head[10:12], "little")]
    while len(extra) >= 4:
        n = int.from_bytes(extra[2:4], "little")
        if extra[:4] == FIELD and len(extra) >= 6:
            return int.from_bytes(extra[4:6], "little") + 1
        extra = extra[4 + n :]
    return 0


def _inflated(member: bytes) -> bytes:
    skip = 12 + int.from_bytes(member[10:12], "little")
    text = zlib.decompress(member[skip:-8], wbits=-15)
    if zlib.crc32(text) != int.from_bytes(member[-8:-4], "little"):
        raise zlib.error("checksum")
    return text


def _header(file: File, at: int) -> bytes:
    start = file.bytes(at, 12)
    return start + file.bytes(at + 12, int.from_bytes(start[10:12], "little")) if start[:4] == HEADER else start


def first_member(file: File, at: int) -> int:
    """The first member that begins at a byte or after it; the file's size if there is none."""
    if file.kind == "plain":
        return min(-(-at // TEXT) * TEXT, file.size)
    if file.kind == "gzip":
        return 0 if at == 0 else file.size
    while at < file.size:
        here = file.bytes(at, TEXT + len(HEADER) - 1)
        found = here.find(HEADER)
        if found < 0:
            at += TEXT
            continue
        at += found
        size = member_size(_header(file, at))
        after = at + size
        if size and after <= file.size and (after == file.size or member_size(_header(file, after))):
            try:
                _inflated(file.bytes(at, size))
                return at
            except zlib.error:
                pass
        at += 1
    return file.size


def members(file: File, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the members from one on."""
    if file.kind == "gzip":
        yield from _stream(file)
        return
    while at < file.size:
        if file.kind == "plain":
            size = text = None
            text = file.bytes(at, TEXT)
            size = len(text)
        else:
            size = member_size(_header(file, at))
            if not size or at + size > file.size:
                raise ValueError(f"{file.path} byte {at}: a block is damaged")
            try:
                text = _inflated(file.bytes(at, size))
            except zlib.error as e:
                raise ValueError(f"{file.path} byte {at}: a block is damaged ({e})") from e
        yield at, text
        at += size


def _stream(file: File) -> Iterator[tuple[int, bytes]]:
    """A gzip file of any number of members, as if its text had members of at most 64 KiB at places of its own."""
    at, out, unpack, rest = 0, 0, zlib.decompressobj(wbits=31), b""
    fresh = True  # nothing of the present member has been read
    while rest or at < file.size:
        data = rest or file.bytes(at, READ)
        at += 0 if rest else len(data)
        if fresh and not data.strip(b"\0"):  # what pads the file
            rest = b""
            continue
        try:
            text, fresh = unpack.decompress(data, TEXT), False
        except zlib.error as e:
            raise ValueError(f"{file.path}: the compressed data are damaged ({e})") from e
        if text:
            yield out, text
            out += TEXT
        rest = unpack.unconsumed_tail
        if unpack.eof:
            rest, unpack, fresh = unpack.unused_data, zlib.decompressobj(wbits=31), True
    if not fresh:
        raise ValueError(f"{file.path}: the compressed data end too early")


def lines(file: File, start: int) -> Iterator[Line]:
    """(virtual offset, line without its end) from a virtual offset on; bytes that are no UTF-8 are replaced."""
    place, held = start, []
    for at, text in members(file, start >> 16):
        if at < start >> 16:
            continue
        here = max(at << 16, start)
        whole, _, rest = text[here - (at << 16) :].rpartition(b"\n")
        if _:
            for part in whole.split(b"\n"):
                if held:
                    held.append(part)
                    yield place, b"".join(held).decode("utf-8", "replace")
                    held = []
                else:
                    yield here, part.decode("utf-8", "replace")
                here += len(part) + 1
        if rest:
            place = place if held else here
            held.append(rest)
    if held:
        yield place, b"".join(held).decode("utf-8", "replace")


class Format:
    """How records are told apart: their mark, the reader of records, and whether records from a line on are in order."""

    def __init__(self, mark: str, records: Callable[[Iterator[Line], str], Iterator[Record]], in_order: Callable[[Iterator[Line]], bool]) -> None:
        self.mark, self.records, self.in_order = mark, records, in_order


def enter(file: File, at: int, kind: Format) -> int:
    """Virtual offset of the first record whose first character is in a member from byte `at` on; that of the file's end if there is none."""
    member = first_member(file, at)
    if at == 0 or member >= file.size:
        return member << 16
    source, held = lines(file, member << 16), []

    def from_line(i: int) -> Iterator[Line]:
        while True:
            while i >= len(held):
                more = next(source, None)
                if more is None:
                    return
                held.append(more)
            yield held[i]
            i += 1

    i = 0
    while (line := next(from_line(i), None)) is not None:
        if line[1].startswith(kind.mark) and kind.in_order(from_line(i)):
            return line[0]
        i += 1
    return file.size << 16


def scan(file: File, start: int, end: int, kind: Format) -> Iterator[Record]:
    """Records from a virtual offset to those that begin in a member at byte `end` or after; last (place, "", "", "") of the next one."""
    stop = file.size << 16
    for record in kind.records(lines(file, start), file.path):
        if record[0] >> 16 >= end and file.kind != "gzip":
            stop = record[0]
            break
        yield record
    yield stop, "", "", ""


def between(path: str, first: int, after: int, kind: Format) -> Iterator[tuple[str, str, str]]:
    """Records of a file from one virtual offset to another, both of the index."""
    file = File(path)
    try:
        for place, *record in kind.records(lines(file, first), path):
            if place >= after and file.kind != "gzip":
                return
            yield tuple(record)
    finally:
        file.close()


INDEX = "file string, part int, first long, after long, records long, marks array<long>"


def index(spark: SparkSession, files: Iterable[str], kind: Format, range_bytes: int = RANGE_BYTES) -> str:
    """Where the table of the ranges of files is written: INDEX and `base`, the number of records before the range in its file. A task reads a range."""
    ranges = []
    for path in sorted(set(files)):
        file = File(path)
        n = 1 if file.kind == "gzip" else max(1, -(-file.size // range_bytes))
        ranges += [(path, i, i * range_bytes, file.size if i == n - 1 else (i + 1) * range_bytes, None) for i in range(n)]
        file.close()
    at = f"{shared_dir(spark)}/ranges-{uuid.uuid4().hex}"
    done: dict[tuple[str, int], tuple[int, int, int]] = {}
    limits = {(r[0], r[1]): r for r in ranges}
    turn = 0
    while ranges:
        sent = spark.sparkContext.broadcast(ranges)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    path, part, a, b, first = sent.value[i]
                    file = File(path)
                    first = enter(file, a, kind) if first is None else first
                    n, marks = 0, []
                    for place, *_ in scan(file, first, b, kind) if first >> 16 < b or a == 0 else [(first,)]:
                        marks.append(place) if n % STRIDE == 0 else None
                        n, after = n + 1, place
                    file.close()
                    n -= 1
                    marks = marks[: -(-n // STRIDE)]
                    yield pa.RecordBatch.from_pylist([{"file": path, "part": part, "first": first, "after": after, "records": n, "marks": marks}], schema=_SCHEMA)

        spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(run, INDEX).write.parquet(f"{at}/turn={turn}")
        for r in spark.read.schema(INDEX).parquet(f"{at}/turn={turn}").drop("marks").collect():  # a row a range
            done[r["file"], r["part"]] = r["first"], r["after"], r["records"]
        ranges, before = [], None
        for key in sorted(done):
            if before and before[0] == key[0] and done[key][0] != done[before][1]:
                ranges.append((*limits[key][:4], done[before][1]))
            before = key
        turn += 1
    base, rows = {}, []
    for key in sorted(done):
        rows.append((*key, base.get(key[0], 0)))
        base[key[0]] = base.get(key[0], 0) + done[key][2]
    found = spark.read.schema(f"{INDEX}, turn int").parquet(at)
    last = found.groupBy("file", "part").agg(F.max_by(F.struct("first", "after", "records", "marks"), "turn").alias("r")).select("file", "part", "r.*")
    base_of = F.broadcast(spark.createDataFrame(rows, "file string, part int, base long"))
    last.join(base_of, ["file", "part"]).coalesce(1 + len(rows) // 10_000).write.parquet(f"{at}-index")
    return f"{at}-index"


def ranges_of(index_path: str) -> list[dict]:
    """Rows of the index without marks, in order, read on the driver where a scan is planned: a row a range."""
    store, at = pafs.FileSystem.from_uri(index_path)
    rows = pads.dataset(at, filesystem=store, format="parquet").to_table(columns=["file", "part", "first", "after", "records", "base"])
    return sorted(rows.to_pylist(), key=lambda r: (r["file"], r["part"]))


_SCHEMA = pa.schema([("file", pa.string()), ("part", pa.int32()), ("first", pa.int64()), ("after", pa.int64()), ("records", pa.int64()), ("marks", pa.list_(pa.int64()))])


def compressed(texts: Iterable[bytes], size: int = TEXT - 256) -> Iterator[bytes]:
    """Block-gzip members of `size` bytes of texts that follow one another, without the empty member that ends a file."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= size:
            whole = b"".join(held)
            full = n - n % size
            yield from (_member(whole[a : a + size]) for a in range(0, full, size))
            held, n = [whole[full:]], n - full
    if n:
        yield _member(b"".join(held))


def _member(text: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = pack.compress(text) + pack.flush()
    if len(data) > TEXT - 64:  # stored as it is
        pack = zlib.compressobj(0, zlib.DEFLATED, -15)
        data = pack.compress(text) + pack.flush()
    size = len(HEADER) + 6 + 2 + len(FIELD) + 2 + len(data) + 8
    return HEADER + bytes(5) + b"\xff" + (len(FIELD) + 2).to_bytes(2, "little") + FIELD + (size - 1).to_bytes(2, "little") + data + zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")


END = _member(b"")
SEQUENCE = re.compile(r"[A-Za-z*.~? \t\-0-9]*")
