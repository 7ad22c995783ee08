"""Files that documents only point to: what they are, whether they are still so, and where they have gone.

Files are tables of (set, idx, path, size, modified, digest). Sizes and times are asked, and contents read, by tasks; of a file
no more than its first and last MiB is read, and that only where its size is right and its time has changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..sources.shared import materialized

PROBE = 1 << 20
FILES_A_TASK = 64


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def probe(path: str) -> tuple[int, str]:
    """(size, digest) of a file: XXH3 of its size, its first MiB, and its last one as far as that is beyond the first."""
    import xxhash

    store, at = _store(path)
    with store.open_input_file(at) as f:
        size = f.size()
        h = xxhash.xxh3_64(size.to_bytes(8, "little") + f.read(PROBE))
        if size > PROBE:
            f.seek(size - min(size - PROBE, PROBE))
            h.update(f.read(PROBE))
    return size, h.hexdigest()


def _dealt(paths: DataFrame) -> DataFrame:
    """Different paths, some a task: asking a store takes time, not room."""
    different = paths.select("path").where("path is not null").distinct()
    return different.repartition(max(1, -(-different.count() // FILES_A_TASK)), "path")


def stats(paths: DataFrame) -> DataFrame:
    """(path, size, modified) of the files there are among (path); modified is in seconds since 1970, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                store, at = _store(path)
                info = store.get_file_info(at)
                if info.is_file:
                    rows.append({"path": path, "size": info.size, "modified": None if info.mtime_ns is None else info.mtime_ns // 10**9})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64())]))

    return _dealt(paths).mapInArrow(run, "path string, size long, modified long")


def fingerprints(paths: DataFrame) -> DataFrame:
    """(path, size, digest) of the files there are among (path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                store, at = _store(path)
                if store.get_file_info(at).is_file:
                    size, digest = probe(path)
                    rows.append({"path": path, "size": size, "digest": digest})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("size", pa.int64()), ("digest", pa.string())]))

    return _dealt(paths).mapInArrow(run, "path string, size long, digest string")


def remembered(paths: DataFrame) -> DataFrame:
    """(path, size, modified, digest): what is later asked of files."""
    return fingerprints(paths).join(stats(paths).select("path", "modified"), "path")


def states(files: DataFrame) -> DataFrame:
    """Files with their state and present time: missing, changed (by size, or by contents where the time differs), else ok."""
    now = materialized(stats(files).withColumnsRenamed({"size": "size_now", "modified": "modified_now"}), "stats")
    both = files.join(now, "path", "left")
    unsure = both.where((F.col("size") == F.col("size_now")) & ~F.coalesce(F.col("modified") == F.col("modified_now"), F.lit(False)))
    read = fingerprints(unsure).select("path", F.col("digest").alias("digest_now"))
    same_time = F.coalesce(F.col("modified") == F.col("modified_now"), F.lit(False))
    state = F.when(F.col("size_now").isNull(), "missing").when(F.col("size_now") != F.col("size"), "changed").when(same_time, "ok")
    state = state.when(F.col("digest_now") == F.col("digest"), "ok").otherwise("changed")
    return both.join(read, "path", "left").select(*files.columns, state.alias("state"), "modified_now")


def moved(files: DataFrame, old_dir: str, new_dir: str) -> DataFrame:
    """(set, idx, path, new_path, modified) of files of a folder that are not ok and are found, by name and contents, in another."""
    gone = states(files.where(S.parent(F.col("path")) == old_dir)).where("state <> 'ok'")
    asked = gone.select("set", "idx", "path", "size", "digest", F.concat(F.lit(new_dir.rstrip("/") + "/"), S.file_name(F.col("path"))).alias("new_path"))
    asked = materialized(asked, "asked")
    sized = stats(asked.select(F.col("new_path").alias("path"))).withColumnRenamed("path", "new_path")
    fit = asked.join(sized.select("new_path", F.col("size").alias("size"), "modified"), ["new_path", "size"])
    read = fingerprints(fit.select(F.col("new_path").alias("path"))).select(F.col("path").alias("new_path"), "digest")
    return fit.join(read, ["new_path", "digest"]).select("set", "idx", "path", "new_path", "modified")


def located(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """(set, idx, path, new_path) of files that are not ok and have the contents of one of the candidates (path), whatever its name.

    Only candidates of a size that is looked for are read. Of several the first by path counts.
    """
    gone = materialized(states(files).where("state <> 'ok'"), "gone")
    sized = stats(candidates).join(gone.select("size").distinct(), "size", "left_semi")
    read = fingerprints(sized).withColumnRenamed("path", "new_path")
    return gone.join(read, ["size", "digest"]).groupBy("set", "idx", "path").agg(F.min("new_path").alias("new_path"))


def relinked(files: DataFrame, set_: int, idx: int, path: str) -> DataFrame:
    """All files with new paths and times where a user has found file idx of a set at path.

    It must be the same file. With it go the files of all sets that were in its old folder and are found beside it.
    """
    chosen = files.where((F.col("set") == set_) & (F.col("idx") == idx)).first()
    if chosen is None:
        raise ValueError("No such linked file")
    info = _store(path)[0].get_file_info(_store(path)[1])
    if not info.is_file or (info.size, probe(path)[1]) != (chosen["size"], chosen["digest"]):
        raise ValueError("That is not the same file")
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    one = files.sparkSession.createDataFrame([(set_, idx, chosen["path"], path, info.mtime_ns // 10**9 if info.mtime_ns is not None else None)], moved(files.limit(0), "", "").schema)
    rest = moved(files, folder(chosen["path"]), folder(path)).where(~((F.col("set") == set_) & (F.col("idx") == idx)))
    found = one.unionByName(rest).select("set", "idx", "new_path", F.col("modified").alias("new_modified"))
    out = files.join(found, ["set", "idx"], "left")
    there = F.col("new_path").isNotNull()
    return out.select("set", "idx", F.coalesce("new_path", "path").alias("path"), "size", F.when(there, F.col("new_modified")).otherwise(F.col("modified")).alias("modified"), "digest")
