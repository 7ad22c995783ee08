"""The library: documents with rows and tracks, folders and settings, as files by document under a manifest of versions.

A document's rows, annotations, features, text or link are Parquet folders of its own, which never change. Its record says which
they are. Records lie in BUCKETS files by id, and a version of the library is a small file that names these and counts ids. An
edit writes the data of the documents it changes, their buckets' records and the next version. A version is claimed: its file
comes to be whole or not at all, and only for one writer. Who comes second applies the edit again to what the first one left,
so no edit is lost and a reader sees all of an edit or nothing of it.

A claim needs a store that does not rename onto an existing file, or a local folder.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import columns as C
from .ranks import numbered
from .rows import META, ROWS, end

_PARTS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
BUCKETS = 64
ATTEMPTS = 100


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


L, I, S_ = T.LongType(), T.IntegerType(), T.StringType()
TABLES = {
    "documents": _schema(id=L, name=S_, kind=S_, n_rows=I, width=I, reference=I, description=S_, created=S_, folder_id=L),
    "rows": ROWS,
    "annotations": _schema(id=L, doc_id=L, name=S_, kind=S_, start_col=I, end_col=I, note=S_, color=S_),
    "features": _schema(id=L, doc_id=L, name=S_, kind=S_, strand=I, parts=_PARTS, location=S_, qualifiers=META, source=S_, color=S_),
    "folders": _schema(id=L, name=S_, parent_id=L, collapsed=T.BooleanType()),
    "settings": _schema(key=S_, value=S_),
    "texts": _schema(doc_id=L, content=S_),
    "linked": _schema(doc_id=L, data=S_),
    "counts": _schema(doc_id=L, col=I, n_a=L, n_c=L, n_g=L, n_t=L, n_gap=L, n_other=L),
}
DEPENDENT = ["rows", "annotations", "features", "texts", "linked", "counts"]
SMALL = ["folders", "settings"]  # a record a folder or setting
FEATURE_ORDER = lambda: [F.col("parts")[0]["start"], F.col("name")]
TRACK_END = {"annotations": lambda: F.col("end_col"), "features": lambda: F.array_max(F.transform("parts", lambda p: p["end"]))}


class Store:
    """Small files of any store, and which of several writers makes one first."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.local = self.path.removeprefix("file://").replace("file:", "", 1) if "://" not in self.path or self.path.startswith("file:") else None

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        if self.local is not None:
            at = f"{self.local}/{folder}"
            return os.listdir(at) if os.path.isdir(at) else []
        p, fs = self._fs(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def read(self, name: str) -> str:
        if self.local is not None:
            with open(f"{self.local}/{name}", encoding="utf-8") as f:
                return f.read()
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def write(self, name: str, text: str) -> None:
        if self.local is not None:
            os.makedirs(os.path.dirname(f"{self.local}/{name}"), exist_ok=True)
            with open(f"{self.local}/{name}", "w", encoding="utf-8") as f:
                f.write(text)
            return
        p, fs = self._fs(name)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def claim(self, name: str, text: str) -> bool:
        """Make a file with this text unless there is one; whether it was made."""
        own = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        self.write(own, text)
        if self.local is not None:
            try:
                os.link(f"{self.local}/{own}", f"{self.local}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{self.local}/{own}")
        (source, fs), (target, _) = self._fs(own), self._fs(name)
        made = not fs.exists(target) and fs.rename(source, target)
        if not made:
            fs.delete(source, False)
        return made


class Version:
    """A version of the library, and changes to it that are not claimed yet."""

    def __init__(self, store: Store, number: int, root: dict) -> None:
        self.store, self.number, self.root = store, number, root
        self.read: dict[str, dict] = {}
        self.changed: set[str] = set()

    def part(self, name: str) -> dict:
        """Records by id of a bucket of documents, of folders or of settings."""
        if name not in self.read:
            at = self.root["parts"].get(name)
            self.read[name] = {r[KEY[name.split("-")[0]]]: r for r in map(json.loads, self.store.read(at).splitlines())} if at else {}
        return self.read[name]

    def change(self, name: str) -> dict:
        self.changed.add(name)
        return self.part(name)

    def document(self, id_: int) -> dict | None:
        return self.part(bucket(id_)).get(id_)

    def edit_document(self, id_: int) -> dict:
        found = self.change(bucket(id_)).get(id_)
        if found is None:
            raise KeyError(id_)
        return found

    def next_id(self, kind: str, n: int = 1) -> int:
        first = self.root["next"].get(kind, 1)
        self.root["next"][kind] = first + n
        return first

    def put(self, table: str, id_: int, rows: DataFrame | None) -> None:
        """Write the rows of a document's table, or take it away."""
        files = self.edit_document(id_)["files"]
        if rows is None:
            files.pop(table, None)
            return
        at = f"data/{id_}/{table}-{uuid.uuid4().hex}"
        rows = rows.withColumn("doc_id", F.lit(id_))
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table])).write.parquet(f"{self.store.path}/{at}")
        files[table] = at

    def get(self, table: str, id_: int) -> DataFrame:
        record = self.document(id_)
        return self.frame(table, [record["files"][table]] if record and table in record["files"] else [])

    def frame(self, table: str, paths: list[str]) -> DataFrame:
        spark = self.store.spark
        return spark.read.schema(TABLES[table]).parquet(*(f"{self.store.path}/{p}" for p in paths)) if paths else spark.createDataFrame([], TABLES[table])

    def commit(self) -> bool:
        for name in self.changed:
            at = f"parts/{name}-{uuid.uuid4().hex}.json"
            self.store.write(at, "".join(json.dumps(r) + "\n" for r in self.part(name).values()))
            self.root["parts"][name] = at
        return self.store.claim(f"versions/{self.number + 1:020d}.json", json.dumps(self.root))


KEY = {"documents": "id", "folders": "id", "settings": "key"}


def bucket(id_: int) -> str:
    return f"documents-{id_ % BUCKETS}"


class Library:
    """A library under a path of any store; every change is one version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)

    def now(self) -> Version:
        """The last version there is."""
        names = [n for n in self.store.names("versions") if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return Version(self.store, 0, {"next": {}, "parts": {}})
        return Version(self.store, int(max(names).removesuffix(".json")), json.loads(self.store.read(f"versions/{max(names)}")))

    def edit(self, act: Callable[[Version], object]) -> object:
        """Apply a change to the last version until it can be claimed as the next one; what the change returned."""
        for _ in range(ATTEMPTS):
            version = self.now()
            out = act(version)
            if not version.changed or version.commit():
                return out
        raise RuntimeError("too many writers")

    # whole tables
    def table(self, name: str) -> DataFrame:
        version = self.now()
        parts = [at for part, at in version.root["parts"].items() if part.split("-")[0] == (name if name in KEY else "documents")]
        records = self.spark.read.schema(TABLES[name] if name in KEY else "id long, files map<string, string>").json([f"{self.store.path}/{p}" for p in parts]) if parts else None
        if name in KEY:
            return records if records is not None else self.spark.createDataFrame([], TABLES[name])
        paths = [] if records is None else [r[0] for r in records.select(F.col("files")[name].alias("at")).where("at is not null").toLocalIterator()]  # a path a document
        return version.frame(name, paths)

    def load_tables(self, tables: dict[str, DataFrame]) -> None:
        """Add whole tables with their own ids, as from another library; documents that only tracks name get a record."""
        frames = {n: df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[n])) for n, df in tables.items()}
        placed: dict[str, dict[int, str]] = {}
        for name in [n for n in DEPENDENT if n in frames]:
            at = f"data/{name}-{uuid.uuid4().hex}"
            frames[name].withColumn("of", F.col("doc_id")).repartition("of").write.partitionBy("of").parquet(f"{self.store.path}/{at}")
            placed[name] = {r[0]: f"{at}/of={r[0]}" for r in frames[name].select("doc_id").distinct().collect()}  # a row a document
        records = [r.asDict() for r in frames["documents"].collect()] if "documents" in frames else []  # a row a document
        top = {n: frames[n].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] for n in ("documents", "annotations", "features", "folders") if n in frames}
        small = {n: [r.asDict() for r in frames[n].collect()] for n in SMALL if n in frames}

        def act(v: Version) -> None:
            for r in records:
                v.change(bucket(r["id"]))[r["id"]] = {"files": {}} | r
            for name, paths in placed.items():
                for id_, at in paths.items():
                    v.change(bucket(id_)).setdefault(id_, _record(id_, "", "Sequences"))["files"][name] = at
            for name, rows in small.items():
                v.change(name).update({r[KEY[name]]: r for r in rows})
            for name, id_ in top.items():
                v.root["next"][name] = max(v.root["next"].get(name, 1), id_ + 1)
            v.root["next"]["documents"] = max([v.root["next"].get("documents", 1), *(i + 1 for paths in placed.values() for i in paths)])

        self.edit(act)

    # documents
    def insert_document(self, name: str, kind: str, rows: DataFrame, reference: int | None = None, description: str = "", folder: int | None = None, more: dict[str, DataFrame] | None = None, features: DataFrame | None = None) -> int:
        """A new document with its rows, features and whatever tables of its own, as one version."""
        own = None if features is None else self._in_order(features, FEATURE_ORDER())
        n, width = rows.agg(F.count("*"), F.coalesce(F.max(end()), F.lit(0))).first()

        def act(v: Version) -> int:
            id_ = v.next_id("documents")
            v.change(bucket(id_))[id_] = _record(id_, name, kind, n, width, reference, description, folder if folder in v.part("folders") else None)
            for table, df in ({"rows": rows} | (more or {})).items() if n else (more or {}).items():
                v.put(table, id_, df)
            if own is not None:
                v.put("features", id_, own[0].withColumn("id", F.col("place") + F.lit(v.next_id("features", own[1]))))
            return id_

        return self.edit(act)

    def insert_text(self, name: str, content: str, description: str = "", folder: int | None = None) -> int:
        text = self.spark.createDataFrame([(content,)], "content string")
        return self.insert_document(name, "Text", self.spark.createDataFrame([], ROWS), None, description, folder, {"texts": text})

    def insert_linked(self, name: str, linked: dict, description: str = "", folder: int | None = None) -> int:
        data = self.spark.createDataFrame([(json.dumps(linked),)], "data string")

        def act(v: Version) -> int:
            id_ = v.next_id("documents")
            v.change(bucket(id_))[id_] = _record(id_, name, "Linked", linked["summary"]["records"], linked["summary"]["width"], None, description, folder if folder in v.part("folders") else None)
            v.put("linked", id_, data)
            return id_

        return self.edit(act)

    def update_linked(self, id_: int, linked: dict) -> None:
        data = self.spark.createDataFrame([(json.dumps(linked),)], "data string")

        def act(v: Version) -> None:
            v.edit_document(id_).update(n_rows=linked["summary"]["records"], width=linked["summary"]["width"])
            v.put("linked", id_, data)

        self.edit(act)

    def documents(self) -> DataFrame:
        return self.table("documents").orderBy("id")

    def document(self, id_: int) -> Row | None:
        found = self.now().document(id_)
        return Row(**{f: found[f] for f in TABLES["documents"].names}) if found else None

    def load(self, id_: int) -> tuple:
        """(info, rows in order, annotations in order); width is at least that of the rows."""
        v = self.now()
        info = {f: v.document(id_)[f] for f in TABLES["documents"].names}
        rows = v.get("rows", id_).orderBy("idx")
        info["width"] = max(info["width"], rows.agg(F.coalesce(F.max(end()), F.lit(0))).first()[0])
        return info, rows, _annotations(v, id_)

    def text(self, id_: int) -> str:
        got = self.now().get("texts", id_).first()
        if got is None:
            raise KeyError(id_)
        return got["content"]

    def linked(self, id_: int) -> dict:
        return json.loads(self.now().get("linked", id_).first()["data"])

    def list_linked(self) -> DataFrame:
        """Linked documents whose data can be read."""
        return self.table("linked").where(F.get_json_object("data", "$").isNotNull())

    def delete_document(self, id_: int) -> None:
        self.edit(lambda v: v.change(bucket(id_)).pop(id_, None) and None)

    def set_info(self, id_: int, **values) -> None:
        """Set fields of a document's record."""
        self.edit(lambda v: v.edit_document(id_).update(values))

    def rename_document(self, id_: int, name: str) -> None:
        self.set_info(id_, name=name)

    def move_document(self, id_: int, folder: int | None) -> None:
        self.set_info(id_, folder_id=folder)

    def set_reference(self, id_: int, row: int | None) -> None:
        """Make a row the reference, or none; counts of columns are of the other rows."""

        def act(v: Version) -> None:
            record = v.edit_document(id_)
            if "counts" in record["files"] and record["reference"] != row:
                one = lambda i: None if i is None else v.get("rows", id_).where(F.col("idx") == i)
                v.put("counts", id_, C.counts_after(v.get("counts", id_), one(row), one(record["reference"]), _width(self.spark, id_, record["width"])))
            record["reference"] = row

        self.edit(act)

    def change_rows(
        self, id_: int, make: Callable[[DataFrame, dict], DataFrame], tracks: dict[str, Callable[[DataFrame], DataFrame]] | None = None, changed: Callable[[DataFrame, dict], tuple[DataFrame | None, DataFrame | None]] | None = None, **info
    ) -> None:
        """Rows that make(rows, record) gives, with the tables of tracks that functions give; numbers of rows and columns follow.

        Without such functions, tracks beyond the new width go. changed(rows, record) gives the rows that go and those that
        come, by which known counts of columns are kept up; without it they are forgotten. info: further fields of the record.
        """

        def act(v: Version) -> None:
            old, record = v.get("rows", id_), v.edit_document(id_)
            gone, come = changed(old, dict(record)) if changed and "counts" in record["files"] else (None, None)
            v.put("rows", id_, make(old, record))
            n, width = v.get("rows", id_).agg(F.count("*"), F.coalesce(F.max(end()), F.lit(0))).first()
            if "counts" in record["files"]:
                v.put("counts", id_, C.counts_after(v.get("counts", id_), gone, come, _width(self.spark, id_, width)) if changed else None)
            for table, far in TRACK_END.items():
                if table in record["files"]:
                    now = v.get(table, id_)
                    v.put(table, id_, now.where(~F.coalesce(far() > width, F.lit(False))) if tracks is None else tracks[table](now) if table in tracks else now)
            record.update({"n_rows": n, "width": width} | info)

        self.edit(act)

    def replace_rows(self, id_: int, rows: DataFrame, tracks: bool = True, **info) -> None:
        """New rows of a document; counts follow, and tracks beyond the new width go."""
        self.change_rows(id_, lambda _, __: rows, None if tracks else {}, **info)

    def delete_rows(self, id_: int, gone: list[int]) -> None:
        from .rows import delete_rows

        def make(rows: DataFrame, record: dict) -> DataFrame:
            left = delete_rows(rows, rows.where(F.col("idx").isin(gone)))
            if left.isEmpty():
                raise ValueError("A document keeps at least one sequence")
            ref = record["reference"]
            new = left.where(F.col("old_idx") == ref).select("idx").first() if ref is not None else None
            record["reference"] = new["idx"] if new else None
            return left.drop("old_idx")

        def gone_rows(rows: DataFrame, record: dict) -> tuple[DataFrame, None]:
            ref = record["reference"]
            kept = None if ref is None or ref not in gone else ref  # the reference is not counted
            return rows.where(F.col("idx").isin([i for i in gone if i != kept])), None

        self.change_rows(id_, make, changed=gone_rows)

    def reorder_rows(self, id_: int, order: list[int]) -> None:
        """Row order[i] becomes row i; order must be a permutation. The reference follows its row."""
        mapping = self.spark.createDataFrame([(o, i) for i, o in enumerate(order)], "idx int, new_idx int")

        def make(rows: DataFrame, record: dict) -> DataFrame:
            if sorted(order) != list(range(rows.count())):
                raise ValueError("not a permutation of the rows")
            record["reference"] = order.index(record["reference"]) if record["reference"] is not None else None
            return rows.join(mapping, "idx").withColumn("idx", F.col("new_idx")).drop("new_idx")

        self.change_rows(id_, make, {}, _none_changed)

    def sort_rows(self, id_: int, key: str, descending: bool = False, columns: list[int] | None = None) -> None:
        """Rows in a permanent order by Name, Length or Bases; the reference goes first and stays the reference."""
        from .display import sort_order
        from .rows import reorder_rows

        def make(rows: DataFrame, record: dict) -> DataFrame:
            order = sort_order(rows, key, record["reference"], descending, columns)
            record["reference"] = None if record["reference"] is None else 0
            return reorder_rows(rows, order)

        self.change_rows(id_, make, {}, _none_changed)

    def update_metadata(self, id_: int, rows: DataFrame) -> None:
        """Replace meta of the rows in (idx, meta)."""
        new = rows.select("idx", F.col("meta").alias("new"))
        self.change_rows(id_, lambda old, _: old.join(new, "idx", "left").withColumn("meta", F.coalesce("new", "meta")).select(*ROWS.names), {}, _none_changed)

    def append_rows(self, id_: int, rows: DataFrame) -> None:
        """Rows added after those there are, in order of their idx."""

        def make(old: DataFrame, record: dict) -> DataFrame:
            placed = numbered(rows.withColumn("doc_id", F.lit(id_).cast("long")), ["doc_id"], [F.col("idx")], "new_idx")
            return old.unionByName(placed.withColumn("idx", (F.col("new_idx") + record["n_rows"]).cast("int")).select(*ROWS.names))

        self.change_rows(id_, make, {}, lambda _, __: (None, rows.withColumn("doc_id", F.lit(id_).cast("long"))))

    def column_counts(self, id_: int) -> DataFrame:
        """Counts of a document's columns, without its reference: counted once, and kept up by edits that say which rows they change."""

        def act(v: Version) -> None:
            if "counts" not in v.edit_document(id_)["files"]:
                v.put("counts", id_, C.column_counts(v.get("rows", id_), v.document(id_)["reference"]))

        if "counts" not in (self.now().document(id_) or {"files": {}})["files"]:
            self.edit(act)
        return self.now().get("counts", id_)

    def insert_copy(self, id_: int, chosen: list[int], name: str, cut: bool = False) -> int:
        """A new document of rows as they are, with the tracks that fit; cut removes them from the source."""
        from .rows import copy_kind

        info, rows, _ = self.load(id_)
        mine = rows.where(F.col("idx").isin(chosen))
        placed = numbered(mine, ["doc_id"], [F.col("idx")], "new_idx").withColumn("idx", F.col("new_idx").cast("int")).drop("new_idx")
        kind = (copy_kind(mine, info["kind"]).first() or {"kind": info["kind"]})["kind"]
        tracks = {t: self.tracks(t, id_).where(far() <= info["width"]) for t, far in TRACK_END.items()}
        new = self.insert_document(name, kind, placed)
        for table, df in tracks.items():
            self._add(table, new, df, [F.col("id")])
        if cut:
            self.delete_rows(id_, chosen)
        return new

    # tracks
    def tracks(self, table: str, id_: int) -> DataFrame:
        return self.now().get(table, id_)

    def annotations(self, id_: int) -> DataFrame:
        return _annotations(self.now(), id_)

    def features(self, id_: int) -> DataFrame:
        """Features in order of first column, end and id; those without a part are left out, strands are -1, 0 or 1."""
        t = self.tracks("features", id_).where(F.size("parts") > 0).withColumn("strand", F.signum("strand").cast("int"))
        return t.orderBy(F.col("parts")[0]["start"], F.array_max(F.transform("parts", lambda p: p["end"])), "id")

    def _add(self, table: str, id_: int, tracks: DataFrame, order: list[Column]) -> int:
        """Append tracks with new ids in an order; the first id."""
        ordered, n = self._in_order(tracks, order)

        def act(v: Version) -> int:
            if n:
                first = v.next_id(table, n)
                new = ordered.withColumns({"id": F.col("place") + F.lit(first), "doc_id": F.lit(id_)}).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table]))
                v.put(table, id_, v.get(table, id_).unionByName(new))
                return first
            return 0

        return self.edit(act)

    def _in_order(self, tracks: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
        """Tracks with their place in an order, and how many they are."""
        return numbered(tracks.withColumn("doc_id", F.lit(0).cast("long")), ["doc_id"], order, "place"), tracks.count()

    def add_annotation(self, id_: int, name: str, kind: str, start: int, end_: int, note: str = "", color: str | None = None) -> int:
        return self.add_annotations(id_, self.spark.createDataFrame([(name, kind, start, end_, note, color)], "name string, kind string, start_col int, end_col int, note string, color string"))

    def add_annotations(self, id_: int, annotations: DataFrame) -> int:
        """Annotations with new ids in order of their columns; the first id."""
        return self._add("annotations", id_, annotations, [F.col("start_col"), F.col("end_col"), F.col("name")])

    def add_features(self, id_: int, features: DataFrame) -> None:
        self._add("features", id_, features, FEATURE_ORDER())

    def _each(self, table: str, ids: list[int], make: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite a table of the documents that have these tracks."""
        owners = [r[0] for r in self.table(table).where(F.col("id").isin(ids)).select("doc_id").distinct().collect()]  # at most one a given id

        def act(v: Version) -> None:
            for id_ in owners:
                if v.document(id_):
                    v.put(table, id_, make(v.get(table, id_)))

        self.edit(act)

    def set_tracks(self, table: str, ids: list[int], **values) -> None:
        here = F.col("id").isin(ids)
        self._each(table, ids, lambda t: t.withColumns({c: F.when(here, F.lit(x)).otherwise(F.col(c)) for c, x in values.items()}))

    def update_annotation(self, id_: int, **values) -> None:
        self.set_tracks("annotations", [id_], **values)

    def delete_annotations(self, ids: list[int]) -> None:
        self._each("annotations", ids, lambda t: t.where(~F.col("id").isin(ids)))

    def update_feature(self, id_: int, name: str, color: str | None) -> None:
        self.set_tracks("features", [id_], name=name, color=color)

    def delete_features(self, ids: list[int]) -> None:
        self._each("features", ids, lambda t: t.where(~F.col("id").isin(ids)))

    def set_color(self, table: str, ids: list[int], color: str | None) -> None:
        self.set_tracks(table, ids, color=color)

    # folders and settings
    def create_folder(self, name: str, parent: int | None = None) -> int:
        def act(v: Version) -> int:
            new = v.next_id("folders")
            v.change("folders")[new] = {"id": new, "name": name, "parent_id": parent, "collapsed": False}
            return new

        return self.edit(act)

    def folders(self) -> DataFrame:
        return self.table("folders").orderBy(F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "id")

    def _set_folder(self, id_: int, **values) -> None:
        self.edit(lambda v: v.change("folders")[id_].update(values))

    def rename_folder(self, id_: int, name: str) -> None:
        self._set_folder(id_, name=name)

    def collapse_folder(self, id_: int, collapsed: bool) -> None:
        self._set_folder(id_, collapsed=collapsed)

    def subtree(self, id_: int) -> list[int]:
        return [r["id"] for r in subtree(self.table("folders"), id_).collect()]

    def move_folder(self, id_: int, parent: int | None) -> None:
        def act(v: Version) -> None:
            folders, above = v.change("folders"), parent
            while above is not None:
                if above == id_:
                    raise ValueError("A folder cannot move into itself")
                above = folders[above]["parent_id"]
            folders[id_]["parent_id"] = parent

        self.edit(act)

    def delete_folder(self, id_: int) -> None:
        """Its folders and documents move to its parent."""
        inside = [r["id"] for r in self.table("documents").where(F.col("folder_id") == id_).select("id").collect()]  # a row a document of the folder

        def act(v: Version) -> None:
            folders = v.change("folders")
            up = folders.pop(id_)["parent_id"]
            for f in folders.values():
                if f["parent_id"] == id_:
                    f["parent_id"] = up
            for d in inside:
                record = v.document(d)
                if record and record["folder_id"] == id_:
                    v.edit_document(d)["folder_id"] = up

        self.edit(act)

    def folder_counts(self) -> DataFrame:
        """(id, n): documents in each folder and all below it."""
        return folder_counts(self.table("folders"), self.table("documents"))

    def folder_count(self, id_: int) -> int:
        return self.folder_counts().where(F.col("id") == id_).first()["n"]

    def setting(self, key: str) -> str | None:
        got = self.now().part("settings").get(key)
        return got["value"] if got else None

    def set_setting(self, key: str, value: str) -> None:
        self.edit(lambda v: v.change("settings").update({key: {"key": key, "value": value}}))


def _width(spark: SparkSession, id_: int, width: int) -> DataFrame:
    return spark.createDataFrame([(id_, width)], "doc_id long, width int")


def _none_changed(rows: DataFrame, record: dict) -> tuple[None, None]:
    return None, None


def _record(id_: int, name: str, kind: str, n_rows: int = 0, width: int = 0, reference: int | None = None, description: str = "", folder: int | None = None) -> dict:
    created = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    return {"id": id_, "name": name, "kind": kind, "n_rows": n_rows, "width": width, "reference": reference, "description": description, "created": created, "folder_id": folder, "files": {}}


def _annotations(version: Version, id_: int) -> DataFrame:
    return version.get("annotations", id_).orderBy("start_col", "id")


def folder_counts(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, n): documents in each folder (id, parent_id) and all below it, by one recursive query."""
    below = folders.sparkSession.sql("WITH RECURSIVE t(root, id) AS (SELECT id, id FROM {f} UNION ALL SELECT t.root, f.id FROM {f} f JOIN t ON f.parent_id = t.id) SELECT root, id FROM t", f=folders)
    return below.join(documents.select(F.col("folder_id").alias("id"), F.lit(1).alias("one")), "id", "left").groupBy(F.col("root").alias("id")).agg(F.count("one").alias("n"))


def subtree(folders: DataFrame, root: int) -> DataFrame:
    """Ids of a folder and all below it, by a recursive query."""
    return folders.sparkSession.sql("WITH RECURSIVE t(id) AS (SELECT id FROM {f} WHERE id = {r} UNION ALL SELECT f.id FROM {f} f JOIN t ON f.parent_id = t.id) SELECT id FROM t", f=folders, r=root)


def planned_moves(items: DataFrame, target: int | None, folders: DataFrame, documents: DataFrame) -> DataFrame:
    """Which of items (kind, id) move to a folder: not those there already or inside a moved folder.

    A moved folder that the target lies in is an error: none may enter itself.
    """
    above = folders.sparkSession.sql("WITH RECURSIVE t(id, up) AS (SELECT id, id FROM {f} UNION ALL SELECT t.id, f.parent_id FROM t JOIN {f} f ON t.up = f.id WHERE f.parent_id IS NOT NULL) SELECT id, up FROM t", f=folders.select("id", "parent_id"))
    moved = items.where("kind = 'folder'").select(F.col("id").alias("up"))
    within = above.join(moved, "up", "left_semi").select(F.col("id").alias("parent")).distinct()  # folders that a moved folder holds, or is
    if target is not None and not within.where(F.col("parent") == target).isEmpty():
        raise ValueError("A folder cannot move into itself")
    parents = folders.select(F.lit("folder").alias("kind"), "id", F.col("parent_id").alias("parent")).unionByName(documents.select(F.lit("document").alias("kind"), "id", F.col("folder_id").alias("parent")))
    placed = items.join(parents, ["kind", "id"])
    there = F.col("parent").eqNullSafe(F.lit(target).cast("long"))
    return placed.where(~there).join(within, "parent", "left_anti").select("kind", "id")


def lanes(spans: DataFrame, most: int = 8) -> DataFrame:
    """Lane of each interval (doc_id, id, start, end): the first that is free at its start; beyond `most` the last is shared.

    Sequential by nature: tasks go over sorted intervals, and hold the lanes of one document at a time.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, free = object(), []
        for batch in batches:
            out = []
            for doc, s, e in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if doc != at:
                    at, free = doc, []
                k = next((i for i, f in enumerate(free) if f <= s), None)
                if k is None:
                    k = len(free) if len(free) < most else most - 1
                    if k == len(free):
                        free.append(e)
                free[k] = max(free[k], e)
                out.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(out, pa.int32())], names=["doc_id", "id", "lane"])

    each = spans.select(F.col("id").cast("long").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "start", "end")
    return each.repartition("doc_id").sortWithinPartitions("doc_id", "start", "end", "id").mapInArrow(assign, "doc_id long, id long, lane int")


def meta_to_json(meta: Column) -> Column:
    """Metadata as a list of two-element lists."""
    return F.to_json(F.transform(meta, lambda m: F.array(m["key"], m["value"])))


def meta_from_json(text: Column) -> Column:
    """Metadata of such text; damaged text is empty."""
    got = F.from_json(text, "array<array<string>>")
    return F.coalesce(F.transform(got, lambda m: F.struct(m[0].alias("key"), m[1].alias("value"))), F.array().cast(META))


def position_note(tracks: DataFrame, width: int, one: str = "annotation") -> DataFrame:
    """(n, note): what tracks (end) do when their sequence is edited and becomes `width` long. The sentences are fixed values."""
    n, gone = F.col("n"), F.col("gone")
    has = F.when(n == 1, f"1 {one}; its position is").otherwise(F.concat(n, F.lit(f" {one}s; their positions are")))
    who = F.when(n == 1, "It extends").when(gone == 1, "1 of them extends").otherwise(F.concat(gone, F.lit(" of them extend")))
    more = F.when(gone > 0, F.concat(F.lit(" "), who, F.lit(" past the new end and will be removed."))).otherwise("")
    counted = tracks.agg(F.count("*").alias("n"), F.count_if(F.col("end") > width).alias("gone"))
    return counted.select("n", F.concat(F.lit("This document has "), has, F.lit(" not shifted when bases are inserted or removed."), more).alias("note"))
