"""Checks before an action, inputs and reports of tools, and actions of several library edits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import sequence as S
from ..sources import fasta
from . import links as K
from . import reads as E
from . import rows as R
from .display import Options
from .library import Library, lanes, position_note


# ---- views -----------------------------------------------------------------------------------------------------------
def ordered_features(features: DataFrame, most: int = 10) -> DataFrame:
    """Features with parts, in the order (ord) of first column, end and id within a document, with their lane."""
    spans = features.where(F.size("parts") > 0).withColumns({"start": R.first_column(), "end": R.last_column()})
    w = Window.partitionBy("doc_id").orderBy("start", "end", "id")
    return spans.withColumn("ord", F.row_number().over(w)).join(lanes(spans, most), ["doc_id", "id"])


def item_of_row(items: DataFrame) -> DataFrame:
    """Place of each row in the display list; rows in folded groups have none."""
    return items.where(F.col("kind") == "row").select("doc_id", "row", F.col("ord").alias("item"))


def keep_view(options: Options, keys: list[str]) -> Options:
    """Options of a view after its document changed: grouping and sorting by metadata that are gone end."""
    grouped = options.group_by if options.group_by in keys else None
    gone = options.sort.startswith("meta:") and options.sort.removeprefix("meta:") not in keys
    return replace(options, group_by=grouped, sort="Original" if gone else options.sort)


def target_folder(selected: Column, own: Column) -> Column:
    """Where a new document goes: the selected folder, else that of the selected document."""
    return F.coalesce(selected, own)


# ---- typed sequences -------------------------------------------------------------------------------------------------
SHOWN = 6
# What is said of a typed text that cannot be stored; %s is a name, %d a number.
TYPED = {
    "none": "Type or paste a sequence.",
    "bare": "The record has no sequence yet.",
    "one": "“%s” has no sequence.",
    "many": "%d records found: this document holds one sequence. Use File → New sequence… to create a sequence list.",
    "name": "Enter a name.",
}


def typed_summary(texts: DataFrame) -> DataFrame:
    """What was typed or pasted in (id, text): id, n, summary, note, listing of the first records, and problem.

    Expects name (of the new document) and edit (whether one sequence is edited) in texts as well.
    """
    rec = fasta.pasted(texts)
    letters = S.ungap(F.col("seq"))
    called = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Sequence "), F.col("n")))
    each = rec.select("id", "n", "unknown", F.length(letters).alias("bases"), F.length("seq").alias("width"), (F.length(letters) - F.length(F.regexp_replace(letters, "[^ACGT]", ""))).alias("ambiguous"), S.gc_percent(F.col("seq")).alias("gc"), called.alias("called"))
    digits = N.group_digits
    line = F.struct("n", F.concat("called", F.lit(" · "), digits(F.col("bases")), F.lit(" bp")).alias("said"))
    got = each.groupBy("id").agg(
        F.count("*").alias("n"), F.sum("unknown").alias("unknown"), F.min("bases").alias("least"), F.max("bases").alias("most"), F.min("width").alias("narrow"), F.max("width").alias("wide"),
        F.min_by(F.struct("bases", "width", "ambiguous", "gc"), "n").alias("one"), F.array_sort(F.collect_list(F.when(F.col("n") <= SHOWN, line))).alias("lines"),
        F.min(F.when(F.col("bases") == 0, F.struct("n", "called"))).alias("empty"),
    )
    one = F.col("one")
    extra = lambda n, what: F.when(n > 0, F.concat(F.lit(" · "), digits(n), F.lit(what))).otherwise("")
    gaps = one["width"] - one["bases"]
    single = F.concat(digits(one["bases"]), F.lit(" bp · GC "), F.format_number(one["gc"], 1), F.lit("%"), extra(one["ambiguous"], " ambiguous (N, R, Y…)"), extra(gaps, " gaps"))
    span = F.when(F.col("least") == F.col("most"), F.concat(digits(F.col("least")), F.lit(" bp each"))).otherwise(F.concat(digits(F.col("least")), F.lit("–"), digits(F.col("most")), F.lit(" bp")))
    gapped = each.where(F.col("width") > F.col("bases")).select("id").distinct().withColumn("gapped", F.lit(True))
    kind = F.when(F.coalesce("gapped", F.lit(False)) | (F.col("narrow") == F.col("wide")), "alignment").otherwise("sequence list")
    many = F.concat(digits(F.col("n")), F.lit(" sequences · "), span, F.lit(" → new "), kind)
    more = F.when(F.col("n") > SHOWN, F.array(F.concat(F.lit("… "), F.col("n") - SHOWN, F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    listing = F.when(F.col("n") > 1, F.concat(F.transform("lines", lambda x: x["said"]), more)).otherwise(F.array().cast("array<string>"))
    note = F.when(F.col("unknown") > 0, F.concat(digits(F.col("unknown")), F.lit(" character(s) that are not nucleotide codes will be stored as N.")))
    several, bare, edit = F.col("n") > 1, F.col("empty").isNotNull(), F.coalesce("edit", F.lit(False))
    nameless = F.trim(F.coalesce("name", F.lit(""))) == ""
    # no two of these conditions hold together
    cases = {
        "name": ((F.col("n") > 0) & ~bare & ~(edit & several) & nameless, []), "one": (several & bare, [F.col("empty.called")]), "many": (several & ~bare & edit, [F.col("n")]),
        "bare": (~several & bare, []), "none": (F.col("n") == 0, []),
    }
    problem = F.coalesce(*(F.when(when, F.format_string(TYPED[k], *values) if values else F.lit(TYPED[k])) for k, (when, values) in cases.items()))
    all_ = texts.select("id", "name", "edit").join(got, "id", "left").join(gapped, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return all_.select("id", "n", F.when(F.col("n") == 0, "").when(F.col("n") == 1, single).otherwise(many).alias("summary"), note.alias("note"), F.coalesce(listing, F.array().cast("array<string>")).alias("listing"), problem.alias("problem"))


# The texts of the results below are fixed values: they are what a user of the tool knows.
# ---- feature records -------------------------------------------------------------------------------------------------
def feature_target(records: DataFrame, target: DataFrame, by: str = "path") -> DataFrame:
    """The record whose features fit a sequence: for each row of target (by, label, seq) version, differences, problem.

    It is the first nucleotide record of the same length. Differences (U counts as T) are null where a record lists no bases.
    """
    want = target.select(by, "label", "seq", F.length("seq").alias("wanted"))
    fits = (F.col("length") == F.col("wanted")) & ~F.col("protein")
    rec = F.struct("n", "version", "length", "protein", "definition")
    got = records.join(want, by).groupBy(by).agg(F.count("*").alias("found"), F.min(rec).alias("one"), F.min(F.when(fits, F.struct("n", "version", "sequence"))).alias("fit"))
    one, digits = F.col("one"), N.group_digits
    title = S.shorten(F.regexp_replace(one["definition"], r"\.+$", ""), 80)
    long_ = F.concat(F.lit(" is "), digits(one["length"]), F.lit(" bp long"))
    what = F.when(F.col("found") > 1, F.concat(F.lit("None of the "), F.col("found"), F.lit(" records is "), digits(F.col("wanted")), F.lit(" bp long"))).when(one["definition"] == "", F.concat(F.lit("The record "), one["version"], long_)).otherwise(F.concat(F.lit("The record "), one["version"], F.lit(" ("), title, F.lit(")"), long_))
    other = F.concat(what, F.lit("; "), F.col("label"), F.lit(" has "), digits(F.col("wanted")), F.lit(" bases. Features are only imported onto a sequence of the same length (the same record and version)."))
    protein = F.concat(one["version"], F.lit(" is a protein record; features are imported from nucleotide records."))
    none = F.col("fit").isNull()
    problem = F.when(none & (F.col("found") == 1) & one["protein"], protein).when(none, other)
    from ..sources.genbank import differing

    differences = F.when(F.length("fit.sequence") == F.col("wanted"), differing(F.col("fit.sequence"), F.col("seq")))
    return want.join(got, by).select(by, F.col("fit.version").alias("version"), differences.alias("differences"), problem.alias("problem"))


# ---- linked files ----------------------------------------------------------------------------------------------------
def add_files(known: DataFrame, new: DataFrame) -> DataFrame:
    """Files (path, size) with new ones added; those known already stay as they are."""
    fresh = new.dropDuplicates(["path"]).join(known.select("path"), "path", "left_anti")
    return known.select("path", "size").unionByName(fresh.select("path", "size"))


def regroup(files: DataFrame, old: DataFrame, pair: bool = True, grouping: str = "BySample") -> DataFrame:
    """Read sets proposed anew; a name given before stays where a set has the same files in the same order."""
    key = lambda: F.to_json(F.transform("files", lambda f: f["path"]))
    given = old.select(key().alias("key"), F.col("name").alias("given")).dropDuplicates(["key"])
    sets = E.propose(files, pair, grouping).withColumn("key", key()).join(given, "key", "left")
    return sets.select(F.coalesce("given", "name").alias("name"), "dir", "layout", "files")


def run_inputs(sets: DataFrame) -> DataFrame:
    """Runs of read sets (name, layout, files): each lane of paired reads, else each file; r2 is null for single reads.

    problem says why a set has none; it stands on the first row of the set, then.
    """
    paired = F.col("layout") == "Paired"
    step = F.when(paired, 2).otherwise(1)
    n = F.floor(F.size("files") / step).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    each = F.transform(starts, lambda i: F.struct(F.get("files", i).alias("a"), F.when(paired, F.get("files", i + 1)).alias("b")))
    odd = paired & ((F.size("files") < 2) | (F.size("files") % 2 == 1))
    mixed = paired & F.exists(each, lambda x: (x["a"]["role"] != "R1") | (x["b"]["role"] != "R2"))
    problem = F.when(odd, "A paired read set needs R1 and R2 files").when(mixed, "The R1 and R2 files of the read set are not in order")
    runs = sets.select("name", n.alias("n"), paired.alias("paired"), problem.alias("problem"), F.posexplode_outer(each).alias("i", "run")).where(F.col("problem").isNull() | (F.coalesce("i", F.lit(0)) == 0))
    part = F.when(F.col("n") > 1, F.concat(F.when(F.col("paired"), "Lane ").otherwise("File "), F.col("i") + 1, F.lit(" of "), F.col("n"))).otherwise("")
    good = F.col("problem").isNull()
    return runs.where(~good | F.col("run").isNotNull()).select("name", F.when(good, part).alias("part"), F.when(good, F.col("run.a.path")).alias("r1"), F.when(good, F.col("run.b.path")).alias("r2"), "problem")


def linked_files(files: DataFrame, runs: DataFrame) -> DataFrame:
    """The files (path) that runs read."""
    used = runs.select(F.explode(F.array("r1", "r2")).alias("path"))
    return files.join(used, "path", "left_semi")


def error_text(lines: DataFrame, by: str = "run") -> DataFrame:
    """Why runs failed, by their output lines (by, ord, line): what follows `error:`, else all they wrote."""
    said = F.regexp_replace("line", r"^\s+|\s+$", "")
    error = F.when(said.startswith("error:"), F.trim(F.substr(said, F.lit(7))))
    joined = lambda text: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("ord", text.alias("t"))))), lambda x: x["t"]), "\n")
    got = lines.groupBy(by).agg(F.count(error).alias("n"), joined(error).alias("errors"), F.regexp_replace(joined(F.col("line")), r"^\s+|\s+$", "").alias("all"))
    return got.select(by, F.when(F.col("n") > 0, F.col("errors")).otherwise(F.col("all")).alias("text"))


# ---- runs on selected columns ----------------------------------------------------------------------------------------
def run_records(rows: DataFrame, chosen: DataFrame, c0: int, c1: int, only: DataFrame | None = None) -> DataFrame:
    """FASTA records (doc_id, idx, name, text) of chosen rows in c0..c1 as a tool reads them, gaps and no coverage as `-`."""
    mine = R.slice_rows(rows.join(chosen.select("doc_id", "idx"), ["doc_id", "idx"], "left_semi"), c0, c1, only)
    wide = mine.join(R.widths(mine), "doc_id")
    return wide.select("doc_id", "idx", "name", F.lit("").alias("description"), R.slice_text(F.lit(0), F.col("width"), S.GAP).alias("text"))


# The fields of a report and their texts, in run_report().
TITLE = "PRIMER SEARCH RUN"


def run_report(about: dict[str, Column]) -> Column:
    """Text of a report. about: document, selection, collapsed, columns, rows, chosen, written, usable, gaps, ambiguous, tool,
    version, path, command, started, finished, seconds, positions (array of lines) and output.
    """
    a, d = about, N.group_digits
    some = lambda n, text: F.when(n, text).otherwise("")
    lost = a["chosen"] - a["written"]
    fields = {
        "Document": a["document"],
        "Selection": F.concat(a["selection"], some(a["collapsed"], "; columns with gaps in the reference left out")),
        "Columns": d(a["columns"]),
        "Sequences": F.concat(a["rows"], F.lit(": "), d(a["chosen"]), F.lit(" chosen"), some(lost > 0, F.concat(F.lit(", "), d(lost), F.lit(" without bases in the selection left out")))),
        "Usable": F.concat(d(a["usable"]), some(a["gaps"] + a["ambiguous"] > 0, F.concat(F.lit(" of "), d(a["written"]), F.lit(" ("), a["tool"], F.lit(" drops "), d(a["gaps"]), F.lit(" with gaps or no coverage and "), d(a["ambiguous"]), F.lit(" with N/ambiguity codes)")))),
        "Tool": F.concat(a["tool"], F.lit(" "), a["version"], F.lit(" ("), a["path"], F.lit(")")),
        "Command": a["command"],
        "Started": a["started"],
        "Finished": F.concat(a["finished"], F.lit(" ("), N.duration(a["seconds"]), F.lit(")")),
    }
    head = [F.concat(F.lit(f"{k + ':':<12} "), v) for k, v in fields.items()]
    positions = F.concat(F.array(F.lit("Positions in the output count the columns passed to the tool:")), a["positions"])
    return F.concat_ws("\n", F.lit(TITLE), F.lit("=" * len(TITLE)), *head, F.lit(""), F.array_join(positions, "\n"), F.lit(""), F.concat(F.regexp_replace(a["output"], r"\s+$", ""), F.lit("\n")))


# ---- actions ---------------------------------------------------------------------------------------------------------
def _changeable(lib: Library, id_: int, what: str) -> None:
    if lib.document(id_)["kind"] == "Linked":
        raise ValueError(f"Linked files are read-only: {what} cannot be saved. Import the file into the library to change it.")


def _counted(n: int, what: str) -> str:
    return f"1 {what}" if n == 1 else f"{n:,} {what}s"


def import_features(lib: Library, id_: int, features: DataFrame, source: str) -> str:
    """Add the chosen features (flag chosen) to a document; says what was done."""
    _changeable(lib, id_, "features")
    mine = features.where("chosen").drop("chosen")
    n = mine.count()
    lib.add_features(id_, mine)
    return f"Imported {_counted(n, 'feature')} from {source}"


def import_record(lib: Library, row: DataFrame, features: DataFrame, source: str, folder: int | None = None) -> tuple[int, str]:
    """A new document of one record's row with its chosen features, in one version: if the features fail, there is no document."""
    new = row.select("name", "description", F.length(S.ungap(F.col("data"))).alias("size")).first()
    mine = features.where("chosen").drop("chosen")
    try:
        n = mine.count()
        id_ = lib.insert_document(new["name"], "Sequences", row, None, new["description"], folder, features=mine if n else None)
    except Exception as e:
        raise ValueError(f"The features could not be saved, so {source} was not imported: {e}") from e
    return id_, f"Imported {source} ({new['size']:,} bp)" + (f" with {_counted(n, 'feature')}" if n else "")


def save_rows(lib: Library, id_: int, chosen: list[int], cut: bool = False) -> int:
    """A new document of chosen rows, named after its source; cut takes them out of it."""
    if cut:
        _changeable(lib, id_, "cut sequences")
    info, rows, _ = lib.load(id_)
    names = [r["name"] for r in rows.where(F.col("idx").isin(chosen)).select("name").limit(2).collect()]
    label = names[0] if len(names) == 1 else _counted(len(chosen), "sequence")
    return lib.insert_copy(id_, chosen, f"{info['name']} [{label}]", cut)


def trim(lib: Library, id_: int) -> tuple[int, int] | None:
    """Crop a document with its tracks to the columns that have bases; None if it is no wider."""
    _changeable(lib, id_, "trimmed columns")
    rows = lib.load(id_)[1]
    at = R.trim_window(rows).first()
    if at is None:
        return None
    c0, c1 = at["c0"], at["c1"]
    kept = lambda crop: lambda t: crop(t, c0, c1).where(F.col("status") != "removed").drop("status")
    lib.change_rows(id_, lambda rows, _: R.crop(rows, c0, c1).drop("change"), {"annotations": kept(R.crop_annotations), "features": kept(R.crop_features)})
    return c0, c1


def save_sequence(lib: Library, text: DataFrame, name: str, description: str = "", edit: int | None = None, folder: int | None = None) -> int:
    """Store what was typed in (id, text): a new document, or the one sequence of document `edit`."""
    problem = typed_summary(text.withColumns({"name": F.lit(name), "edit": F.lit(edit is not None)})).first()["problem"]
    if problem:
        raise ValueError(problem)
    records = fasta.pasted(text)
    rows = fasta.pasted_document(records, name, description)
    if edit is not None:
        lib.replace_rows(edit, rows, name=name, description=description)
        return edit
    kind = fasta.pasted_kind(records).first()["kind"]
    return lib.insert_document(name, kind, rows, None, description, folder)


def link(lib: Library, sets: DataFrame, scans: DataFrame, folder: int | None = None) -> list[int]:
    """A linked document for each proposed set of files, with totals of their scans.

    scans: path, records, width and what later shows changes of a file: size, modified (seconds or null), digest.
    """
    each = sets.select("name", "layout", F.posexplode("files").alias("pos", "f")).select("name", "layout", "pos", "f.path", "f.role").join(scans, "path")
    file = F.struct("pos", "path", "role", "size", "modified", "digest")
    got = each.groupBy("name", "layout").agg(F.sum("records").alias("records"), F.max("width").alias("width"), F.array_sort(F.collect_list(file)).alias("files"))
    ids = []
    for s in got.orderBy("name").collect():  # sets a user has confirmed
        files = [{k: v for k, v in f.asDict().items() if k != "pos"} for f in s["files"]]
        ids.append(lib.insert_linked(s["name"], {"name": s["name"], "layout": s["layout"], "files": files, "summary": {"records": s["records"], "width": s["width"]}}, folder=folder))
    return ids


def linked_table(lib: Library, ids: list[int] | None = None) -> DataFrame:
    """(set, idx, path, size, modified, digest) of the files of linked documents, the set being the document."""
    one = "array<struct<path: string, size: long, modified: long, digest: string>>"
    data = lib.table("linked") if ids is None else lib.table("linked").where(F.col("doc_id").isin(ids))
    each = data.select(F.col("doc_id").alias("set"), F.posexplode(F.from_json("data", f"files {one}")["files"]).alias("idx", "f"))
    return each.select("set", "idx", "f.path", "f.size", "f.modified", "f.digest")


def check_links(lib: Library, ids: list[int] | None = None) -> DataFrame:
    """(set, idx, path, state) of the files of linked documents."""
    return K.states(linked_table(lib, ids)).select("set", "idx", "path", "state")


def relink(lib: Library, id_: int, idx: int, path: str) -> int:
    """Point a document's file to where a user has found it, and files of all documents that have moved with it; how many."""
    before = linked_table(lib)
    after = K.relinked(before, id_, idx, path)
    new = after.withColumnsRenamed({"path": "new_path", "modified": "new_modified"}).join(before.select("set", "idx", "path"), ["set", "idx"]).where("path <> new_path")
    found: dict[int, list] = {}
    for r in new.select("set", "idx", "new_path", "new_modified").toLocalIterator():  # a row a moved file
        found.setdefault(r["set"], []).append(r)
    for set_, rows in found.items():
        linked = lib.linked(set_)
        for r in rows:
            linked["files"][r["idx"]].update(path=r["new_path"], modified=r["new_modified"])
        lib.update_linked(set_, linked)
    return sum(map(len, found.values()))


def save_report(lib: Library, name: str, text: str, folder: int | None = None) -> int:
    """A text document of a report."""
    return lib.insert_text(name, text, "", folder)


def end_notes(annotations: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """(n, note): what an edit of a sequence means for its tracks (end), a row for each kind there is."""
    notes = position_note(annotations, width).unionByName(position_note(features, width, "imported feature"))
    return notes.where("n > 0")
