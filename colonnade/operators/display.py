"""Display order: natural sorting, filtering, grouping and collapsing of rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from . import rows as R
from .ranks import numbered, running


def natural_key(s: Column) -> Column:
    """struct that sorts numbers by value before texts, and texts in lower case with digit runs by value.

    A digit run becomes its length without leading zeros in five digits, then those digits, so that plain text order works.
    """
    t = F.trim(s)
    number = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.cast("double"))
    tokens = F.regexp_extract_all(F.lower(s), F.lit("[0-9]+|[^0-9]"), 0)

    def one(tok: Column) -> Column:
        digits = F.regexp_replace(tok, "^0+", "")
        return F.when(tok.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 5, "0"), digits)).otherwise(tok)

    return F.struct(number.isNull().alias("is_text"), number.alias("number"), F.when(number.isNull(), F.array_join(F.transform(tokens, one), "")).alias("text"))


def sort_order(rows: DataFrame, key: str, reference: int | None = None, descending: bool = False, columns: list[int] | None = None) -> DataFrame:
    """(doc_id, idx, new_idx) of a permanent, stable sort by Name, Length or Bases; the reference goes first."""
    value = natural_key(F.col("name")) if key == "Name" else R.ungapped_len() if key == "Length" else F.array(*(N.base_rank(R.at(F.lit(c))) for c in columns or []))
    first = F.col("idx") != F.lit(-1 if reference is None else reference)
    keyed = rows.select("doc_id", "idx", first.alias("rest"), F.when(first, value).alias("key"))
    placed = numbered(keyed, ["doc_id"], [F.col("rest"), F.desc("key") if descending else F.asc("key"), F.col("idx")], "new_idx")
    return placed.select("doc_id", "idx", F.col("new_idx").cast("int").alias("new_idx"))


def default_descending(key: str) -> bool:
    return key == "Length"


@dataclass
class Options:
    """sort: Original, Name, StartPosition, Length, IdentityToReference or meta:<key>."""

    name_filter: str = ""
    sort: str = "Original"
    descending: bool = False
    group_by: str | None = None
    folded: list[str] = field(default_factory=list)
    collapse: bool = False


def build(rows: DataFrame, options: Options, reference: int | None = None, identity: DataFrame | None = None) -> DataFrame:
    """Display items of each document in order: doc_id, ord, kind (group or row), label, row, n, folded.

    One numbering by document orders rows; collapsing and grouping are aggregations on it.
    """
    wanted = options.name_filter.strip().lower()
    some = rows if reference is None else rows.where(F.col("idx") != reference)
    if wanted:
        some = some.where(F.contains(F.lower("name"), F.lit(wanted)) | F.contains(F.lower("description"), F.lit(wanted)))
    if options.sort == "IdentityToReference" and identity is not None:
        some = some.join(identity.select("doc_id", "idx", "identity"), ["doc_id", "idx"])
    key = {
        "Original": lambda: F.col("idx"), "Name": lambda: natural_key(F.col("name")), "StartPosition": lambda: F.struct("start", R.end()), "Length": R.ungapped_len,
        "IdentityToReference": lambda: F.col("identity") if identity is not None else F.lit(0),
    }.get(options.sort, lambda: natural_key(F.coalesce(R.meta_value(options.sort.removeprefix("meta:")), F.lit(""))))()
    label = F.coalesce(R.meta_value(options.group_by), F.lit("(none)")) if options.group_by else F.lit(None).cast("string")
    keyed = some.select("doc_id", "idx", "start", "data", label.alias("label"), key.alias("key"))
    placed = numbered(keyed, ["doc_id", "label"], [F.desc("key") if options.descending else F.asc("key"), F.col("idx")], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
    if options.collapse:
        items = placed.groupBy("doc_id", "label", "start", "data").agg(F.min("rank").alias("rank"), F.min_by("idx", "rank").alias("row"), F.count("*").alias("n"))
    else:
        items = placed.select("doc_id", "label", "rank", F.col("idx").alias("row"), F.lit(1).cast("long").alias("n"))
    items = items.select("doc_id", F.lit("row").alias("kind"), "label", "rank", "row", "n", F.lit(False).alias("folded"))
    if options.group_by:
        folded = F.col("label").isin(*options.folded) if options.folded else F.lit(False)
        heads = placed.groupBy("doc_id", "label").agg(F.count("*").alias("n")).select("doc_id", F.lit("group").alias("kind"), "label", F.lit(0).alias("rank"), F.lit(None).cast("int").alias("row"), "n", folded.alias("folded"))
        items = heads.unionByName(items.where(~folded))
    out = numbered(items, ["doc_id"], [natural_key(F.coalesce("label", F.lit(""))), F.col("label"), F.col("rank")], "ord")
    return out.select("doc_id", F.col("ord").cast("int").alias("ord"), "kind", "label", "row", "n", "folded")


def group_prefix(items: DataFrame) -> DataFrame:
    """Items with the number of group headers up to each."""
    return running(items, ["doc_id"], [F.col("ord")], (F.col("kind") == "group").cast("long"), "groups")
