"""What a range of columns and some chosen rows of a document are: texts, templates, oligos and documents of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import sequence as S
from . import columns as C
from . import rows as R


def selection_text(coords: DataFrame, c0: int, c1: int) -> DataFrame:
    """(doc_id, text) of the columns c0..c1, with the reference's bases there, from reference_coords()."""
    inside = coords.where((F.col("col") >= c0) & (F.col("col") < c1))
    base = F.col("is_base")
    got = inside.groupBy("doc_id").agg(F.count_if(base).alias("n"), F.min(F.when(base, F.col("pos"))).alias("p0"), F.max(F.when(base, F.col("pos"))).alias("p1"))
    digits = lambda c: N.group_digits(c.cast("long"))
    head = F.concat(F.lit("Selected "), digits(F.lit(c1 - c0)), F.lit(" columns from "), digits(F.lit(c0 + 1)), F.lit(" to "), digits(F.lit(c1)))
    more = F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(" ungapped reference bases from "), digits(F.col("p0")), F.lit(" to "), digits(F.col("p1")), F.lit(")"))
    return got.select("doc_id", F.concat(head, F.when(F.col("n") > 0, more).otherwise("")).alias("text"))


def chosen_rows(selected: DataFrame, rows: DataFrame, reference: int | None) -> DataFrame:
    """Selected rows (doc_id, idx) that there are, without the reference; each once."""
    there = rows.select("doc_id", "idx").join(selected.select("doc_id", "idx").distinct(), ["doc_id", "idx"], "left_semi")
    return there if reference is None else there.where(F.col("idx") != reference)


def shown_columns(mapped: DataFrame, c0: int, c1: int) -> DataFrame:
    """(doc_id, col) of the columns c0..c1 that column_map() shows; all of them where it shows none."""
    inside = mapped.where((F.col("col") >= c0) & (F.col("col") < c1))
    some = inside.groupBy("doc_id").agg(F.bool_or("shown").alias("some"))
    return inside.join(some, "doc_id").where(F.col("shown") | ~F.col("some")).select("doc_id", "col")


def template_row(rows: DataFrame, reference: int | None, source: str = "Reference", percent: int | None = None) -> DataFrame:
    """(doc_id, template): the reference, or the consensus of the other rows, over the whole width with gaps where it has nothing.

    Without a reference the consensus is taken.
    """
    if source == "Reference" and reference is not None:
        wide = rows.where(F.col("idx") == reference).join(R.widths(rows), "doc_id")
        return wide.select("doc_id", F.translate(R.slice_text(F.lit(0), F.col("width")), " ", S.GAP).alias("template"))
    said = C.consensus(C.column_counts(rows, reference), percent)
    return said.select("doc_id", F.translate("consensus", " ", S.GAP).alias("template"))


def oligo(template: Column, kind: Column, c0: Column, c1: Column) -> Column:
    """Bases of a template in c0..c1, from 5' to 3' of an annotation of this kind."""
    text = S.ungap(F.substring(template, c0 + 1, F.greatest(F.least(c1, F.length(template)) - c0, F.lit(0))))
    return F.when(kind == "Reverse primer", S.revcomp(text)).otherwise(text)


def extract_slice(rows: DataFrame, name: str, kind: str, c0: int, c1: int, reference: int | None = None, collapsed: bool = False) -> tuple[str, str, str, DataFrame]:
    """(name, kind, description, rows) of a document of the columns c0..c1 of all rows but the reference.

    collapsed: only columns with a base of the reference. An error says so if no sequence has a base there.
    """
    coords = C.reference_coords(rows, reference) if reference is not None else None
    at = C.reference_range(coords, c0, c1).first() if coords is not None else None
    label = f"ref {at['p0']}-{at['p1']}" if at else f"columns {c0 + 1}-{c1}"
    only = coords.where("is_base") if collapsed and coords is not None else None
    mine = rows if reference is None else rows.where(F.col("idx") != reference)
    out = R.slice_rows(mine, c0, c1, only)
    if out.isEmpty():
        raise ValueError("No sequence has bases in the selected columns")
    left = " without the columns with gaps in the reference" if only is not None else ""
    return f"{name} [{label}]", "Sequences" if kind == "Sequences" else "Alignment", f"Slice {label} of “{name}”{left}", out
