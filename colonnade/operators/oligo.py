"""Oligo reports: how each sequence fits a primer or probe cut from a template."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import sequence as S
from . import rows as R

_COMPLEMENT = str.maketrans(*S.COMPLEMENT)


@dataclass
class Oligo:
    """Columns c0..c1 of a template: the oligo in its own direction, and the oligo position of each column."""

    template: str
    c0: int
    c1: int
    reverse: bool = False
    window: int = 5

    def __post_init__(self) -> None:
        self.c1 = max(self.c0, self.c1)
        self.part = self.template[self.c0 : self.c1].replace(" ", S.GAP).ljust(self.c1 - self.c0, S.GAP)
        forward = self.part.replace(S.GAP, "")
        self.text = forward[::-1].translate(_COMPLEMENT) if self.reverse else forward
        self.positions, seen = [], 0
        for b in self.part:
            at = min(max(0, seen - 1) if b == S.GAP else seen, max(0, len(forward) - 1))
            self.positions.append(len(forward) - 1 - at if self.reverse else at)
            seen += b != S.GAP

    def mismatch(self, j: int, b: Column) -> Column:
        """Whether a cell of column j differs: gap against base, or bases with nothing in common."""
        o = self.part[j]
        if o == S.GAP:
            return b != S.GAP
        fits = [x for x in S.MASK_ORDER if (S.MASK_ORDER.index(x) + 1) & (S.MASK_ORDER.index(o) + 1)] if o in S.MASK_ORDER else []
        return ~b.isin(*fits) if fits else F.lit(True)


def evaluated(rows: DataFrame, oligo: Oligo, reference: int | None = None) -> DataFrame:
    """Each row but the reference: covered, slice, mismatches, three_prime, ambiguous. No explode, no shuffle.

    A row is covered only if it covers all columns of the oligo.
    """
    inside = rows if reference is None else rows.where(F.col("idx") != reference)
    covered = (F.col("start") <= oligo.c0) & (R.end() >= oligo.c1) & F.lit(oligo.c1 > oligo.c0)
    part = F.when(covered, F.substring("data", F.lit(oligo.c0) - F.col("start") + 1, F.lit(oligo.c1 - oligo.c0)))
    out = inside.withColumn("covered", covered).withColumn("slice", part)
    cell = lambda j: F.substring("slice", j + 1, 1)
    wrong = [oligo.mismatch(j, cell(j)) for j in range(len(oligo.part))]
    near = [w for w, p in zip(wrong, oligo.positions, strict=True) if len(oligo.text) - 1 - p < oligo.window and oligo.text]
    odd = [~cell(j).isin("A", "C", "G", "T", "-") for j, o in enumerate(oligo.part) if o != S.GAP]
    total = lambda xs: sum((x.cast("int") for x in xs), F.lit(0))
    return out.withColumns({"mismatches": F.when(F.col("covered"), total(wrong)), "three_prime": F.when(F.col("covered"), total(near) > 0), "ambiguous": F.when(F.col("covered"), total(odd) > 0)})


def totals(each: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col("covered") & c)
    return each.groupBy("doc_id").agg(
        F.count_if("covered").alias("sequences"), F.count_if(~F.col("covered")).alias("no_coverage"), *(n(F.col("mismatches") == k).alias(f"mm{k}") for k in range(3)), n(F.col("mismatches") >= 3).alias("mm3"),
        n(F.col("three_prime")).alias("three_prime"), n(F.col("ambiguous")).alias("with_ambiguity"),
    )


def per_position(each: DataFrame, oligo: Oligo) -> DataFrame:
    """Mismatches at each oligo position: one aggregate row a document, then unpivoted."""
    sums = each.where("covered").groupBy("doc_id").agg(*(F.count_if(oligo.mismatch(j, F.substring("slice", j + 1, 1))).alias(f"c{j}") for j in range(len(oligo.part))))
    pairs = F.array(*(F.struct(F.lit(p).alias("position"), F.col(f"c{j}").alias("n")) for j, p in enumerate(oligo.positions)))
    return sums.select("doc_id", F.explode(pairs).alias("x")).groupBy("doc_id", "x.position").agg(F.sum("x.n").alias("mismatches"))


def shown(oligo: Oligo, part: Column) -> Column:
    """A slice as it is shown: in the oligo's direction, equal bases as dots, columns of two gaps left out."""
    line = S.revcomp(part) if oligo.reverse else part
    template = oligo.part[::-1].translate(_COMPLEMENT) if oligo.reverse else oligo.part
    cells = []
    for j, o in enumerate(template):
        b = F.substring(line, j + 1, 1)
        cells.append(F.when(b == S.GAP, "").otherwise(b) if o == S.GAP else F.when(b == o, ".").otherwise(b))
    return F.concat(*cells)


def variants(each: DataFrame, oligo: Oligo, top: int = 12) -> DataFrame:
    """The most common slices of a document's rows: count down, then mismatches, then text."""
    by = each.where("covered").groupBy("doc_id", "slice").agg(F.count("*").alias("n"), F.first("mismatches").alias("mismatches"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "mismatches", "slice")
    return by.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= top).select("doc_id", "ord", shown(oligo, F.col("slice")).alias("display"), "n", "mismatches")


def by_group(each: DataFrame, key: str) -> DataFrame:
    """Counts for each value of a metadata key."""
    c = F.col("covered")
    out = each.groupBy("doc_id", F.coalesce(R.meta_value(key), F.lit("(none)")).alias("label")).agg(
        F.count_if(c).alias("sequences"), F.count_if(c & (F.col("mismatches") == 0)).alias("perfect"), F.count_if(c & (F.col("mismatches") == 1)).alias("one_mismatch"), F.count_if(c & F.col("three_prime")).alias("three_prime"), F.count_if(~c).alias("no_coverage")
    )
    return out.orderBy("doc_id", F.desc("sequences"), "label")


def properties(spark, oligo: Oligo) -> DataFrame:
    """The oligo, its GC share and the range of its melting temperature."""
    one = spark.range(1).select(F.lit(oligo.text).alias("oligo"))
    return one.withColumn("tm", N.tm_range(F.col("oligo"))).select("oligo", S.gc_percent(F.col("oligo")).alias("gc"), F.col("tm.lo").alias("tm_lo"), F.col("tm.hi").alias("tm_hi"))


def report_text(rows: DataFrame, oligo: Oligo, reference: int | None = None) -> DataFrame:
    """The report of each document as lines of tab-separated text."""
    tm = N.tm_range(F.lit(oligo.text))
    t = totals(evaluated(rows, oligo, reference)).withColumns({"oligo": F.lit(oligo.text), "gc": S.gc_percent(F.lit(oligo.text)), "tm_lo": tm["lo"], "tm_hi": tm["hi"]})
    share = lambda c: F.concat(F.col(c).cast("string"), F.lit("\t"), F.format_number(N.percent(F.col(c), F.col("sequences")), 2), F.lit("%"))
    lines = [
        F.concat(F.lit("Columns\t"), F.lit(f"{oligo.c0 + 1}-{oligo.c1}")), F.concat(F.lit("Oligo\t"), F.col("oligo")), F.concat(F.lit("Tm\t"), N.format_tm(F.col("tm_lo"), F.col("tm_hi"))), F.concat(F.lit("GC\t"), F.format_number("gc", 0), F.lit("%")),
        F.concat(F.lit("Sequences\t"), F.col("sequences").cast("string")), *(F.concat(F.lit(f"{label}\t"), share(c)) for label, c in (("Perfect match", "mm0"), ("1 mismatch", "mm1"), ("2 mismatches", "mm2"), ("3 or more mismatches", "mm3"), ("Mismatch at the 3' end", "three_prime"), ("With ambiguous bases", "with_ambiguity"))),
        F.concat(F.lit("Not covered\t"), F.col("no_coverage").cast("string")),
    ]
    return t.select("doc_id", F.concat_ws("\n", *lines).alias("report"))
