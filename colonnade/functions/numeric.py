"""Melting temperatures, labels and colors as Column expressions.

Numbers are rendered by format_number: it rounds the binary value, ties to even, where format_string would round its text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sequence as S

# Nearest-neighbor enthalpies (kcal/mol) and entropies (cal/K/mol) of the dinucleotides (SantaLucia 1998 unified set).
NEAREST = {
    "AA": (-7.9, -22.2), "AC": (-8.4, -22.4), "AG": (-7.8, -21.0), "AT": (-7.2, -20.4),
    "CA": (-8.5, -22.7), "CC": (-8.0, -19.9), "CG": (-10.6, -27.2), "CT": (-7.8, -21.0),
    "GA": (-8.2, -22.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "GT": (-8.4, -22.4),
    "TA": (-7.2, -21.3), "TC": (-8.2, -22.2), "TG": (-8.5, -22.7), "TT": (-7.9, -22.2),
}
GAS, KELVIN = 1.987, 273.15


def divalent_to_monovalent(mg: float | Column, dntp: float | Column) -> Column:
    mg, dntp = (x if isinstance(x, Column) else F.lit(float(x)) for x in (mg, dntp))
    return F.when(mg <= 0, 0.0).otherwise(120 * F.sqrt(F.greatest(mg - F.greatest(dntp, F.lit(0.0)), F.lit(0.0))))


def is_self_complementary(s: Column) -> Column:
    return s == S.revcomp(s)


def dinucleotides(s: Column, pair: str) -> Column:
    """How often a pair of letters occurs, overlaps included."""
    if pair[0] != pair[1]:
        return F.floor((F.length(s) - F.length(F.replace(s, F.lit(pair), F.lit("")))) / 2)
    # with a mark before each such letter, pairs are letters followed by a mark, and none overlap
    marked = F.replace(s, F.lit(pair[0]), F.lit(f"\u0001{pair[0]}"))
    return F.floor((F.length(marked) - F.length(F.replace(marked, F.lit(f"{pair[0]}\u0001"), F.lit("")))) / 2)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where functions of arrays evaluate it."""
    return F.transform(F.array(value), body)[0]


def tm(s: Column, oligo_nm: float = 50.0, monovalent_mm: float = 50.0, divalent_mm: float = 1.5, dntp_mm: float = 0.6) -> Column:
    """Nearest-neighbor melting temperature in degrees Celsius; null for fewer than two bases or other letters."""
    known = lambda t: F.struct(t.alias("s"), F.array(*(dinucleotides(t, p) for p in NEAREST)).alias("counts"), is_self_complementary(t).alias("same"))
    return let(s, lambda t: let(known(t), lambda x: _tm(x["s"], x["counts"], x["same"], oligo_nm, monovalent_mm, divalent_mm, dntp_mm)))


def _tm(s: Column, counts: Column, same: Column, oligo_nm: float, monovalent_mm: float, divalent_mm: float, dntp_mm: float) -> Column:
    total = lambda k: reduce(lambda a, b: a + b, (counts[i] * F.lit(v[k]) for i, v in enumerate(NEAREST.values())))
    at_end = lambda c: c.isin("A", "T").cast("int")
    first, last = F.left(s, F.lit(1)), F.right(s, F.lit(1))
    ends_at = at_end(first) + at_end(last)
    dh = total(0) + ends_at * F.lit(2.3) + (2 - ends_at) * F.lit(0.1)
    ds = total(1) + ends_at * F.lit(4.1) + (2 - ends_at) * F.lit(-2.8) + F.when(same, -1.4).otherwise(0.0)
    na = F.lit(float(monovalent_mm)) + divalent_to_monovalent(divalent_mm, dntp_mm)
    ds = ds + F.lit(0.368) * (F.length(s) - 1) * F.log(F.greatest(na, F.lit(1e-6)) / 1000)
    ct = F.when(same, F.lit(oligo_nm / 1e9)).otherwise(F.lit(oligo_nm / 4e9))
    return F.when(s.rlike("^[ACGT]{2,}$"), dh * 1000 / (ds + GAS * F.log(ct)) - KELVIN)


def tm_range(s: Column, limit: int = 1024, **conditions) -> Column:
    """struct(lo, hi) over all unambiguous variants; null if there are too many or one has no temperature."""
    each = let(S.ungap(s), lambda t: F.transform(S.expand(t, limit), lambda v: tm(v, **conditions)))
    return let(each, lambda e: F.when(F.forall(e, lambda t: t.isNotNull()) & (F.size(e) > 0), F.struct(F.array_min(e).alias("lo"), F.array_max(e).alias("hi"))))


def format_tm(lo: Column, hi: Column) -> Column:
    one = F.concat(F.format_number(lo, 1), F.lit(" °C"))
    return F.when(lo.isNull() | hi.isNull(), "–").when(F.abs(hi - lo) < 0.05, one).otherwise(F.concat(F.format_number(lo, 1), F.lit("–"), F.format_number(hi, 1), F.lit(" °C")))


def percent(n: Column, total: Column) -> Column:
    return F.coalesce(F.lit(100.0) * n / F.nullif(total, F.lit(0)), F.lit(0.0))


def group_digits(n: Column) -> Column:
    return F.format_number(n, 0)


def nice_step(least: Column) -> Column:
    """Smallest 1, 2 or 5 times a power of ten that is at least `least`."""
    least = F.greatest(least, F.lit(1.0))
    base = F.pow(F.lit(10.0), F.floor(F.log10(least)))
    return F.when(base >= least, base).when(2 * base >= least, 2 * base).when(5 * base >= least, 5 * base).otherwise(10 * base)


def scaled(v: Column, base: str, units: list[str]) -> Column:
    """Three significant digits and the first unit that fits."""
    out, x = F.when(v < 1000, F.concat(v.cast("string"), F.lit(f" {base}"))), v.cast("double")
    for i, unit in enumerate(units):
        x = x / 1000
        text = F.when(x < 9.995, F.format_number(x, 2)).when(x < 99.95, F.format_number(x, 1)).otherwise(F.format_number(x, 0))
        text = F.concat(text, F.lit(f" {unit}"))
        out = out.when(x < 999.5, text) if i + 1 < len(units) else out.otherwise(text)
    return out


def size_label(v: Column) -> Column:
    return scaled(v, "bytes", ["KB", "MB", "GB", "TB"])


def bases_label(v: Column) -> Column:
    return scaled(v, "bp", ["kb", "Mb", "Gb", "Tb"])


def duration(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0.0))
    whole = lambda x: F.floor(x).cast("long")
    two = lambda x: F.lpad(whole(x).cast("string"), 2, "0")
    return (
        F.when(s < 10, F.concat(F.format_number(s, 1), F.lit(" s")))
        .when(s < 60, F.concat(F.format_number(s, 0), F.lit(" s")))
        .when(s < 3600, F.concat(whole(s / 60).cast("string"), F.lit(" min "), two(s % 60), F.lit(" s")))
        .otherwise(F.concat(whole(s / 3600).cast("string"), F.lit(" h "), two((s % 3600) / 60), F.lit(" min")))
    )


def parse_color(s: Column) -> Column:
    """#RRGGBB or #RGB, the # optional, as struct(r, g, b)."""
    t = F.regexp_replace(F.trim(s), "^#", "")
    full = F.when(t.rlike("^[0-9A-Fa-f]{6}$"), t).when(t.rlike("^[0-9A-Fa-f]{3}$"), F.regexp_replace(t, "(.)", "$1$1"))
    part = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("int")
    return F.when(full.isNotNull(), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def color_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def graph_height(v: Column, conservation: bool) -> Column:
    if not conservation:
        return v
    return F.greatest(F.lit(0.04), F.least(F.lit(1.0), -F.log10(F.greatest(1 - v, F.lit(1e-3))) / 3))


def conservation_class(v: Column) -> Column:
    return F.when(v >= 0.9999, 0).when(v >= 0.99, 1).when(v >= 0.95, 2).when(v >= 0.90, 3).when(v >= 0.75, 4).otherwise(5)


def identity_class(v: Column) -> Column:
    return F.when(v >= 0.9999, 0).when(v >= 0.3, 1).otherwise(2)


def problem_label(missing: Column, changed: Column) -> Column:
    """What is wrong with a set of files; null if nothing is."""
    files = lambda n: F.when(n == 1, F.lit("1 file")).otherwise(F.concat(n.cast("string"), F.lit(" files")))
    return (
        F.when((missing == 0) & (changed == 0), F.lit(None).cast("string"))
        .when(changed == 0, F.concat(files(missing), F.lit(" missing")))
        .when(missing == 0, F.concat(files(changed), F.lit(" changed")))
        .otherwise(F.concat(files(missing), F.lit(" missing, "), changed.cast("string"), F.lit(" changed")))
    )


def base_rank(b: Column) -> Column:
    """Sort rank of a cell: A, C, G, T, other letters, other, gap, no coverage (null)."""
    up = F.upper(b)
    return F.when(b.isNull(), 102).when(up == "A", 0).when(up == "C", 1).when(up == "G", 2).when(up.isin("T", "U"), 3).when(up == "-", 101).when(up.rlike("^[A-Z]$"), 4 + F.ascii(up) - 65).otherwise(100)


def sequences_label(n: Column, noun: str = "sequence") -> Column:
    return F.when(n == 1, F.lit(f"1 {noun}")).otherwise(F.concat(F.format_number(n, 0), F.lit(f" {noun}s")))


def join_and(parts: Column) -> Column:
    n = F.size(parts)
    return F.when(n == 0, "").when(n == 1, F.try_element_at(parts, F.lit(1))).otherwise(F.concat(F.array_join(F.slice(parts, 1, n - 1), ", "), F.lit(" and "), F.try_element_at(parts, F.lit(-1))))


def range_label(p0: Column, p1: Column, c0: Column, c1: Column) -> Column:
    """A range in reference positions, else in columns counted from 1."""
    return F.when(p0.isNotNull(), F.concat(F.lit("ref "), p0, F.lit("–"), p1)).otherwise(F.concat(F.lit("columns "), c0 + 1, F.lit("–"), c1))


def strand_label(strand: Column) -> Column:
    return F.when(strand > 0, "plus").when(strand < 0, "minus").otherwise("no strand")


def direction(kind: Column) -> Column:
    return F.when(kind == "Forward primer", 1).when(kind == "Reverse primer", -1).otherwise(0)


def version(text: Column) -> Column:
    """array(major, minor, patch) from the last word of the first line; the patch may be missing."""
    word = F.regexp_extract(F.substring_index(text, "\n", 1), r"(\S+)\s*$", 1)
    got = F.regexp_extract_all(F.regexp_extract(word, r"^v?(\d+\.\d+(?:\.\d+)?)$", 1), F.lit(r"(\d+)"), 1)
    three = F.when(F.size(got) == 2, F.concat(got, F.array(F.lit("0")))).when(F.size(got) == 3, got)
    return F.transform(three, lambda x: x.cast("int"))
