"""Nucleotide and name functions as Column expressions: everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC letters in the order of their bit masks 1..15 (A=1, C=2, G=4, T=8).
MASK_ORDER = "ACMGRSVTWYHKDBN"
LETTERS = "ABCDGHKMNRSTVWY"
COMPLEMENT = ("ACGTRYKMBVDH", "TGCAYRMKVBHD")
GAP = "-"


def normalize(s: Column) -> Column:
    """Upper-case IUPAC text: U is T; . and ~ are gaps; ? and X are N; blanks, digits and * go; all else is N."""
    up = F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    kept = F.translate(F.regexp_replace(up, r"[ \t\n\f\r0-9*]", ""), "U.~?X", "T--NN")
    return F.regexp_replace(kept, "[^ACGTRYSWKMBDHVN-]", "N")


def unknown_count(s: Column) -> Column:
    """Characters that normalize() turns into N and that are not N."""
    up = F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.length(F.regexp_replace(up, r"[ \t\n\f\r0-9*U.~?XACGTRYSWKMBDHVN-]", ""))


def mask(b: Column) -> Column:
    """Bit set of one letter; 0 for gaps, blanks and unknown letters."""
    return F.coalesce(F.when(F.length(b) == 1, F.position(b, F.lit(MASK_ORDER))), F.lit(0))


def code(bits: Column) -> Column:
    """Letter of a bit set; 0 is the gap."""
    return F.substring(F.lit(GAP + MASK_ORDER), bits + 1, F.lit(1))


def is_acgt(b: Column) -> Column:
    return b.isin("A", "C", "G", "T")


def stat_index(b: Column) -> Column:
    """0..5 for A, C, G, T, gap, other."""
    return F.when(b == "A", 0).when(b == "C", 1).when(b == "G", 2).when(b == "T", 3).when(b == GAP, 4).otherwise(5)


def compatible(a: Column, b: Column) -> Column:
    return mask(a).bitwiseAND(mask(b)) != 0


def complement(s: Column) -> Column:
    return F.translate(s, *COMPLEMENT)


def revcomp(s: Column) -> Column:
    return F.reverse(complement(s))


def ungap(s: Column) -> Column:
    return F.replace(s, F.lit(GAP), F.lit(""))


def _bits(letter: str) -> int:
    return MASK_ORDER.index(letter) + 1


def occurrences(s: Column, letter: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def gc_percent(s: Column) -> Column:
    """Mean share of G and C over the letters, an ambiguous letter counting by its bases; 0 without letters."""
    total = reduce(lambda a, b: a + b, (occurrences(s, x) for x in MASK_ORDER))
    share = {x: (_bits(x) & 6).bit_count() / _bits(x).bit_count() for x in MASK_ORDER}
    gc = reduce(lambda a, b: a + b, (occurrences(s, x) * F.lit(share[x]) for x in MASK_ORDER if share[x]))
    return F.when(total > 0, F.lit(100.0) * gc / total).otherwise(0.0)


def variant_count(s: Column) -> Column:
    """How many unambiguous sequences a sequence stands for (as a double, so that it cannot overflow)."""
    return reduce(lambda a, b: a * b, (F.pow(F.lit(float(_bits(x).bit_count())), occurrences(s, x)) for x in MASK_ORDER if _bits(x).bit_count() > 1))


def expand(s: Column, limit: int = 1024) -> Column:
    """All unambiguous sequences in A, C, G, T order; gaps are skipped; null beyond limit."""
    bases = F.create_map(*(F.lit(x) if i == 0 else F.array(*(F.lit(b) for k, b in enumerate("ACGT") if _bits(x) >> k & 1)) for x in MASK_ORDER for i in (0, 1)))
    pieces = F.regexp_extract_all(ungap(s), F.lit("[ACGT]+|[^ACGT]"), 0)
    out = F.aggregate(pieces, F.array(F.lit("")), lambda acc, c: F.flatten(F.transform(acc, lambda p: F.transform(F.coalesce(F.try_element_at(bases, c), F.array(c)), lambda b: F.concat(p, b)))))
    return F.when(variant_count(s) <= limit, out)


def mate_name(s: Column) -> Column:
    return F.regexp_replace(s, "/[12]$", "")


def is_uuid(s: Column) -> Column:
    return s.rlike("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def stem(path: Column) -> Column:
    """File name without .gz and without the last extension, unless nothing is left."""
    name = F.regexp_replace(file_name(path), r"\.(gz|GZ)$", "")
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$|(?<=.)\.[^.]*$", "")


def name_fields(name: Column, delimiter: str) -> Column:
    return F.split(name, "\\Q" + delimiter + "\\E")


def read_id(head: Column) -> Column:
    """A read's header up to the first white space."""
    return F.regexp_extract(head, r"^[^ \t\n\f\r]*", 0)


def read_desc(head: Column) -> Column:
    return F.trim(F.regexp_replace(head, r"^[^ \t\n\f\r]*", ""))


def valid_email(s: Column) -> Column:
    return F.trim(s).rlike(r"^[^@\s]+@[^@\s.][^@\s]*\.[^@\s]*[^@\s.]$")


def valid_accession(s: Column) -> Column:
    return F.trim(s).rlike(r"^[A-Za-z0-9_.]{1,40}$") & s.rlike("[0-9]")


def accession_in(name: Column) -> Column:
    """The first |-part of the first word that is an accession starting with a letter."""
    word = F.regexp_extract(name, r"\S+", 0)
    parts = F.filter(F.split(word, "\\|"), lambda p: valid_accession(p) & p.rlike("^[A-Za-z]"))
    return F.try_element_at(parts, F.lit(1))


def gist(s: Column, most: int = 200) -> Column:
    """Text without tags on one line, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]*>", " "), r"[ \t\n\f\r\x0b]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def truncate(s: Column, most: int) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def shorten(s: Column, most: int) -> Column:
    """First line, trimmed and cut."""
    return truncate(F.trim(F.substring_index(F.regexp_replace(s, "\r", ""), "\n", 1)), most)


def ellipsize_middle(s: Column, most: int) -> Column:
    half = (most - 1) // 2
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, half), F.lit("…"), F.right(s, F.lit(half)))).otherwise(s)


def sanitize(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{L}\p{N} \-_.()]", "_")


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, "^[^/]*://", ""), "^[^/?:]*", 0)


def proxy_url(s: Column) -> Column:
    t = F.trim(s)
    return F.when(F.contains(t, F.lit("://")), t).otherwise(F.concat(F.lit("http://"), t))


def is_fastq(path: Column) -> Column:
    return path.rlike(r"(?i)\.(fastq|fq)(\.gz)?$")
