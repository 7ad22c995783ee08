"""What documents, runs and typed values are called and why something is refused, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numeric as N
from . import sequence as S

# Fields of a primer search with their names, lower and upper bounds (numbers) or least values (whole numbers).
NUMBERS = {
    "tm": ("The minimum Tm", 0, 100), "target": ("The coverage target", 0, 100), "oligo_nm": ("The oligo concentration", 0.001, 1e9),
    "na_mm": ("Na⁺", 0, 1e6), "mg_mm": ("Mg²⁺", 0, 1e6), "dntp_mm": ("dNTP", 0, 1e6),
}
WHOLE = {
    "three_prime": ("Conserved 3' bases", 0), "max_amb": ("Ambiguity codes per primer", 0), "max_seeds": ("Seeds per range", 0),
    "n_oligos": ("Oligos in the set", 1), "mismatches": ("Mismatches", 0), "ambiguities": ("Ambiguity codes per oligo", 0),
    "max_candidates": ("Max. candidates", 0), "max_work": ("Max. work", 0), "threads": ("Threads", 0),
}
ASKED = ["tm", "three_prime", "target", "max_amb", "max_seeds", "n_oligos", "mismatches", "ambiguities", "max_candidates", "max_work", "threads", "oligo_nm", "na_mm", "mg_mm", "dntp_mm"]


# ---- documents -------------------------------------------------------------------------------------------------------
def has_rows(kind: Column) -> Column:
    """Whether a kind of document stores sequences."""
    return ~kind.isin("Text", "Linked")


def unit(fastq: Column) -> Column:
    """What a record of a file is called."""
    return F.when(fastq, "reads").otherwise("sequences")


def rows_name(document: Column, n: Column, only: Column) -> Column:
    """Name of a new document of n rows; `only` is the name of a single one."""
    return F.concat(document, F.lit(" ["), F.when(n == 1, only).otherwise(N.sequences_label(n)), F.lit("]"))


def bases_place(columns: Column, position: Column, label: Column) -> Column:
    """Where bases are compared: columns (an array), the reference position of a single one or null, the label of a range."""
    n = F.size(columns)
    one = F.when(position.isNotNull(), F.concat(F.lit("base at ref "), N.group_digits(position))).otherwise(F.concat(F.lit("base at column "), N.group_digits(F.get(columns, F.lit(0)) + 1)))
    return F.when(n == 0, "bases").when(n == 1, one).otherwise(F.concat(F.lit("bases at "), label))


def sort_phrase(key: Column, descending: Column, place: Column) -> Column:
    """How rows are sorted: key is Name, Length or Bases, place that of bases_place()."""
    way = lambda down, up: F.when(descending, down).otherwise(up)
    return (
        F.when(key == "Name", F.concat(F.lit("by name ("), way("Z→A", "A→Z"), F.lit(")")))
        .when(key == "Length", F.concat(F.lit("by length ("), way("longest first", "shortest first"), F.lit(")")))
        .otherwise(F.concat(F.lit("by "), place, way(" (reversed)", "")))
    )


def common_color(color: Column) -> Column:
    """struct(color, mixed) of a group: the color all have; none if they differ, no color being one of its own."""
    shared = F.count_distinct(F.coalesce(color, F.lit(""))) == 1
    return F.struct(F.when(shared, F.max(color)).alias("color"), (~shared & (F.count(F.lit(1)) > 0)).alias("mixed"))


def refuse_read_only(kind: Column, what: str) -> Column:
    """Why a document cannot be changed; null if it can."""
    return F.when(kind == "Linked", F.lit(f"Linked files are read-only: {what} cannot be saved. Import the file into the library to change it."))


def refuse_partial(complete: Column, shown: Column, records: Column, called: Column) -> Column:
    """Why an action on all sequences cannot run on linked files of which only the first are shown; null if it can."""
    said = F.concat(F.lit("The viewer shows only the first "), N.group_digits(shown), F.lit(" of "), N.group_digits(records), F.lit(" "), called, F.lit(" of these linked files; this needs all of them."))
    return F.when(~complete, said)


def can_map(kind: Column, n_rows: Column, whole: Column) -> Column:
    """Whether a document can be mapped before it is opened; whole: linked files are shown in full."""
    return F.when(kind == "Text", False).when(kind == "Linked", F.coalesce(whole, F.lit(False))).otherwise(n_rows > 0)


# ---- runs of tools ---------------------------------------------------------------------------------------------------
def command_line(tool: str, args: Column) -> Column:
    """A command as text: arguments with a space are quoted."""
    quoted = F.transform(args, lambda a: F.when(F.contains(a, F.lit(" ")), F.concat(F.lit('"'), a, F.lit('"'))).otherwise(a))
    return F.array_join(F.concat(F.array(F.lit(tool)), quoted), " ")


def status_line(line: Column) -> Column:
    """Status in a line without its dots; null for blank lines and errors."""
    said = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when((said != "") & ~said.startswith("error:"), F.regexp_replace(said, r"( ?\.\.\.)+$", ""))


def error_message(status: Column, body: Column) -> Column:
    """What an answer with an error status says."""
    gist = S.gist(body)
    plain = F.concat(F.lit("NCBI answered with HTTP status "), status)
    return F.when(status == 429, "NCBI received too many requests; wait a moment and try again.").when(F.coalesce(gist, F.lit("")) == "", F.concat(plain, F.lit("."))).otherwise(F.concat(plain, F.lit(": "), gist))


def tool_status(answer: Column, least: tuple[int, int, int]) -> Column:
    """struct(version, problem) by the answer to --version: one of them is null."""
    v = N.version(answer)
    dotted = F.array_join(F.transform(v, lambda x: x.cast("string")), ".")
    old = F.concat(F.lit("version "), dotted, F.lit(f" is too old; {'.'.join(map(str, least))} or newer is needed"))
    fits = v >= F.array(*(F.lit(x) for x in least))
    problem = F.when(v.isNull(), F.concat(F.lit("unexpected answer to --version: "), F.regexp_replace(answer, r"^\s+|\s+$", ""))).when(~fits, old)
    return F.struct(F.when(fits, dotted).alias("version"), problem.alias("problem"))


PROGRESS = "type string, phase string, covered long, total long, pct double, candidates long, evaluations long, max_work long, generated long, message string"


def progress(event: Column) -> Column:
    """struct(fraction, text) of a progress event in JSON; null for other events.

    Rounds count covered sequences, a search of sets gives no fraction, all else goes by its percentage.
    """
    e = F.from_json(event, PROGRESS)
    rounds = e["phase"].isin("round", "fixed") & (e["covered"] >= 0) & (e["total"] > 0)
    done = F.when(rounds, e["covered"] / e["total"]).otherwise(F.coalesce(e["pct"], F.lit(0.0)) / 100)
    fraction = F.when(~F.coalesce(e["phase"] == "set_search", F.lit(False)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), done)))
    raw = F.coalesce(e["message"], F.lit(""))
    lead = "Optimize by mismatch: "
    tail = F.substr(raw, F.lit(len(lead) + 1))
    plain = F.when(raw.startswith(lead), F.concat(F.upper(F.left(tail, F.lit(1))), F.substr(tail, F.lit(2)))).otherwise(raw)
    plain = F.concat(plain, F.when((e["phase"] == "reduce") & e["generated"].isNotNull(), F.concat(F.lit(" · "), N.group_digits(e["generated"]), F.lit(" candidates generated"))).otherwise(""))
    used = F.when(e["max_work"] > 0, F.concat(F.lit(" ("), F.format_number(100 * e["evaluations"] / e["max_work"], 1), F.lit("% of max work)"))).otherwise("")
    sets = F.concat(F.lit("Searching sets over "), N.group_digits(e["candidates"]), F.lit(" candidates · "), N.group_digits(e["evaluations"]), F.lit(" evaluations"), used)
    searching = (e["phase"] == "set_search") & e["candidates"].isNotNull() & e["evaluations"].isNotNull()
    return F.when(e["type"] == "progress", F.struct(fraction.alias("fraction"), F.when(searching, sets).otherwise(plain).alias("text")))


# ---- typed values ----------------------------------------------------------------------------------------------------
def number_field(text: Column, what: str, lo: float, hi: float) -> Column:
    """struct(value, problem) of a typed number, with a point or a comma."""
    said = F.translate(text, ",", ".")
    value = F.when(said.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), said.cast("double"))
    good = F.coalesce(value.between(lo, hi), F.lit(False))
    return F.struct(F.when(good, value).alias("value"), F.when(~good, F.lit(f"{what} must be a number from {lo:.12g} to {hi:.12g}.")).alias("problem"))


def whole_field(text: Column, what: str, least: int) -> Column:
    """struct(value, problem) of a typed whole number; commas, spaces and underscores group digits."""
    said = F.translate(text, ",_ ", "")
    value = F.when(said.rlike(r"^\+?[0-9]{1,20}$"), said.try_cast("long"))
    good = F.coalesce(value >= least, F.lit(False))
    rule = f"{what} must be a whole number" + (f" of at least {least}." if least else ".")
    return F.struct(F.when(good, value).alias("value"), F.when(~good, F.lit(rule)).alias("problem"))


def search_fields(typed: dict[str, Column]) -> dict[str, Column]:
    """Values of the fields of a primer search and `problem`, the first one in the order they are asked; nM become µM."""
    got = {k: number_field(typed[k], *NUMBERS[k]) if k in NUMBERS else whole_field(typed[k], *WHOLE[k]) for k in ASKED}
    out = {k: v["value"] for k, v in got.items() if k != "oligo_nm"}
    return out | {"oligo_um": got["oligo_nm"]["value"] / 1000, "problem": F.coalesce(*(v["problem"] for v in got.values()))}
