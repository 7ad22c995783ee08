"""Mixing sources to target weights by Pareto order sampling.

Every source gets a share of all words by its weight, at most a given multiple of its own words; what is cut off goes to
the others by weight. A document is first allotted the whole copies that its source's ratio target / size makes certain.
For the rest each document has inclusion odds, and documents are ranked by random odds divided by inclusion odds
(Pareto order sampling). Ranked documents are taken until their words come nearest to what is left of the target: a
fixed-size sample, size being counted in words, with unequal probabilities.

The cut is found without sorting a source: two histograms of the rank, each over all rows of every source, narrow it to
one of 2^20 slices, and only the rows of that slice are ordered.

Defined results: null text has size 0 and is taken with 0 words; a null source is a source of its own, last in order; a
source without words has target 0; equal rows are interchangeable; random numbers are a hash of id, source and text, so
reruns agree; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

SLICES = 1024


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> list[tuple[str | None, int, float]]:
    """(source, size, target): sources in code point order, null last; weights repeat; the excess over most * size is reshared."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    left, target, open_ = float(sum(n for _, n in order)), [0.0] * len(order), set(range(len(order)))
    while open_ and left > 0:
        total = sum(weight[i] for i in open_)
        over = [i for i in sorted(open_) if left * weight[i] / total > most * order[i][1]]
        if not over:
            for i in open_:
                target[i] = left * weight[i] / total
            break
        for i in over:
            target[i] = most * order[i][1]
            left -= target[i]
            open_.discard(i)
    return [(s, n, t) for (s, n), t in zip(order, target, strict=True)]


def _uniform(*cols: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, tilt: float = 0.25, seed: int = 20, keep: list[str] | None = None, max_sources: int = 100_000) -> DataFrame:
    """Columns in keep (all of docs by default), size, source_size, target, copies and taken.

    tilt: inclusion probabilities grow as size ** tilt within a source. The table of sources is collected to compute the
    targets; more than max_sources sources is an error rather than an unbounded collection.
    """
    kept = docs.columns if keep is None else keep
    base = docs.select(
        F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept))).alias("kept"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _uniform(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text")).alias("u"),
    )
    base = materialize(base, "mix")
    power = F.pow(F.col("size").cast("double"), F.lit(1 + tilt))
    rows = base.groupBy("source").agg(F.sum("size").alias("size"), F.sum(power).alias("power")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    spark = docs.sparkSession
    power_of = {r["source"]: r["power"] for r in rows}
    plan = []
    for source, size, target in targets([(r["source"], r["size"]) for r in rows], weights, most):
        ratio = target / size if size else 0.0
        whole = min(int(ratio + 1e-12), int(most))
        rest = max(0.0, target - whole * size)
        plan.append((source, size, target, whole, rest, rest / power_of[source] if size else 0.0))
    sources = F.broadcast(spark.createDataFrame(plan, "of string, source_size long, target double, whole int, rest double, scale double"))
    chance = F.least(F.greatest(F.col("scale") * F.pow(F.col("size").cast("double"), F.lit(tilt)), F.lit(1e-12)), F.lit(1 - 1e-9))
    odds = (F.col("u") / (1 - F.col("u"))) / (chance / (1 - chance))
    # odds / (1 + odds) keeps the order and lies in 0..1, which makes slices simple
    ranked = base.join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("rank", F.least(odds / (1 + odds), F.lit(1 - 1e-12)))

    def cut(part: DataFrame, slice_: Column, above: Column) -> DataFrame:
        """For each source the slice in which the words taken reach the rest, and the words before it."""
        sums = part.groupBy("of", slice_.alias("slice")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first(above).alias("above"))
        upto = F.sum("words").over(Window.partitionBy("of").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = sums.withColumn("before", F.col("above") + upto - F.col("words")).where(F.col("before") + F.col("words") >= F.col("rest") - 1e-9)
        return sums.groupBy("of").agg(F.min_by(F.struct("slice", "before"), "slice").alias("at")).select(F.col("of").alias("cut_of"), F.col("at.slice").alias("slice"), F.col("at.before").alias("before"))

    wanted = ranked.where("rest > 0")
    first = F.floor(F.col("rank") * SLICES)
    one = cut(wanted, first, F.lit(0)).collect()  # one row a source
    ones = F.broadcast(spark.createDataFrame([(r["cut_of"], r["slice"], r["before"]) for r in one], "one_of string, slice1 long, before1 long"))
    inside = wanted.join(ones, F.col("of").eqNullSafe(F.col("one_of"))).where(first == F.col("slice1"))
    second = F.floor((F.col("rank") * SLICES - F.col("slice1")) * SLICES)
    two = cut(inside, second, F.col("before1")).collect()
    steps = {r["cut_of"]: (r["slice"], r["before"]) for r in two}
    both = [(r["cut_of"], r["slice"], *steps.get(r["cut_of"], (SLICES, r["before"]))) for r in one]
    cuts = F.broadcast(spark.createDataFrame(both, "cut_of string, slice1 long, slice2 long, before long"))
    placed = ranked.join(cuts, F.col("of").eqNullSafe(F.col("cut_of")), "left")
    second = F.floor((F.col("rank") * SLICES - F.col("slice1")) * SLICES)
    side = F.when(F.col("slice1").isNull(), F.when(F.col("rest") > 0, -1).otherwise(1)).when(first != F.col("slice1"), F.signum(first - F.col("slice1"))).otherwise(F.signum(second - F.col("slice2"))).cast("int")
    placed = placed.withColumn("side", side)
    columns = ["kept", "size", "source_size", "target", "whole"]
    clear = placed.where("side != 0").select(*columns, (F.col("side") < 0).cast("int").alias("extra"))
    # only the rows of one slice of 2^20 of each source are ordered
    w = Window.partitionBy("of").orderBy("rank", "size", F.to_json("kept")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = placed.where("side = 0").withColumn("upto", F.col("before") + F.sum("size").over(w))
    fits = (F.col("upto") <= F.col("rest")) | (F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("size")))
    edge = near.select(*columns, fits.cast("int").alias("extra"))
    out = clear.unionByName(edge).withColumn("copies", F.col("whole") + F.when(F.col("whole") < most, F.col("extra")).otherwise(0))
    return out.select(*(F.col(f"kept.c{i}").alias(c) for i, c in enumerate(kept)), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
