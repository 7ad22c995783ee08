"""Mapping sequences to many or very long references, none of which has to fit in a task.

The references' words are an index table over the executors. A query's words that the index has are its seeds; they are gathered
by query, strand and reference and chained. References whose best chain reaches half of the query's best one are candidates: of
a candidate only the window that the query can reach is fetched, in pieces of PIECE letters, and aligned as if the reference
were the only one. The best alignment counts; of equal ones the forward strand's, then that of the least reference.

With one reference that is map_round(), but for queries without any common word: those are not aligned as a whole here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequence as S
from ..sources.shared import materialized, spread
from . import mapper as M
from . import words as D

PIECE = 1 << 14
_SEGMENTS = "array<struct<q:int,t:int,n:int>>"


def reach(n):  # noqa: ANN001, ANN201
    """Letters of a reference that n letters of a query beyond a chain can come to, and one that tells whether it goes on."""
    return n + F.floor(n / 3).cast("int") + 25


def chains(seeds: DataFrame, k: int) -> DataFrame:
    """(id, target, score, segments) of the seeds (id, qpos, target, tpos) of each query and reference."""
    packed = seeds.groupBy("id", "target").agg(F.collect_list(F.shiftleft(F.col("qpos").cast("long"), 32).bitwiseOR(F.col("tpos").cast("long"))).alias("pairs"))
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, segments = [], []
            for pairs in batch.column(2):
                both = np.sort(pairs.values.to_numpy())
                score, path = M.chain(np.stack([both >> 32, both & 0xFFFFFFFF], 1), k)
                scores.append(score)
                segments.append([{"q": q, "t": t, "n": n} for q, t, n in path])
            kind = pa.list_(pa.struct([("q", pa.int32()), ("t", pa.int32()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.int32()), pa.array(segments, kind)], names=["id", "target", "score", "segments"])

    return packed.select("id", "target", "pairs").mapInArrow(run, f"id {kinds['id']}, target {kinds['target']}, score int, segments {_SEGMENTS}")


def pieces(targets: DataFrame) -> DataFrame:
    """(target, piece, text) of references (id, seq)."""
    number = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / PIECE).cast("int"))
    each = targets.where(F.length("seq") > 0).select(F.col("id").alias("target"), "seq", F.explode(number).alias("piece"))
    return each.select("target", "piece", F.substring("seq", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("text"))


def map_to_many(queries: DataFrame, targets: DataFrame, p: M.Params) -> DataFrame:
    """Best alignment of each query (id, seq) to references (id, seq), ids being whole numbers: id, target and the columns of map_round().

    Those too different or too short are left out.
    """
    k = min(max(p.word, 6), 31)
    index = D.WordTable(targets, k, most=p.repeats)
    # as a table dealt evenly: lookups, chains and alignments all read it
    queries = materialized(spread(queries.where(F.length("seq") > 0).select("id", "seq"), "id", share=M.QUERIES), "queries")
    strands = queries.select(F.struct("id", F.lit(False).alias("reverse")).alias("id"), "seq")
    if p.both_strands:
        strands = strands.union(queries.select(F.struct("id", F.lit(True).alias("reverse")), S.revcomp(F.col("seq"))))
    found = chains(index.common(strands), k).where("score > 0")
    best = F.max("score").over(Window.partitionBy("id.id"))
    found = found.withColumn("best", best).where(2 * F.col("score") >= F.col("best")).select("id", "target", "segments")
    # as a table: what is known of candidates is small, and three joins read it
    found = materialized(found, "candidates")
    whole = targets.select(F.col("id").alias("target"), F.length("seq").alias("size"))
    first, last = F.element_at("segments", 1), F.element_at("segments", -1)
    asked = found.join(strands, "id").join(whole, "target")
    low = F.greatest(F.lit(0), first["t"] - reach(first["q"]))
    high = F.least(F.col("size"), last["t"] + last["n"] + reach(F.length("seq") - last["q"] - last["n"]))
    asked = asked.withColumns({"p0": F.floor(low / PIECE).cast("int"), "p1": F.floor((high - 1) / PIECE).cast("int")})
    fetched = asked.select("id", "target", F.explode(F.sequence("p0", "p1")).alias("piece")).join(pieces(targets), ["target", "piece"])
    window = fetched.groupBy("id", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "").alias("window"))
    ready = asked.select("id", "target", "seq", "segments", (F.col("p0") * PIECE).alias("offset")).join(window, ["id", "target"])
    kinds = {f.name: f.dataType.simpleString() for f in ready.select("id.id", "target").schema}
    fields = M._ALN.split(", ", 2)[2]
    schema = T._parse_datatype_string(f"id {kinds['id']}, target {kinds['target']}, {fields}, score int, good boolean")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, target, seq, segments, offset, window in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = [(s["q"], s["t"] - offset, s["n"]) for s in segments]
                a = M.align_chain(seq.encode(), window.encode(), path, k, id_["reverse"], p.trim_to_reference)
                if a:
                    out.append((id_["id"], target, a.t_start + offset, a.aligned.decode(), [{"pos": x + offset, "bases": b.decode()} for x, b in a.ins], a.reverse, a.matches, a.mismatches, a.gaps, *a.clipped, a.identity, a.score, a.placed >= min(p.min_aligned, len(seq)) and np.float32(a.identity) * np.float32(100) >= np.float32(p.min_identity)))
            types = [batch.column(0).type.field("id").type, batch.column(1).type, pa.int32(), pa.string(), pa.list_(pa.struct([("pos", pa.int32()), ("bases", pa.string())])), pa.bool_(), *[pa.int32()] * 5, pa.float64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    aligned = ready.select("id", "target", "seq", "segments", "offset", "window").mapInArrow(run, schema)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "reverse", "target"))
    return aligned.withColumn("place", place).where("place = 1 and good").drop("place", "good", "score")

