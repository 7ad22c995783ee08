"""Words of more pieces than 16 bits count, alone and among others."""

import pytest
from pyspark.sql import functions as F

from colonnade.llm import lm


@pytest.mark.parametrize("held_out", [False, True])
def test_words_of_many_pieces(spark, held_out):
    long_ = "".join(chr(0x4E00 + i * 7 % 9000) for i in range(70_000))
    texts = {0: "one two three one", 1: f"one {long_} two", 2: long_, 3: "three two one", 7: f"zero {long_} {long_}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    learnt = [t for d, t in texts.items() if d != 7 or not held_out]
    got = {r["doc_id"]: r for r in lm.score_texts(docs, F.lit(held_out) & (F.col("doc_id") == 7)).collect()}
    words = [w for t in learnt for w in t.split()]
    assert len(got) == 5 and got[0]["train_tokens"] == len(words) + len(learnt)
    for d, t in texts.items():
        assert got[d]["n_tokens"] == len(t.split()) + 1
        assert got[d]["n_known"] == 1 + sum(w in words for w in t.split())
        assert got[d]["score"] < 0


def test_pieces_of_other_words_stay_theirs(spark):
    """A word after a long one keeps its own pieces in the table of counts."""
    long_ = "".join(chr(0x4E00 + i * 7 % 9000) for i in range(70_000))
    docs = spark.createDataFrame([(f"alpha {long_} beta gamma",), ("beta delta",)], "text string").coalesce(1)
    kept = lm.counted(lm.gathered(docs, lm.VOCABULARY, "text", 1), 1)
    rows = {bytes(r["ids"]): r["n"] for r in kept.collect()}
    pieces = lm.processor(lm.VOCABULARY)
    for word, n in (("alpha", 1), (long_, 1), ("beta", 2), ("gamma", 1), ("delta", 1)):
        ids, _ = lm.cut(pieces, [word.encode()])
        assert rows[ids.astype("uint16").tobytes()] == n
