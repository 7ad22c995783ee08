"""Both models of op2 train on all that the training documents hold."""

import numpy as np
from pyspark.sql import functions as F

from colonnade.llm import lm


def test_all_segments_and_words_train(spark, monkeypatch):
    texts = [" ".join(f"w{(i * 7 + j) % 90}" for j in range(n)) for i, n in enumerate([0, 1, 63, 64, 65, 200, 640, 700])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    monkeypatch.setattr(lm, "averaged", lambda net, flat, rows, *_: seen.append((rows.count(), rows)) or flat)
    monkeypatch.setattr(lm, "discard", lambda df: None)
    lm.score_texts(docs, F.col("doc_id") < 0, warm=4)
    words = {w for t in texts for w in t.split()}
    assert [n for n, _ in seen] == [sum(len(t.split()) // 64 + 1 for t in texts), len(words)]
    data = np.frombuffer(b"".join(bytes(r["data"]) for r in seen[0][1].collect()), lm.CODED)
    assert len(data) == sum(len(t.split()) + 1 for t in texts) and (data["cls"] == 0).sum() == len(texts)
