"""The networks of op2 work on many blocks in each call, and what makes that cheap changes no result."""

import sys

import numpy as np
import pyarrow as pa

from colonnade.llm import lm


def calls(work) -> int:
    n = 0

    def count(_, event, __):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        work()
    finally:
        sys.setprofile(None)
    return n


def some_blocks(net, segments=1500):
    rng = np.random.default_rng(0)
    n = np.full(segments, 64)
    return net.blocks(n, *(rng.integers(0, k, int(n.sum())) for k in (net.inputs, net.inputs, net.classes)))


def test_a_block_takes_less_than_one_call():
    net, flat = lm.WORDS, lm.WORDS.initial(np.ones(lm.CLASSES) / lm.CLASSES)
    data = some_blocks(net)
    assert calls(lambda: net.log10(flat, data)) < len(data[0])
    assert calls(lambda: net.train(flat, data, 0.01, 1, batch=lm.BATCH)) < len(data[0])


def test_a_step_of_training_sees_each_block_once(monkeypatch):
    net, seen = lm.WORDS, []
    data = some_blocks(net, 100)
    monkeypatch.setattr(type(net), "gradient", lambda self, flat, data, at: (seen.extend(at) or 0.0, np.zeros_like(flat)))
    net.train(net.initial(np.ones(lm.CLASSES)), data, 0.01, 1, batch=lm.BATCH)
    assert sorted(seen) == list(range(len(data[0])))


def test_large_weights_give_a_distribution():
    net = lm.WORDS
    flat = net.initial(np.ones(lm.CLASSES)) * np.float32(40)
    one = np.arange(40) % net.inputs
    p = [10.0 ** net.log10(flat, net.blocks(np.array([40]), one, one, np.where(np.arange(40) == 30, c, 0)))[30] for c in range(lm.CLASSES)]
    assert abs(sum(p) - 1) < 1e-3
    loss, g = net.gradient(flat, net.blocks(np.array([40]), one, one, one), np.arange(3))
    assert np.isfinite(loss) and np.isfinite(g).all()


def test_words_and_pieces_of_texts():
    texts = ["b a B c", None, "", "a d a", " ".join(f"w{i % 900}" for i in range(3000)), "c Zebra Ä ä"]
    pieces = lm.Pieces(lm.VOCABULARY, most=600)
    for some in (texts[:2], texts[2:], texts, texts[::-1]):
        t = lm.Texts(pa.array(some, pa.string()))
        ids, sizes = t.cut(np.arange(len(t.hash)), pieces)
        own = np.split(ids, np.cumsum(sizes)[:-1])
        words = [w.encode().lower().decode() for x in some for w in (x or "").split()]
        assert len(t.words) == len(words) and len(t.hash) == len(set(words)) and (t.hash[1:] > t.hash[:-1]).all()
        for w, i in zip(words, t.words, strict=True):
            assert own[i].tolist() == lm.cut(pieces.own, [w.encode()])[0].tolist()
