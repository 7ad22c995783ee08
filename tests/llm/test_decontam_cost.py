"""Many items with common parts and documents that repeat them: the same hits as one by one, in bounded time and memory."""

import random
import time

import numpy as np
import pytest

from colonnade.llm import decontam


def made(rng, n):
    return "".join(rng.choice("abcdefghij ") for _ in range(n))


def changed(rng, s, times):
    s = list(s)
    for _ in range(times):
        a, r = rng.randrange(len(s) or 1), rng.random()
        s[a : a + (r < 0.6)] = [] if r < 0.3 else [rng.choice("xyz")]
    return "".join(s)


def test_many_equal_one():
    rng = random.Random(4)
    for _ in range(120):
        k = rng.randrange(1, 12)
        width = 2 * (2 * k + 1)
        doc = decontam.normalise(made(rng, rng.randrange(20, 400)))
        items, lows = [], []
        for _ in range(rng.randrange(1, 9)):
            a = rng.randrange(len(doc))
            text = "".join(map(chr, doc[a : a + rng.randrange(5, 120)]))
            items.append(decontam.normalise(changed(rng, text, rng.randrange(k + 3)) or "a"))
            lows.append(a - rng.randrange(-2, width))
        items, lows = zip(*[(x, y) for x, y in zip(items, lows, strict=True) if len(x)], strict=True)
        want = [decontam.align(x, doc, low, low + width - 1, k) for x, low in zip(items, lows, strict=True)]
        got = [decontam.exact(x, doc, low, low + width - 1) or y for x, low, y in zip(items, lows, decontam.align_many(list(items), doc, list(lows), width, k), strict=True)]
        assert got == want


@pytest.mark.parametrize("small", [False, True])
def test_find_equals_one_by_one(monkeypatch, small):
    if small:
        monkeypatch.setattr(decontam, "EXPANDED", 50)
        monkeypatch.setattr(decontam, "TOGETHER", 3)
        monkeypatch.setattr(decontam, "KEPT", 2)
    rng = random.Random(7)
    start = made(rng, 90)
    items = [(i, start + made(rng, rng.randrange(10, 60))) for i in range(12)] + [(100 + i, made(rng, rng.randrange(20, 90))) for i in range(6)]
    index = decontam.Index(items)
    for _ in range(5):
        parts = [made(rng, rng.randrange(50))]
        for _ in range(rng.randrange(1, 5)):
            i = rng.randrange(len(items))
            parts += [changed(rng, items[i][1], rng.randrange(12)), rng.choice(["", start, start * 3, made(rng, 30)])]
        doc = " ".join(parts)
        a = decontam.normalise(doc)
        want = []
        for i, text in items:
            item = decontam.normalise(text)
            k = int(len(item) * 0.1)
            hits = [decontam.align(item, a, low, low + 4 * k + 1, k) for low in range(-2 * (2 * k + 1), len(a), 2 * k + 1)]
            want += [(i, min(h for h in hits if h)[0])] if any(hits) else []
        assert sorted((x[0], x[1]) for x in index.find(doc)) == sorted(want)


def test_a_common_beginning_takes_no_time():
    rng = random.Random(1)
    start = made(rng, 300)
    index = decontam.Index([(i, start + made(rng, 60)) for i in range(3000)])
    for doc, most in ((start + made(rng, 30), 4), ((start + " ") * 5, 40)):
        began = time.process_time()
        assert index.find(doc) == []
        assert time.process_time() - began < most


def test_long_text_and_ties():
    rng = random.Random(2)
    index = decontam.Index([("a", "one passage of some length that is asked for"), ("b", "one passage of some length that is asked for"), ("c", ""), ("d", None)])
    text = made(rng, 400_000) + " one passage of some length that is asked for " + made(rng, 400_000) + " one passage of some length that is asked for"
    got = index.find(text)
    assert [(x[0], x[1]) for x in got] == [("a", 0), ("b", 0)] and got[0][2:] == got[1][2:] and got[0][2] < 500_000
    assert np.array_equal(decontam.normalise(text)[got[0][2] : got[0][3]], decontam.normalise("one passage of some length that is asked for"))
