"""A small network with one head of causal self-attention, trained and applied in NumPy."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np


def summed(x: np.ndarray) -> np.ndarray:
    """Sums over a short last axis, which a product with ones gives faster."""
    return x @ np.ones(x.shape[-1], x.dtype)


@dataclass(frozen=True)
class Net:
    """Predicts one of `classes` from up to 2 * block inputs before it; an input is the sum of two rows of a table.

    Sequences are cut into blocks. Each block is predicted once, with the block before it as context: windows of two blocks
    that overlap by one. A class is predicted in two steps, first the run of about 2 * sqrt(classes) classes that it is in.
    """

    inputs: int
    classes: int
    block: int
    width: int = 16

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        w, b = self.width, self.block
        return {"e": (self.inputs, w), "q": (w, w), "k": (w, w), "v": (w, w), "b": (b, 2 * b), "o": (w, self.classes), "c": (self.classes,), "r": (w, self.runs), "d": (self.runs,)}

    @cached_property
    def run(self) -> int:
        return -(-self.classes // (math.isqrt((self.classes - 1) // 4) + 1))

    @cached_property
    def runs(self) -> int:
        return -(-self.classes // self.run)

    @property
    def size(self) -> int:
        return sum(math.prod(s) for s in self.shapes.values())

    @cached_property
    def future(self) -> np.ndarray:
        """What must not be seen, as a large negative number."""
        b = self.block
        return np.where(np.concatenate((np.ones((b, b), bool), np.tril(np.ones((b, b), bool))), 1), 0, -1e4).astype(np.float32)

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = math.prod(shape)
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def initial(self, share: np.ndarray, seed: int = 3) -> np.ndarray:
        """Weights to start from; without any input the classes have these shares."""
        flat = np.random.default_rng(seed).normal(0, 0.25, self.size).astype(np.float32)
        w = self.unpack(flat)
        w["b"][:] = 0
        w["o"] *= 0.3
        w["r"] *= 0.3
        w["c"][:] = np.log(np.maximum(share, 1e-9))
        w["d"][:] = np.log(np.maximum(np.add.reduceat(share, np.arange(0, self.classes, self.run)), 1e-9))
        return flat

    def blocks(self, n: np.ndarray, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sequences of n elements each, one after another, as padded blocks: rows, targets, whether they count, whether a block follows one."""
        per = -(-n // self.block)
        first = np.cumsum(per) - per
        at = np.arange(len(one)) + np.repeat(first * self.block - (np.cumsum(n) - n), n)
        total = int(per.sum())
        out = [np.zeros(total * self.block, np.int32) for _ in range(3)]
        counts = np.zeros(total * self.block, bool)
        for x, y in zip(out, (one, two, target), strict=True):
            x[at] = y
        counts[at] = True
        follows = np.ones(total, bool)
        follows[first[per > 0]] = False
        return *(x.reshape(-1, self.block) for x in out), counts.reshape(-1, self.block), follows

    def forward(self, w: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, a: int, b: int, follows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Batched masked attention of the inputs of the blocks from a to b over those of the blocks before them and their own.

        Attention weights are not divided by their sums; what they gather is.
        """
        n, size, width = b - a, self.block, self.width
        rows = [x[a - 1 : b].reshape(-1) if a else np.concatenate((x[0], x[:b].reshape(-1))) for x in (one, two)]
        x = w["e"].take(rows[0], 0)
        x += w["e"].take(rows[1], 0)
        now = x[size:]
        q = (now @ (w["q"] * w["q"].dtype.type(width**-0.5))).reshape(n, size, width)
        kv = x @ np.concatenate((w["k"], w["v"]), 1)
        kv = np.lib.stride_tricks.as_strided(kv, (n, 2 * size, 2 * width), (size * kv.strides[0], *kv.strides), writeable=False)  # windows overlap
        k, v = kv[:, :, :width], kv[:, :, width:]
        s = np.matmul(q, k.transpose(0, 2, 1))
        s += w["b"] + self.future
        s[~follows[a:b], :, :size] = -1e4
        if s.max() > 60:
            s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        z = summed(s).reshape(-1, 1)
        z += z.dtype.type(1e-30)
        seen = np.matmul(s, v).reshape(-1, width)
        seen /= z
        h = seen + now
        h /= 1 + np.abs(h)  # like tanh, but cheaper
        return s, z, q, k, v, rows, x, seen, h

    def choice(self, h: np.ndarray, target: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places that count, in the order of the runs of their classes; their outputs, with a 1 for the biases; their classes."""
        cls, counts = target.reshape(-1), counts.reshape(-1)
        by = np.argsort(np.where(counts, cls // self.run, self.runs).astype(np.uint16), kind="stable")[: np.count_nonzero(counts)]
        some = np.ones((len(by), self.width + 1), h.dtype)
        some[:, : self.width] = h.take(by, 0)
        return by, some, cls.take(by)

    def steps(self, w: dict[str, np.ndarray], h: np.ndarray, cls: np.ndarray):
        """(shares, places of what is right in them, weights with biases, their columns, rows) of the run of each class and, run by run, of the class in its run."""
        run, size = cls // self.run, self.run
        bounds = np.searchsorted(run, np.arange(self.runs + 1)).tolist()
        both = [np.concatenate((w[o], w[c][None])) for o, c in ("rd", "oc")]
        large = max(np.abs(x).sum(0).max() for x in both) > 60  # outputs are between -1 and 1
        for i, (x, y) in enumerate([(0, len(cls)), *zip(bounds[:-1], bounds[1:], strict=True)]):
            if x < y:
                own = slice((i - 1) * size, min(i * size, self.classes)) if i else slice(None)
                weights = both[min(i, 1)][:, own]
                p = h[x:y] @ weights
                if large:
                    p -= p.max(1, keepdims=True)
                np.exp(p, out=p)
                p /= summed(p)[:, None]
                yield p.reshape(-1), np.arange(0, p.size, p.shape[1]) + (cls[x:y] - own.start if i else run), weights, ("o", "c") if i else ("r", "d"), own, slice(x, y)

    def gradient(self, flat: np.ndarray, data: tuple[np.ndarray, ...], at: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss on consecutive blocks `at`, and its gradient."""
        one, two, target, counts, follows = data
        a, b, size, width = int(at[0]), int(at[-1]) + 1, self.block, self.width
        w = self.unpack(flat)
        s, z, q, k, v, rows, x, seen, h = self.forward(w, one, two, a, b, follows)
        flat_g = np.zeros_like(flat)
        g = self.unpack(flat_g)
        by, some, cls = self.choice(h, target[a:b], counts[a:b])
        n = len(by)
        d_some, said = np.zeros((n + 1, width), flat.dtype), np.ones(n)  # the last row is of places that do not count
        for p, right, weights, (o, c), own, at_ in self.steps(w, some, cls):
            said[at_] *= p[right]
            p[right] -= 1
            p = p.reshape(len(right), -1)
            both = some[at_].T @ p
            g[o][:, own], g[c][own] = both[:-1], both[-1]
            d_some[at_] += p @ weights[:-1].T
        place = np.full(len(h), n)
        place[by] = np.arange(n)
        dx = d_some.take(place, 0)
        h = 1 - np.abs(h)
        dx *= h
        dx *= h
        inner = summed(dx * seen).reshape(-1, 1)
        inner /= z
        each = (dx / z).reshape(b - a, size, width)
        ds = np.matmul(each, v.transpose(0, 2, 1))
        ds -= inner.reshape(b - a, size, 1)
        ds *= s
        g["b"].reshape(-1)[:] = np.ones(b - a, ds.dtype) @ ds.reshape(b - a, -1)
        dq = np.matmul(ds, k).reshape(-1, width)
        dq *= flat.dtype.type(width**-0.5)
        g["q"][:] = x[size:].T @ dq
        both = np.empty((b - a, 2 * size, 2 * width), flat.dtype)
        np.matmul(ds.transpose(0, 2, 1), q, out=both[:, :, :width])
        np.matmul(s.transpose(0, 2, 1), each, out=both[:, :, width:])
        own = np.zeros((b - a + 1, size, 2 * width), flat.dtype)
        own[:-1] = both[:, :size]
        own[1:] += both[:, size:]
        own = own.reshape(-1, 2 * width)
        kv = x.T @ own
        g["k"][:], g["v"][:] = kv[:, :width], kv[:, width:]
        d = own @ np.concatenate((w["k"], w["v"]), 1).T
        dx += dq @ w["q"].T
        d[size:] += dx
        for r in rows:
            g["e"][:] += np.stack([np.bincount(r, column, self.inputs) for column in np.ascontiguousarray(d.T)], 1)
        flat_g *= flat.dtype.type(1 / max(1, n))
        return float(-np.log(np.maximum(said, 1e-40)).sum()) / max(1, n), flat_g

    def train(self, flat: np.ndarray, data: tuple[np.ndarray, ...], rate: float, seed: int, passes: float = 1.0, batch: int = 192) -> tuple[np.ndarray, float]:
        """Adam over all blocks, passes times, in runs of `batch` in a random order; sequences should lie in one. (Weights, mean loss of the last fifth.)"""
        many = len(data[0])
        runs = -(-many // batch)
        steps = max(runs, round(passes * runs))
        rng, flat = np.random.default_rng(seed), flat.copy()
        order = np.concatenate([rng.permutation(runs) for _ in range(-(-steps // runs))]) * batch
        m, v, losses = np.zeros_like(flat), np.zeros_like(flat), []
        for t in range(1, steps + 1):
            a = int(order[t - 1])
            loss, g = self.gradient(flat, data, np.arange(a, min(a + batch, many)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            flat -= np.float32(rate * (1 - 0.8 * t / steps)) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.99**t)) + np.float32(1e-8))
            losses.append(loss)
        return flat, float(np.mean(losses[-max(1, steps // 5) :]))

    def log10(self, flat: np.ndarray, data: tuple[np.ndarray, ...], step: int = 512) -> np.ndarray:
        """log10 probability of each target, in order."""
        one, two, target, counts, follows = data
        w = self.unpack(flat)
        out = np.zeros(target.shape, np.float32)
        for a in range(0, len(one), step):
            b = min(a + step, len(one))
            by, some, cls = self.choice(self.forward(w, one, two, a, b, follows)[-1], target[a:b], counts[a:b])
            each = np.zeros(len(by), np.float32)
            for p, right, *_, at in self.steps(w, some, cls):
                each[at] += np.log(np.maximum(p[right], 1e-30))
            out[a:b].reshape(-1)[by] = each
        return out[counts] / np.float32(math.log(10))
