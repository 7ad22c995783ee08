"""Language identification in two steps: the family first, then one-versus-one linear support vector machines in it.

Features are hashed byte pairs and triples of the lower-cased text with everything that is not a letter turned into
spaces, as square roots of counts scaled to unit length. Families come from a table of well-known codes; a language
without an entry is a family of its own. Models are trained by dual coordinate descent in NumPy on a bounded sample.

Defined results: text that is null or has no letter gives `und` with score 0; without training rows every text is `und`;
with a single learned language every text with a letter gets it; ties go to the code that sorts first; nothing but the
text enters a prediction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_bound, per_text

DIM = 4096
# Language families by code.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "yi", "lb", "fy"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "mk"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "indic": ["hi", "bn", "mr", "pa", "gu", "ur", "ne"],
    "semitic": ["ar", "he", "mt", "am"],
    "malay": ["id", "ms", "jv", "tl"],
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


def features(text: bytes) -> np.ndarray:
    """Unit vector of DIM hashed byte pairs and triples; runs of non-letters count as one space."""
    raw = b" " + b" ".join(text.translate(_FOLD).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = a[:-1] * np.uint32(257) + a[1:]
    three = two[:-1] * np.uint32(263) + a[2:] + np.uint32(1 << 20)
    x = np.bincount((two * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM) + np.bincount((three * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
    x = np.sqrt(x.astype(np.float32))
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Two-class linear SVM with squared hinge loss by dual coordinate descent; y is +1 or -1."""
    rng, n = np.random.default_rng(seed), len(y)
    x = np.hstack([x, np.ones((n, 1), x.dtype)])
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(n), (x * x).sum(1) + 0.5 / c
    for _ in range(epochs):
        for i in rng.permutation(n):
            new = max(0.0, alpha[i] - (y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c) / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1].astype(np.float32), float(w[-1])


def squash(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(margin, -8, 8)))


@dataclass
class Model:
    """classes: names in order; pairs: (i, j) of each row of weights, positive for i; below: for families, a model each."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray
    below: list[Model] | None = None

    def shares(self, x: np.ndarray) -> np.ndarray:
        """For each row, votes of all pairs weighted by their certainty, summing to 1."""
        out = np.zeros((len(x), len(self.classes)))
        if not self.pairs:
            return out + 1
        p = squash(x @ self.weights.T + self.bias)
        for k, (i, j) in enumerate(self.pairs):
            out[:, i] += p[:, k]
            out[:, j] += 1 - p[:, k]
        return out / len(self.pairs)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        own = self.shares(x)
        best = own.argmax(1)
        # against the best possible share of a class, which is (classes - 1) / pairs
        score = np.minimum(1, own.max(1) * max(1, len(self.pairs)) / max(1, len(self.classes) - 1))
        if self.below is None:
            return [self.classes[i] for i in best], score
        names = np.empty(len(x), object)
        for i, model in enumerate(self.below):
            at = np.flatnonzero(best == i)
            if len(at):
                names[at], inner = model.predict(x[at])
                score[at] *= inner
        return list(names), score


def _one_versus_one(x: np.ndarray, y: np.ndarray, classes: list[str]) -> Model:
    pairs = [(i, j) for i in range(len(classes)) for j in range(i + 1, len(classes))]
    fits = []
    for i, j in pairs:
        at = np.flatnonzero((y == classes[i]) | (y == classes[j]))
        fits.append(svm(x[at], np.where(y[at] == classes[i], 1.0, -1.0)))
    return Model(classes, pairs, np.array([w for w, _ in fits], np.float32).reshape(len(pairs), DIM), np.array([b for _, b in fits]))


def train(x: np.ndarray, langs: list[str]) -> Model | None:
    if not len(langs):
        return None
    y = np.array(langs, object)
    family = np.array([FAMILY_OF.get(v, f"={v}") for v in langs], object)
    families = sorted(set(family))
    top = _one_versus_one(x, family, families)
    top.below = [_one_versus_one(x[family == f], y[family == f], sorted(set(y[family == f]))) for f in families]
    return top


def fit(docs: DataFrame, per_language: int = 600, languages: int = 200, rows: int = 24_000) -> Model | None:
    """Learn from rows with text and lang: a sample of about `rows` documents at most, about per_language of each language.

    docs: columns doc_id, text, lang, already without held-out rows. Only the most frequent `languages` values of lang are
    learned (ties by name). All three are documented bounds of the labelled sample; rows are chosen by a hash of id and text,
    equal ones count once, and the whole text of each is used.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return None
    each = min(per_language, max(1, rows // len(counts)))
    share = F.create_map(*(x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(hash_bound(1.2 * each / n)).cast("long"))))
    order = F.xxhash64("doc_id", "text", F.lit(11))
    sample = known.where(order <= F.try_element_at(share, F.col("lang"))).withColumn("turn", order)  # null for languages that are not learned

    def make():
        def work(texts: list[bytes]) -> list[pa.Array]:
            x = [features(t).astype(np.float16).tobytes() if has_letter(t) else None for t in texts]
            return [pa.array(x, pa.binary())]

        return work

    got = per_text(sample, "text", ["turn", "lang"], "x binary", make).where("x is not null").groupBy("lang", "turn").agg(F.min("x").alias("x")).collect()
    by: dict[str, int] = {}
    chosen = []
    for r in sorted(got, key=lambda r: (r["lang"], r["turn"])):
        by[r["lang"]] = by.get(r["lang"], 0) + 1
        if by[r["lang"]] <= each:
            chosen.append(r)
    if not chosen:
        return None
    return train(np.array([np.frombuffer(r["x"], np.float16) for r in chosen], np.float32), [r["lang"] for r in chosen])


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Columns in keep, lang_pred and score for every document."""

    def make():
        def work(texts: list[bytes]) -> list[pa.Array]:
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            for start in range(0, len(texts), 512):
                at = [i for i in range(start, min(start + 512, len(texts))) if has_letter(texts[i])] if model else []
                if at:
                    got, score = model.predict(np.array([features(texts[i]) for i in at]))
                    for i, name, s in zip(at, got, score, strict=True):
                        names[i], scores[i] = name, float(s)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return work

    return per_text(docs, "text", keep, "lang_pred string, score double", make)
