"""Quality rules: decision lists learned by sequential covering, emitted as Spark conditional expressions.

Statistics of a document are counted over its whole text. Rules for the rejected class are grown by information gain on
two thirds of the labelled sample and pruned on the rest; a rule is kept only if it is precise on the pruning part, so
that clean documents stay. The list is ordered: the first rule that holds names the verdict.

Defined results: null or empty text has zero counts and fails the base test (fewer than 20 words); null ids are kept;
repeated rows give repeated results; without usable labels the list is empty and only the base test rejects; extra
columns never matter because only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_bound, per_text, rolling, word_ids

SYMBOLS = b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_digits long, n_marks long, n_distinct long"
# What rules may test: name -> expression over the statistics.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "words": "double(n_words)",
}
WINDOW = 8


def statistics(text: bytes) -> tuple[int, ...]:
    """The counts of STATS for one text."""
    words = text.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(hist[:128].sum() + hist[192:].sum() - hist[32] - hist[9:14].sum())
    symbols = int(sum(hist[c] for c in SYMBOLS))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat, distinct = 0, n
    if n:
        ids = word_ids(words)
        distinct = len(np.unique(ids))
        if n > WINDOW:
            windows = rolling(ids, WINDOW)
            _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
            if len(counts) < len(windows):
                edge = np.zeros(n + 1, np.int64)
                at = np.flatnonzero(counts[inverse] > 1)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                repeat = int((np.cumsum(edge[:-1]) > 0).sum())
    upper = int(hist[65:91].sum())
    digits = int(hist[48:58].sum())
    marks = int(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum())
    return n, chars, symbols, dup, repeat, lines, upper, digits, marks, distinct


def _batch(texts: list[bytes]) -> list[pa.Array]:
    rows = np.array([statistics(t) for t in texts], np.int64).reshape(len(texts), 10)
    return [pa.array(rows[:, i]) for i in range(10)]


def with_statistics(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns of docs (or those in keep) and STATS."""
    return per_text(docs, text, keep, STATS, lambda: _batch)


@dataclass
class Rule:
    """A conjunction of thresholds: (feature, is_upper, value) holds if the feature is over (or at most) the value."""

    tests: list[tuple[str, bool, float]] = field(default_factory=list)
    precision: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, over, value in self.tests:
            x = F.expr(FEATURES[name])
            out = out & ((x > value) if over else (x <= value))
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, over, value in self.tests:
            out &= (x[name] > value) if over else (x[name] <= value)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if o else '<='} {v:.6g}" for n, o, v in self.tests)


@dataclass
class DecisionList:
    rules: list[Rule]

    def verdict(self) -> Column:
        """Ordered conditional expression: the number of the first rule that rejects, else null."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            out = F.when(rule.column(), i) if out is None else out.when(rule.column(), i)
        return F.lit(None).cast("int") if out is None else out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.95, max_tests: int = 3, max_rules: int = 12, min_cover: int = 5, seed: int = 7) -> DecisionList:
    """Sequential covering: grow a rule for the bad class, prune it, keep it if precise on unseen rows, drop what it covers."""
    n = len(bad)
    order = np.random.default_rng(seed).permutation(n)
    for_prune = np.zeros(n, bool)
    for_prune[order[: n // 3]] = True
    left = np.ones(n, bool)
    rules: list[Rule] = []
    while len(rules) < max_rules and (bad & left & ~for_prune).sum() >= min_cover:
        rule = _grow(x, bad, left & ~for_prune, max_tests)
        rule = _prune(rule, x, bad, left & for_prune)
        covered = rule.holds(x)
        at = covered & left & for_prune
        good_part = covered & left & ~for_prune
        if not rule.tests or at.sum() < 2 or good_part.sum() < min_cover:
            break
        rule.precision = float((bad[at].sum() + bad[good_part].sum()) / (at.sum() + good_part.sum()))
        # also against every row, covered earlier or not, so that order never hides a harmful rule
        if rule.precision < min_precision or bad[covered].mean() < min_precision:
            break
        rules.append(rule)
        left &= ~covered
    return DecisionList(rules)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, at: np.ndarray, max_tests: int) -> Rule:
    rule, now = Rule(), at.copy()
    for _ in range(max_tests):
        p0, n0 = int((bad & now).sum()), int((~bad & now).sum())
        if not n0 or not p0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for name, values in x.items():
            v = values[now]
            by = np.argsort(v, kind="stable")
            v, y = v[by], bad[now][by]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            p_low = np.cumsum(y)[cut]
            n_low = cut + 1 - p_low
            for over, p, q in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + q)) - base), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), (name, over, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.tests.append(best[1])
        now = at & rule.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, at: np.ndarray) -> Rule:
    """Drop final tests as long as the (p - n) / (p + n) of the pruning rows does not fall."""

    def worth(tests: list) -> float:
        hit = Rule(tests).holds(x) & at
        p, n = int((bad & hit).sum()), int((~bad & hit).sum())
        return (p - n) / (p + n) if p + n else -1.0

    tests = list(rule.tests)
    while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
        tests.pop()
    return Rule(tests)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, id_col: str = "doc_id", **settings) -> DecisionList:
    """Learn from at most about max_rows labelled documents (a documented bound), chosen by a hash of their id."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality"))
    total = known.count()
    if not total:
        return DecisionList([])
    chosen = known.where(F.xxhash64("id") <= F.lit(hash_bound(max_rows / total)).cast("long")).groupBy("id").agg(F.min("quality").alias("quality"))
    sample = docs.select(F.col(id_col).alias("id"), F.col("text")).join(F.broadcast(chosen), "id")
    rows = with_statistics(sample, ["id", "quality"]).select("id", "quality", F.struct(*(F.expr(e).cast("double").alias(k) for k, e in FEATURES.items())).alias("x"))
    # of documents with one id the least in its features, so that neither order nor repeats matter
    rows = rows.groupBy("id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).select("id", "quality", "x.*").orderBy("id").toPandas()
    if rows.empty:
        return DecisionList([])
    return learn({k: rows[k].to_numpy(float) for k in FEATURES}, (rows["quality"] == 0).to_numpy(), **settings)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, rules: DecisionList, keep: list[str] | None = None) -> DataFrame:
    """Columns in keep, the counts, base_failed, rule (number of the rejecting rule or null) and kept."""
    out = with_statistics(docs, keep)
    verdict = rules.verdict()
    return out.withColumns({"base_failed": base_failed(), "rule": verdict}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
