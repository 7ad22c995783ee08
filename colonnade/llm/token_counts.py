"""Token counts under a unigram vocabulary without making the tokens: best-path dynamic programming that carries counts.

An Aho-Corasick automaton lists every vocabulary piece in a string; for each end the best score and the number of pieces
of the path that has it are kept. Rules of ties are those of the unigram tokenizer of the `tokenizers` library: a later
start replaces an earlier one only with a strictly better score, and a character that is no piece by itself costs the
lowest score less ten. Unknown characters count one token for each UTF-8 byte (byte fallback) or, if `fuse`, one for each
run of them.

The vocabulary is that of a public model file (a parameter, read by the driver). Its scores are merge ranks, not log
probabilities; a piece of rank r gets log(1 / (r + 1)) less the log of the harmonic sum, rounded to 2^-16, so that sums
are exact in double precision and a text may be split wherever no piece crosses: before a word mark that follows another
character, and around characters that no piece holds. Distinct parts are counted once in each worker.

Defined results: null or empty text has no tokens; text of spaces only counts the pieces of its word marks.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text

MARK = "▁"
UNKNOWN_PENALTY = 10.0
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) of the normal pieces of a sentence-piece model file, in order."""
    pieces = []
    for number, value in _fields(Path(path).read_bytes()):
        if number == 1:
            piece = dict(_fields(value))
            if piece.get(3, 1) == 1:
                pieces.append(piece[1].decode("utf-8"))
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return [(p, round((-math.log(r + 1) - total) * 65536) / 65536) for r, p in enumerate(pieces)]


@dataclass
class Counter:
    """Counts pieces of strings; `seen` keeps the counts of parts met before, up to max_seen of them."""

    vocab: list[tuple[str, float]]
    fuse: bool = False
    max_seen: int = 500_000

    def __post_init__(self) -> None:
        self.find = ahocorasick.Automaton()
        for piece, score in self.vocab:
            self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.single = {p for p, _ in self.vocab if len(p) == 1}
        self.unknown = min(s for _, s in self.vocab) - UNKNOWN_PENALTY
        inside = {c for p, _ in self.vocab for c in p}
        crossing = any(MARK in p.lstrip(MARK) for p, _ in self.vocab)
        # parts: a run of word marks with what follows, or a line feed; fused runs must stay together
        self.parts = None if crossing or self.fuse or "\n" in inside else re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        self.seen: dict[str, int] = {}

    def path(self, text: str) -> tuple[float, int]:
        """Best score and its number of tokens."""
        n = len(text)
        if not n:
            return 0.0, 0
        matches: list[list[tuple[int, float]] | None] = [None] * (n + 1)
        for end, (size, score) in self.find.iter(text):
            if matches[end + 1] is None:
                matches[end + 1] = [(end + 1 - size, score)]
            else:
                matches[end + 1].append((end + 1 - size, score))
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top = start = None
            for s, score in matches[end] or ():
                x = best[s] + score
                if top is None or x > top or x == top and s < start:
                    top, start = x, s
            if text[end - 1] not in self.single and (top is None or best[end - 1] + self.unknown > top):
                best[end] = best[end - 1] + self.unknown
                count[end] = count[end - 1] + ((0 if unknown[end - 1] else 1) if self.fuse else len(text[end - 1].encode("utf-8", "surrogatepass")))
                unknown[end] = True
            else:
                best[end], count[end] = top, count[start] + 1
        return best[n], count[n]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if self.parts is None:
            return self.path(text)[1]
        seen, total = self.seen, 0
        if len(seen) > self.max_seen:
            seen.clear()
        for part in self.parts.findall(text):
            n = seen.get(part)
            if n is None:
                n = self.path(part)[1]
                if len(part) <= 64:
                    seen[part] = n
            total += n
        return total


_COUNTERS: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, path: str = VOCABULARY, keep: list[str] | None = None, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Columns in keep and the number of tokens of each text."""
    vocab = vocabulary(path)
    key = hash((len(vocab), vocab[0], vocab[-1]))
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def make():
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(sent.value)
        counter = _COUNTERS[key]
        return lambda texts: [pa.array([counter(t.decode("utf-8", "replace")) for t in texts], pa.int64())]

    return per_text(docs, text, keep, f"{name} long", make)
