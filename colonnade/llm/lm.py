"""Language-model scoring: causal self-attention over subword ids, trained and applied in NumPy.

A text is its words (A-Z lower-cased) and an end. A word is the ids of its pieces in a public subword vocabulary. The
probability of a word is that of its class, by an attention model over the pieces of the words before it, times that of the
word in its class. Frequent words are classes of their own; the others are grouped by which frequent words their pieces are
seen beside. Within a class, corpus counts are mixed with the probability that a second attention model gives to the word's
spelling, piece by piece: the spelling has the weight of as many counts as the class has different words.

A text is scored in windows of two blocks: the words of the second block are scored, each once, with those of the first and
those before them in the second as context. The spelling of a known word is scored once in the corpus, not in each text.

Counts cover all words of all training documents, joined on a 64-bit hash of the word; of them only a bounded table of
frequent words is broadcast. All segments of SEGMENT words of all training documents train the first model, and all different
words the second, each once: shards of them are trained in parallel and their weights averaged. They start from weights that
about WARM of the segments and words have trained before. Shards hold segments by hash, and sums are of whole numbers, so
neither the order of rows nor of tasks matters but for rounding.

Defined results: null or empty text is one end; without training documents all counts are 0 and both models have the weights
they start from; equal rows get equal results; ids may repeat or be null.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .attention import Net
from .common import discard, materialize, small_batches, text_bytes, word_hashes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SEGMENT = 64
WARM = 4096
SHARD = 16384  # segments, or words by four, that a task trains on
BATCH = 384  # blocks of a step of that training
CODED = np.dtype([("one", "<u2"), ("two", "<u2"), ("cls", "u1")])  # a place of a segment: rows of the word before it, class
ROWS = 1024  # input rows: frequent pieces have their own, others share 64
TOP = 63  # frequent words that are classes
GROUPS = 64
CLASSES = 1 + TOP + GROUPS  # the first is the end of the text
DIM = 6  # of the space in which words are grouped
PIECE_CLASSES, OWN = 128, 96  # of a spelling's pieces; those with an own class
CHUNK = 1 << 20  # bytes of text handled at a time
WORDS = Net(ROWS + 1, CLASSES, 16)
SPELLING = Net(ROWS + 1 + CLASSES, PIECE_CLASSES, 8)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def cut(pieces: sentencepiece.SentencePieceProcessor, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of words and how many each has; a word without any counts as the unknown piece."""
    got = pieces.encode([w.lower().decode("utf-8", "replace") for w in words], num_threads=1) if words else []
    got = [x or [0] for x in got]
    sizes = np.fromiter(map(len, got), np.int64, len(got))
    return np.fromiter(itertools.chain.from_iterable(got), np.int64, int(sizes.sum())), sizes


class Pieces:
    """The pieces of words, of which those of the first words met are kept, by hash."""

    def __init__(self, path: str, most: int = 300_000) -> None:
        self.own, self.most = processor(path), most
        self.hash, self.sizes, self.first, self.ids = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0, np.int32)

    def of(self, hashes: np.ndarray, spelling: Callable[[np.ndarray], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of words given by hash, and how many each has; spelling gives the bytes of the words at some places."""
        place = np.minimum(np.searchsorted(self.hash, hashes), max(0, len(self.hash) - 1))
        known = self.hash[place] == hashes if len(self.hash) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~known)
        ids, n = cut(self.own, spelling(new))
        sizes, start = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        for at, size, first in ((known, self.sizes[place[known]], self.first[place[known]]), (new, n, np.cumsum(n) - n + len(self.ids))):
            sizes[at], start[at] = size, first
        every = np.concatenate((self.ids, ids.astype(np.int32)))
        if len(self.hash) + len(new) <= self.most:
            to = np.searchsorted(self.hash, hashes[new])
            self.hash, self.sizes, self.first = (np.insert(x, to, y) for x, y in ((self.hash, hashes[new]), (self.sizes, n), (self.first, start[new])))
            self.ids = every
        return every[np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))].astype(np.int64), sizes


class Texts:
    """The words of some texts: numbers into their different words, of which the hash is known."""

    def __init__(self, texts: pa.Array) -> None:
        data, bounds = text_bytes(texts)
        hashes, at, start, end, a = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while a < len(texts):  # powers of the hash are kept for short runs of bytes only
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + (1 << 18), "right")) - 1)
            h, of, x, y = word_hashes(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            hashes.append(h)
            at.append(of[1:] + at[-1][-1])
            start.append(x + bounds[a])
            end.append(y + bounds[a])
            a = b
        self.at = np.concatenate(at)
        every = np.concatenate(hashes)
        by = np.argsort(every)  # np.unique would sort stably, which takes much longer
        new = np.append(True, (ordered := every[by])[1:] != ordered[:-1])[: len(by)]
        self.words = np.empty(len(by), np.int64)
        self.words[by] = np.cumsum(new) - 1
        self.hash, first = ordered[new], by[new]
        self.start, self.end, self.raw = np.concatenate(start)[first], np.concatenate(end)[first], memoryview(data)

    def cut(self, some: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of words given by number, and how many each has."""
        start, end = self.start[some], self.end[some]
        return pieces.of(self.hash[some], lambda new: [bytes(self.raw[x:y]) for x, y in zip(start[new].tolist(), end[new].tolist(), strict=True)])


def chunks(array: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(place, texts) of runs of about CHUNK bytes."""
    bounds, a = text_bytes(array)[1], 0
    while a < len(array):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + CHUNK, "right")) - 1)
        yield a, array[a:b]
        a = b


def gathered(docs: DataFrame, path: str, text: str, parts: int, salt: Column | None = None) -> DataFrame:
    """Runs of texts as their different words, with pieces, and the numbers of these words at each place, as a table. Segments of texts with one salt keep together."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            for a, some in chunks(batch.column(0)):
                t = Texts(some)
                ids, sizes = t.cut(np.arange(len(t.hash)), pieces)
                kind = np.uint16 if len(t.hash) <= 1 << 16 else np.uint32
                salts = batch.column(1)[a : a + len(some)].to_numpy(zero_copy_only=False)
                row = (t.hash, sizes.astype(np.uint32), ids.astype(np.uint16), t.words.astype(kind), t.at, salts)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=RUN)

    return materialize(docs.select(text, F.lit(0).cast("long") if salt is None else salt).mapInArrow(run, ", ".join(f"{x} binary" for x in RUN)), "gathered")


RUN = ["hash", "sizes", "ids", "numbers", "at", "salt"]


@dataclass
class Run:
    """A row of gathered()."""

    hash: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray
    numbers: np.ndarray
    at: np.ndarray
    salt: np.ndarray


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    for batch in batches:
        for i in range(len(batch)):
            h, sizes, ids, numbers, at, salt = (np.frombuffer(c[i].as_buffer(), kind) for c, kind in zip(batch.columns, (np.uint64, np.uint32, np.uint16, np.uint8, np.int64, np.int64), strict=True))
            yield Run(h, sizes, ids, numbers.view(np.uint16 if len(h) <= 1 << 16 else np.uint32), at, salt)


def counted(got: DataFrame, parts: int) -> DataFrame:
    """(word, n, ids) of all different words of the runs, as a table."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in runs(batches):
            if len(r.hash):  # np.unique sorts, so ranges lie one after another
                n = np.bincount(r.numbers, minlength=len(r.hash))
                of = ((r.hash >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                first = np.cumsum(r.sizes, dtype=np.int64) - r.sizes
                columns = np.split(r.hash, cuts[1:]), np.split(n.astype(np.int64), cuts[1:]), np.split(r.sizes, cuts[1:]), np.split(r.ids, first[cuts[1:]])
                yield pa.RecordBatch.from_arrays([pa.array(of[cuts]), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in columns)], names=["part", "words", "n", "sizes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h, n, sizes, ids = (np.concatenate([np.frombuffer(x[i], kind) for x in held]) for i, kind in enumerate((np.uint64, np.int64, np.uint32, np.uint16)))
            first = np.cumsum(sizes, dtype=np.int64) - sizes
            known, at, which = np.unique(h, return_index=True, return_inverse=True)
            total = np.zeros(len(known), np.int64)
            np.add.at(total, which, n)
            for a in range(0, len(at), 1 << 16):
                some = at[a : a + (1 << 16)]
                size = sizes[some].astype(np.int64)
                own = ids[np.repeat(first[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                ends = np.append(0, np.cumsum(size) * 2).astype(np.int32)  # pieces are numbers below 65,536
                spelled = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(own.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(known[a : a + (1 << 16)].view(np.int64)), pa.array(total[a : a + (1 << 16)]), spelled], names=["word", "n", "ids"])
            held.clear()

        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    yield from settle()
                    part = p
                held.append(row)
        yield from settle()

    rows = got.mapInArrow(cut_up, "part long, words binary, n binary, sizes binary, ids binary").repartition(parts, "part").sortWithinPartitions("part")
    return materialize(rows.mapInArrow(run, "word long, n long, ids binary"), "counts")


def spelled(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of words kept as bytes, and how many each has."""
    data, bounds = text_bytes(ids)
    return np.frombuffer(data[bounds[0] : bounds[-1]].tobytes(), np.uint16).astype(np.int64), np.diff(bounds) // 2


def coded(batches: Iterator[pa.RecordBatch], codes: Codes, most: int) -> Iterator[pa.RecordBatch]:
    """(key, data) of the training segments whose key, a hash, is at most `most`: data has a CODED value for each word and, in the last of a text, the end."""
    for r in runs(batches):
        many = np.diff(r.at) + 1
        begin = np.cumsum(many) - many
        words = np.full(int(many.sum()), -1, np.int64)  # -1 is the end of a text, and what is before its first word
        inner = np.ones(len(words), bool)
        inner[begin + many - 1] = False
        words[inner] = r.numbers
        per = -(-many // SEGMENT)
        of = np.repeat(np.arange(len(many)), per)
        within = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
        start = begin[of] + within * SEGMENT
        n = np.diff(np.append(start, len(words)))
        key = np.add.reduceat(np.append(mixed(r.hash), np.uint64(0))[words], start) if len(start) else np.zeros(0, np.uint64)
        key = mixed(mixed(key + within.astype(np.uint64)) ^ r.salt.view(np.uint64)[of])
        key = (key * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        before = np.append(-1, words[:-1])
        if most < (1 << 63) - 1:
            chosen = key <= most
            here = np.repeat(chosen, n)
            words, before, n, key = words[here], before[here], n[chosen], key[chosen]
        if not len(key):
            continue
        used = np.zeros(len(r.hash) + 1, bool)
        used[words] = used[before] = True
        some = np.flatnonzero(used[:-1])
        sizes = r.sizes.astype(np.int64)
        size = sizes[some]
        ids = r.ids[np.repeat((np.cumsum(sizes) - sizes)[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].astype(np.int64)
        cls, one, two = (np.full(len(used), x, kind) for x, kind in ((0, np.uint8), (ROWS, np.uint16), (ROWS, np.uint16)))
        cls[some], one[some], two[some] = codes(r.hash[some].view(np.int64), ids, size)
        data = np.empty(len(words), CODED)
        data["one"], data["two"], data["cls"] = one[before], two[before], cls[words]
        ends = np.append(0, np.cumsum(n) * CODED.itemsize).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])], names=["key", "data"])


def _word_blocks(data: pa.Array, *_) -> tuple[np.ndarray, ...]:
    raw, bounds = text_bytes(data)
    got = np.frombuffer(raw[bounds[0] : bounds[-1]].tobytes(), CODED)
    return WORDS.blocks(np.diff(bounds) // CODED.itemsize, got["one"], got["two"], got["cls"])


@dataclass
class Codes:
    """What words are to the models: input rows of pieces, frequent words, and groups in a space of pieces."""

    row: np.ndarray
    top: np.ndarray
    space: np.ndarray
    centers: np.ndarray
    piece_class: np.ndarray
    share: np.ndarray

    def __call__(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, and input rows of the first and the last piece, of each word."""
        if not len(sizes):
            return (np.zeros(0, np.int64),) * 3
        first = np.cumsum(sizes) - sizes
        at = np.add.reduceat(self.space[ids], first) / sizes[:, None].astype(np.float32)
        cls = 1 + TOP + np.argmin((self.centers**2).sum(1) - 2 * (at @ self.centers.T), 1)
        by = np.argsort(self.top)
        place = by[np.minimum(np.searchsorted(self.top[by], hashes), len(by) - 1)] if len(by) else None
        if place is not None:
            cls = np.where(self.top[place] == hashes, 1 + place, cls)
        return cls, self.row[ids[first]], self.row[ids[first + sizes - 1]]

    def spelling(self, cls: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Blocks of the pieces of words and of their ends, with the class of the word at each."""
        n = sizes + 1
        ends = np.cumsum(n) - 1
        target = np.full(int(n.sum()), len(self.row), np.int64)
        inner = np.ones(len(target), bool)
        inner[ends] = False
        target[inner] = ids
        one = np.full(len(target), ROWS, np.int64)
        after = np.append(False, inner[:-1])
        one[after] = self.row[target[:-1][inner[:-1]]]
        return (*SPELLING.blocks(n, one, np.repeat(ROWS + 1 + cls, n), self.piece_class[target]), self.share[target], ends)


def codes(pieces: np.ndarray, types: int, top: np.ndarray, seen: np.ndarray) -> Codes:
    """From how many different words have each piece, the frequent words, and how often pieces are before and after frequent words."""
    rank = np.empty(len(pieces), np.int64)
    rank[np.argsort(-pieces, kind="stable")] = np.arange(len(pieces))
    row = np.where(rank < ROWS - 64, rank, ROWS - 64 + rank % 64)
    full = np.append(pieces, types).astype(np.float64) + 1
    order = np.argsort(-full, kind="stable")
    piece_class = np.empty(len(full), np.int64)
    piece_class[order[:OWN]] = np.arange(OWN)
    rest = order[OWN:]
    shared = PIECE_CLASSES - OWN
    piece_class[rest] = OWN + np.minimum(np.cumsum(full[rest]) / full[rest].sum() * shared, shared - 1).astype(np.int64)
    share = np.log10(full / np.bincount(piece_class, full, PIECE_CLASSES)[piece_class])
    # pieces by the log of how much more often than others they are with each frequent word
    common = seen.sum(0) + 1.0
    space = np.log((seen + 20 * common / common.sum()) / ((seen.sum(1, keepdims=True) + 20) * common / common.sum())).astype(np.float64)
    space *= np.sqrt(common / common.sum())
    weight = seen.sum(1)
    values, vectors = np.linalg.eigh((space * weight[:, None]).T @ space)
    vectors = vectors[:, np.argsort(-values, kind="stable")[:DIM]]
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    space = space @ vectors
    used = np.flatnonzero(weight)
    rng = np.random.default_rng(1)
    if len(used):
        centers = space[rng.choice(used, GROUPS, p=weight[used] / weight[used].sum())] + rng.normal(0, 1e-3, (GROUPS, space.shape[1]))
        for _ in range(25):
            near = np.argmin((centers**2).sum(1) - 2 * space[used] @ centers.T, 1)
            mass = np.bincount(near, weight[used], GROUPS)
            sums = np.stack([np.bincount(near, weight[used] * space[used, d], GROUPS) for d in range(space.shape[1])], 1)
            centers = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1)[:, None], centers)
    else:
        centers = rng.normal(0, 1, (GROUPS, space.shape[1]))
    centers = centers[np.argsort(centers[:, 0], kind="stable")]  # alike classes are neighbours
    return Codes(row, top, space.astype(np.float32), centers.astype(np.float32), piece_class, share)


@dataclass
class Model:
    codes: Codes
    words: np.ndarray
    spelling: np.ndarray
    n: np.ndarray  # counts of each class
    types: np.ndarray  # different words of each class

    def spell(self, cls: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of the spelling of each word in its class."""
        if not len(sizes):
            return np.zeros(0)
        *data, share, ends = self.codes.spelling(cls, ids, sizes)
        each = SPELLING.log10(self.spelling, tuple(data)).astype(np.float64) + share
        return np.add.reduceat(each, np.append(0, ends[:-1] + 1))

    def in_class(self, cls: np.ndarray, n: np.ndarray, spell: np.ndarray) -> np.ndarray:
        """log10 probability of words in their class, from their counts and spelling."""
        own = (cls >= 1) & (cls <= TOP)
        types = np.maximum(self.types[cls], 1)
        said = np.log10((n + types * 10.0 ** np.maximum(spell, -300)) / (self.n[cls] + types))
        return np.where(own, 0.0, np.maximum(said, -300))

    def context(self, t: Texts, cls: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """log10 probability of the classes of the words of each text and of its end."""
        many = np.diff(t.at) + 1
        ends = np.cumsum(many) - 1
        target = np.zeros(int(many.sum()), np.int64)
        inner = np.ones(len(target), bool)
        inner[ends] = False
        target[inner] = cls[t.words]
        one, two = np.full(len(target), ROWS), np.full(len(target), ROWS)
        after = np.append(False, inner[:-1])
        one[after], two[after] = first[t.words], last[t.words]
        each = WORDS.log10(self.words, WORDS.blocks(many, one, two, target)).astype(np.float64)
        return np.add.reduceat(each, np.append(0, ends[:-1] + 1))


def averaged(net: Net, flat: np.ndarray, rows: DataFrame, shards: int, blocks, sent, rate: float) -> np.ndarray:
    """Weights trained on shards of rows of two columns in parallel from common weights, averaged by the shards' blocks in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(map(len, held)):
            data = blocks(*(pa.concat_arrays([b.column(i) for b in held]) for i in (1, 0)), sent)
            held.clear()
            got, _ = net.train(flat, data, rate, len(data[0]), batch=BATCH)
            n = np.full(net.size, len(data[0]), np.int64)
            whole = np.round(got.astype(np.float64) * (1 << 24)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(net.size, dtype=np.int32)), pa.array(whole * n), pa.array(n)], names=["i", "w", "n"])

    key = rows.columns[0]
    parts = rows.repartition(shards, key).sortWithinPartitions(*rows.columns).mapInArrow(run, "i int, w long, n long")
    got = parts.groupBy("i").agg(F.sum(F.col("w").cast("decimal(38,0)")).alias("w"), F.sum("n").alias("n")).select("i", (F.col("w").cast("double") / F.col("n")).alias("w")).toPandas()
    out = flat.copy()
    out[got["i"].to_numpy()] = got["w"].to_numpy() / (1 << 24)
    return out


def _spelling_blocks(pieces: pa.Array, words: pa.Array, sent) -> tuple[np.ndarray, ...]:
    ids, sizes = spelled(pieces)
    return sent.value.spelling(sent.value(words.to_numpy(), ids, sizes)[0], ids, sizes)[:5]


def fit(got: DataFrame, counts: DataFrame, n_docs: int, path: str, warm: int = WARM) -> Model:
    """The model of gathered() and counted() tables."""
    spark, size = got.sparkSession, processor(path).get_piece_size()
    top = np.array([r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(TOP).collect()], np.int64)

    def by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            n += np.bincount(spelled(batch.column(0))[0], minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n).astype(np.int32)), pa.array(n[n > 0])], names=["i", "n"])

    pieces = np.zeros(size, np.int64)
    for r in counts.select("ids").mapInArrow(by_piece, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row a piece
        pieces[r["i"]] = r["n"]

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = 2 * max(1, len(top))
        seen = np.zeros(size * sides, np.int64)
        by = np.argsort(top)
        for r in runs(batches):
            if not len(r.hash):
                continue
            h = r.hash.view(np.int64)
            place = np.minimum(np.searchsorted(top[by], h), len(top) - 1)
            kind = np.append(np.where(top[by][place] == h, by[place], -1), -1)[r.numbers]
            first = np.zeros(len(r.numbers) + 1, bool)
            first[r.at] = True
            sizes = r.sizes.astype(np.int64)
            begin = np.cumsum(sizes) - sizes
            # pieces of the words after (side 0) and before (side 1) a frequent one
            for side, at, near in ((0, np.flatnonzero((kind[:-1] >= 0) & ~first[1:-1]) + 1, -1), (1, np.flatnonzero((kind[1:] >= 0) & ~first[1:-1]), 1)):
                n = sizes[r.numbers[at]]
                ids = r.ids[np.repeat(begin[r.numbers[at]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].astype(np.int64)
                np.add.at(seen, ids * sides + np.repeat(kind[at + near], n) * 2 + side, 1)
        seen = seen.reshape(size, sides)
        used = np.flatnonzero(seen.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([x.tobytes() for x in seen[used]], pa.binary())], names=["i", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["i", "n"])

    seen = np.zeros((size, 2 * max(1, len(top))))
    if len(top):
        for r in got.mapInArrow(together, "i int, n binary").repartition(8, "i").mapInArrow(add, "i int, n binary").collect():  # a row a piece
            seen[r["i"]] = np.frombuffer(r["n"], np.int64)
    types, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    many = tokens // SEGMENT + n_docs  # segments, a little more than there are
    code = codes(pieces, types, top, seen)
    sent = spark.sparkContext.broadcast(code)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            cls = sent.value(batch.column(0).to_numpy(), *spelled(batch.column(2)))[0]
            np.add.at(n, cls, batch.column(1).to_numpy())
            kinds += np.bincount(cls, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(n), pa.array(kinds)], names=["i", "n", "kinds"])

    n, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counts.mapInArrow(by_class, "i int, n long, kinds long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        n[r["i"]], kinds[r["i"]] = r["n"], r["kinds"]
    n[0] = n_docs
    words = WORDS.initial((n + 1.0) / (n.sum() + CLASSES))
    spelling = SPELLING.initial(np.bincount(code.piece_class, np.append(pieces, types) + 1.0, PIECE_CLASSES) / (pieces.sum() + types + size + 1.0))
    different = counts.select("word", "ids")
    # about as many rows as are wanted, by hash, so that what reaches the driver stays bounded
    below = lambda all_: min((1 << 63) - 1, -(1 << 63) + (1 << 64) * warm // max(1, all_))
    segments = lambda most: got.mapInArrow(lambda batches: coded(batches, sent.value, most), "key long, data binary")
    first = segments(below(many)).toArrow().sort_by([("key", "ascending"), ("data", "ascending")])
    if len(first):
        words, _ = WORDS.train(words, _word_blocks(first["data"].combine_chunks()), 0.02, 1, min(1.0, 4096 / len(first)) * 3)
    first = different.where(F.xxhash64(F.lit(1), "word") <= F.lit(below(types))).toArrow().sort_by("word")
    if len(first):
        spelling, _ = SPELLING.train(spelling, _spelling_blocks(first["ids"].combine_chunks(), first["word"].combine_chunks(), sent), 0.02, 1, 6)
    if many:
        words = averaged(WORDS, words, segments((1 << 63) - 1), -(-many // SHARD), _word_blocks, sent, 0.025)
    if types:
        spelling = averaged(SPELLING, spelling, different, -(-types // (SHARD * 4)), _spelling_blocks, sent, 0.05)
    return Model(code, words, spelling, n, kinds)


def probable(counts: DataFrame, model: Model) -> DataFrame:
    """(word, n, p, cls, one, two): p is the log10 probability of a known word in its class; what the word is to the models. As a table."""
    sent = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            ids, sizes = spelled(batch.column(2))
            cls, one, two = model.codes(batch.column(0).to_numpy(), ids, sizes)
            p = model.in_class(cls, batch.column(1).to_numpy(), model.spell(cls, ids, sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), *(pa.array(x.astype(np.int16)) for x in (cls, one, two))], names=["word", "n", "p", "cls", "one", "two"])

    return materialize(counts.mapInArrow(run, "word long, n long, p double, cls short, one short, two short"), "words")


def score_texts(docs: DataFrame, held_out: Column, path: str = VOCABULARY, hot: int = 400_000, id_col: str = "doc_id", text: str = "text", warm: int = WARM) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document; the rest is learned from."""
    spark = docs.sparkSession
    learn = docs.where(~held_out)
    n_docs = learn.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_docs // 8000)
    got = gathered(learn, path, text, parts, F.xxhash64(id_col))
    counts = counted(got, parts)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + n_docs, distinct + (n_docs > 0)
    model = fit(got, counts, n_docs, path, warm)
    discard(got)
    words = probable(counts, model)
    discard(counts)
    # a count that at most `hot` words reach
    over, least = 0, 1 << 62
    for n, many in words.groupBy("n").agg(F.count("*")).orderBy(F.desc("n")).limit(hot).toLocalIterator():
        if over + many > hot:
            break
        over, least = over + many, n
    frequent = words.where(F.col("n") >= least).toPandas().sort_values("word")
    sent = spark.sparkContext.broadcast((model, *(frequent[c].to_numpy() for c in ("word", "n", "p", "cls", "one", "two")), n_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, n_known, p_known, *coded_known, n_docs = sent.value
        pieces, row = Pieces(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, some in chunks(batch.column(2)):
                t, m = Texts(some), len(some)
                h = t.hash.view(np.int64)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                there = known[at] == h if len(known) else np.zeros(len(h), bool)
                n = np.where(there, n_known[at], 0) if len(known) else np.zeros(len(h))
                p = np.where(there, p_known[at], 0.0) if len(known) else np.zeros(len(h))
                rare = np.flatnonzero(~there)  # of the others the table says what they are to the model
                ids, sizes = t.cut(rare, pieces)
                cls, first, last = (x[at].astype(np.int64) if len(known) else np.zeros(len(h), np.int64) for x in coded_known)
                cls[rare], first[rare], last[rare] = model.codes(h[rare], ids, sizes)
                begin = np.zeros(len(h) + 1, np.int64)
                begin[rare + 1] = sizes
                begin = np.cumsum(begin)
                of = np.repeat(np.arange(m), np.diff(t.at))
                base = np.bincount(of, np.log10(n + 1.0)[t.words], m) + math.log10(n_docs + 1)
                score = np.bincount(of, p[t.words], m) + model.context(t, cls, first, last)
                found = np.bincount(of, there[t.words], m).astype(np.int64) + (n_docs > 0)
                # other words wait for their counts; those of held-out texts may have none, so their pieces go along
                aside = ~there[t.words]
                pair, times = np.unique(of[aside] * max(1, len(h)) + t.words[aside], return_counts=True)
                doc, word = np.divmod(pair, max(1, len(h)))
                ends = np.append(0, np.cumsum(np.bincount(doc, minlength=m))).astype(np.int32)
                held = np.array(batch.column(1)[a : a + m].to_pylist(), bool)[doc]
                spelling = [ids[begin[w] : begin[w + 1]].astype(np.uint16).tobytes() if x else None for w, x in zip(word.tolist(), held.tolist(), strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (pa.array(h[word]), pa.array(times.astype(np.int64)), pa.array(spelling, pa.binary()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a : a + m], batch.column(1)[a : a + m], pa.array(np.arange(row, row + m)), pa.array(np.diff(t.at) + 1), pa.array(found), pa.array(base), pa.array(score), *lists],
                    names=["id", "held_out", "row", "tokens", "known", "base", "score", "rare_w", "rare_n", "rare_s"],
                )
                row += m

    inside = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text).alias("text"))
    schema = inside.select("id", "held_out").schema.add("row", "long").add("tokens", "long").add("known", "long").add("base", "double").add("score", "double")
    for name, kind in (("rare_w", T.LongType()), ("rare_n", T.LongType()), ("rare_s", T.BinaryType())):
        schema = schema.add(name, T.ArrayType(kind))
    scored = materialize(inside.mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare_w", "rare_n", "rare_s")).alias("x")).select("row", F.col("x.rare_w").alias("word"), F.col("x.rare_n").alias("times"), F.col("x.rare_s").alias("ids"))
    model_sent = spark.sparkContext.broadcast(model)

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_sent.value
        for batch in batches:
            ids, sizes = spelled(batch.column(2))
            cls = model.codes(batch.column(1).to_numpy(), ids, sizes)[0]
            p = model.in_class(cls, np.zeros(len(cls)), model.spell(cls, ids, sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p * batch.column(3).to_numpy())], names=["row", "p"])

    # words without a count add log10(1) = 0 to the base
    joined = rare.join(words.select("word", "n", "p"), "word", "left")
    joined = materialize(joined.select("row", "word", F.when(F.col("n").isNull(), F.col("ids")).alias("ids"), "times", (F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("base"), (F.col("times") * F.col("p")).alias("p"), F.when(F.col("n").isNotNull(), F.col("times")).alias("known")), "rare")
    new = joined.where("ids is not null").select("row", "word", "ids", "times").mapInArrow(unknown, "row long, p double")
    sums = joined.select("row", "base", "p", "known").unionByName(new, allowMissingColumns=True).groupBy("row").agg(F.sum("base").alias("more"), F.sum("p").alias("p"), F.sum("known").alias("also"))
    out = scored.select("id", "held_out", "row", "tokens", "known", "base", "score").join(sums, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", F.col("tokens").alias("n_tokens"), (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"), F.round(F.col("score") + F.coalesce("p", F.lit(0.0)), 4).alias("score"),
    )
