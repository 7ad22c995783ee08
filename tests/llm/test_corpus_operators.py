"""The corpus operators against brute force, exact round trips and held-out accuracy, on small tables."""

import binascii
import collections
import hashlib
import math
import random
import re
import textwrap
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.llm import attention, decontam, entry, html, langid, licenses, lm, mixing, ngram_join, quality, token_counts, warc
from colonnade.llm.common import shared_dir

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_docs():
    """Nulls in every column, empty and blank texts, repeated rows, a long text and ties."""
    long_ = " ".join(f"word{i % 997} more{i % 13}" for i in range(20_000))
    return [
        (1, "alpha beta gamma delta", "en", "a", 22), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", None, "b", 4),
        (None, "alpha beta gamma delta", "en", "a", 22), (1, "alpha beta gamma delta", "en", "a", 22), (5, long_, "en", None, len(long_)),
        (6, long_ + " x", "en", "b", None), (7, "123 456 !!!", "de", "b", 11), (8, "one", "en", "b", 3), (9, "ÄÖ é\x1f\x85x y", "de", "a", 9),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns with names that the operators use themselves
    return spark.createDataFrame(odd_docs(), DOCS).withColumns({"n_words": F.lit("clash"), "kept": F.lit("clash"), "row": F.lit(1), "size": F.lit(2), "key": F.lit(3)})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def brute_join(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def varied(seed=3, groups=12, copies=14):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 5, 12, 60, 300]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25) + 1)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(400)}"
            rows.append((len(rows) * 7 % 1009, (" ".join(text)).upper() if rng.random() < 0.2 else " ".join(text)))
    return rows


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, n, percent):
    rows = varied() + [(r[0], r[1]) for r in odd_docs()]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), n, percent, keep=["doc_id"]).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute_join(rows, n, percent)


def test_join_keeps_columns_and_empty_table(spark, odd):
    out = ngram_join.join(odd)
    assert out.columns == [*odd.columns, "n_shingles", "set_key", "component_id"] and out.count() == odd.count()
    assert ngram_join.join(odd.limit(0)).count() == 0


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(2)
    for _ in range(60):
        center = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(8)] + [center, center[1:]]
        for percent in (50, 80, 90):
            want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, center)) >= percent * len(np.union1d(s, center))]
            assert sorted(ngram_join.divide_skip(center, sets, percent)) == want


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_share_a_short_list(percent):
    rng = np.random.default_rng(5)
    for _ in range(300):
        order = rng.integers(0, 4, ngram_join.COUNTERS).astype(np.uint8)  # any order will do
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400)).astype(np.uint64))
        b = a[rng.random(len(a)) > (1 - percent / 100) / 2.2]
        b = np.unique(np.concatenate((b, rng.integers(0, 1 << 62, rng.integers(0, 3)).astype(np.uint64))))
        if len(b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            assert len(np.intersect1d(ngram_join.short_lists(a, order, percent), ngram_join.short_lists(b, order, percent)))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_join_of_a_large_loose_group(spark, monkeypatch, n, percent):
    # variants of one text that link with some of the others only, and more of them than a cell holds
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(n)
    base, rows = [f"w{rng.randrange(300)}" for _ in range(120)], []
    for i in range(160):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = f"v{rng.randrange(40)}"
        rows.append((1000 - i, " ".join(text[: rng.choice([120, 120, 118, 112, 105])])))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), n, percent, keep=["doc_id"]).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute_join(rows, n, percent)


def test_join_of_lists_that_many_sets_of_a_task_are_on(spark):
    # one rare passage in many short texts: more entries of a task on its lists than go to a range
    rows = [(i, f"q1 q2 q3 q4 q5 q6 q7 a{i} b{i}") for i in range(40)] + [(40 + i, f"q1 q2 q3 q4 q5 q6 q7 a{i} c{i}") for i in range(40)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 3, 70, keep=["doc_id"]).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute_join(rows, 3, 70)


def lm_check(rows, got):
    held = {i: binascii.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for i, (d, _) in enumerate(rows)}
    tokens = [[*WORD.findall(lower(t)), None] for _, t in rows]
    c = collections.Counter(w for i, ts in enumerate(tokens) if not held[i] for w in ts)
    total = sum(c.values())
    want = []
    for i, (d, _) in enumerate(rows):
        base = sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in tokens[i])
        want.append((d, held[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), total, base))
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("hot", [400_000, 40])
def test_lm_base_equals_brute_force(spark, documents, hot):
    rows = [(r[0], r[1]) for r in odd_docs()] + [tuple(r) for r in documents.select("doc_id", "text").limit(60).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from colonnade.llm.common import bucket

    got = lm.score_texts(df, bucket(F.col("doc_id"), 7) == 2, hot=hot, warm=20)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.collect()
    lm_check(rows, [tuple(r)[:6] for r in got])
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_lm_edge_tables(spark):
    from colonnade.llm.common import bucket

    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(empty, bucket(F.col("doc_id"), 7) == 2).count() == 0
    # all held out: nothing is learned
    r = lm.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (r["n_known"], r["train_tokens"], r["n_tokens"]) == (0, 0, 3) and r["base_score"] == 0 and r["score"] < 0


def test_lm_scores_do_not_depend_on_the_order_of_rows(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    from colonnade.llm.common import bucket

    both = []
    for some in (rows, random.Random(1).sample(rows, len(rows)), rows):
        df = spark.createDataFrame(some, "doc_id long, text string").repartition(len(both) + 2)
        both.append({r["doc_id"]: r["score"] for r in lm.score_texts(df, bucket(F.col("doc_id"), 7) == 2, hot=500, warm=40).collect()})
    for other in both[1:]:
        assert all(math.isclose(x, other[k], rel_tol=1e-5) for k, x in both[0].items())


def test_attention_gradient_distribution_and_windows():
    rng = np.random.default_rng(0)
    net = attention.Net(30, 9, 4, 5)
    flat = net.initial(np.full(9, 1 / 9)).astype(np.float64)
    n = np.array([3, 1, 9, 4])
    one, two, target = (rng.integers(0, k, int(n.sum())) for k in (30, 30, 9))
    data = net.blocks(n, one, two, target)
    assert len(data[0]) == 6 and data[3].sum() == n.sum()
    at = np.arange(6)
    _, g = net.gradient(flat, data, at)
    for i in [*rng.integers(0, net.size, 30), *np.argsort(-np.abs(g))[:30]]:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert abs((net.gradient(up, data, at)[0] - net.gradient(down, data, at)[0]) / 2e-5 - g[i]) < 1e-4
    # each target is scored once, alike alone and with others, and the classes of any place sum to 1
    flat = flat.astype(np.float32)
    together = net.log10(flat, data, step=2)
    alone = np.concatenate([net.log10(flat, net.blocks(np.array([len(x)]), x, y, z)) for x, y, z in zip(*(np.split(v, np.cumsum(n)[:-1]) for v in (one, two, target)), strict=True)])
    assert len(together) == n.sum() and np.allclose(together, alone, atol=1e-5)
    for last in (0, 3, 5, 8):
        p = [10 ** net.log10(flat, net.blocks(np.array([9]), one[4:13], two[4:13], np.where(np.arange(9) == last, c, target[4:13])))[last] for c in range(9)]
        assert abs(sum(p) - 1) < 1e-4
    # what comes later changes nothing
    changed = one.copy()
    changed[4 + 6] = (changed[4 + 6] + 1) % 30
    assert np.allclose(net.log10(flat, net.blocks(n, changed, two, target))[: 4 + 6], together[: 4 + 6], atol=1e-5)


def test_lm_spellings_are_a_distribution(spark, documents):
    rng = np.random.default_rng(3)
    top = np.arange(5)
    code = lm.codes(rng.integers(0, 9, 400), 200, top, rng.integers(0, 50, (400, 5)).astype(float))
    model = lm.Model(code, lm.WORDS.initial(np.ones(lm.CLASSES)), lm.SPELLING.initial(np.ones(lm.PIECE_CLASSES)), np.zeros(lm.CLASSES), np.zeros(lm.CLASSES))
    # all pieces that may follow two others, and the end after them: those of longer spellings count as what is left
    ids = np.array([[3, 7, x] for x in range(400)]).ravel()
    cls = np.full(401, 70)
    *data, share, ends = code.spelling(cls, np.append(ids, [3, 7]), np.array([3] * 400 + [2]))
    each = lm.SPELLING.log10(model.spelling, tuple(data)) + share
    p = [10 ** each[e - 1] for e in ends[:-1]] + [10 ** each[ends[-1]]]
    assert abs(sum(p) - 1) < 1e-3


def test_lm_learns(spark):
    from colonnade.llm.common import bucket

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = lm.score_texts(docs, bucket(F.col("doc_id"), 7) == 2).groupBy("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("score"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")).collect()
    got = {r["held_out"]: (r["score"], r["base"]) for r in got}
    assert got[False][0] > got[False][1] and got[True][0] > -4.6


def test_token_counts_equal_the_library(documents):
    tokenizers = pytest.importorskip("tokenizers")
    vocab = token_counts.vocabulary()
    lib = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", min(s for _, s in vocab)), *vocab], unk_id=0, byte_fallback=False))
    fused, plain = token_counts.Counter(vocab, fuse=True), token_counts.Counter(vocab)
    texts = [r[0] for r in documents.select("text").limit(60).collect()] + [t for _, t, *_ in odd_docs() if t and len(t) < 1000] + ["日本 語\n\n  x", "▁ a▁b ▁▁"]
    for t in texts:
        marked = token_counts.MARK + t.replace(" ", token_counts.MARK)
        assert fused(t) == len(lib.encode(marked).tokens)
        assert plain(t) == plain.path(marked)[1]


def test_token_counts_on_odd_rows(spark, odd):
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(odd, keep=["doc_id"]).collect()}
    assert got[2] == 0 and got[3] == 0 and got[4] > 0
    assert token_counts.count_tokens(odd).columns == [*odd.columns, "n_tokens"]
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = collections.Counter(windows)
    repeat = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat)


def test_quality_counts_equal_brute_force(documents):
    texts = [r[0] for r in documents.select("text").collect()] + [r[1] for r in odd_docs()] + ["a b c d e f g h " * 3, "x\nx\n \n \nx"]
    for t in texts:
        assert quality.statistics((t or "").encode())[:5] == brute_quality(t)


def test_quality_rules_learn(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(documents, labels)
    out = quality.judge(documents, rules, ["doc_id"]).join(labels, "doc_id").toPandas()
    assert rules.rules and (out[out.quality == 1].query("not base_failed").kept).mean() > 0.95
    assert (~out[out.quality == 0].kept).mean() > 0.7
    assert ((out.n_words < 20) | (100 * out.n_repeat_words > 30 * out.n_words)).equals(out.base_failed)


def test_quality_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = quality.fit(odd, none)
    assert not rules.rules
    out = {r["doc_id"]: r for r in quality.judge(odd, rules, ["doc_id"]).collect()}
    assert out[2]["base_failed"] and not out[3]["kept"] and out[2]["n_words"] == 0
    assert quality.fit(odd, spark.createDataFrame([(None, 0, None), (5, None, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")).rules == []
    assert quality.judge(odd.limit(0), rules, ["doc_id"]).count() == 0


def test_learned_lists_are_ordered_and_precise():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.5) | (x["c"] > 0.95)
    rules = quality.learn(x, bad).rules
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= r.holds(x)
    assert len(rules) >= 2 and bad[hit].mean() > 0.95 and hit[bad].mean() > 0.85


def test_warc_round_trip(spark):
    same = "<p>" + "x" * 200
    rows = [(3, "http://a/1", same), (1, "http://a/2", same), (2, None, "short"), (4, "http://b\r\nX: y", "short"), (5, "u", None), (5, "u", None), (None, "n", same), (9, "é", "ü" * 60), (1, "http://a/2", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = f"{shared_dir(spark)}/round"
    warc.write(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    back = warc.read(spark, path).collect()
    assert len(back) == len(rows)
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"], r["payload_digest"]) for r in back)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = h == same and i != 1
        want.append((str(i), "revisit" if revisit else "response", "1" if revisit else "None", len(b), hashlib.sha256(b).hexdigest()))
    assert got == sorted(want)
    data = b"".join(bytes(r["record"]) for r in back)
    parsed = list(warc.parse(data))
    assert len(parsed) == len(rows)
    for fields, body in parsed:
        if fields["WARC-Type"] == "response":
            assert "sha256:" + hashlib.sha256(body).hexdigest() == fields["WARC-Payload-Digest"]


def test_warc_finds_damage(spark):
    path = f"{shared_dir(spark)}/damaged"
    warc.write(spark.createDataFrame([(1, "u", "<b>")], "page_id long, url string, html string"), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("<i>"), "UTF-8")).collect()
    spark.createDataFrame(bad).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(spark, path).collect()


def test_warc_query_checks_rebuilt_records(spark, monkeypatch):
    real = warc.write

    def damaged(pages, path):
        real(pages, path)
        rows = spark.read.parquet(f"{path}/headers").collect()
        bad = [(r["digest"], bytes(r["header"]).replace(b"Content-Length: ", b"Content-Length: 1")) for r in rows]
        spark.createDataFrame(bad, "digest string, header binary").write.mode("overwrite").parquet(f"{path}/headers")

    monkeypatch.setattr(warc, "write", damaged)
    with pytest.raises(Exception, match="damaged record"):
        entry.op5_warc(spark, DATA).collect()


def test_warc_empty(spark):
    path = f"{shared_dir(spark)}/empty"
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


def test_language_held_out(spark):
    out = entry.op6_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = out.where("held_out").join(docs, "doc_id").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.97 and held.score.between(0, 1).all()


def test_language_edges(spark, odd):
    assert {r["lang_pred"] for r in langid.identify(odd, None, ["doc_id"]).collect()} == {"und"}
    model = langid.fit(odd)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, model, ["doc_id"]).collect()}
    assert out[2] == out[3] == out[4] == out[7] == ("und", 0.0) and out[5][0] == "en"
    one = langid.fit(odd.where("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.identify(odd, one, ["doc_id"]).collect()} == {"und", "en"}
    assert langid.fit(odd.limit(0)) is None and langid.identify(odd.limit(0), model, ["doc_id"]).count() == 0


def edit_distance_within(item, text):
    """Least edits between item and any region of text."""
    row = np.zeros(len(text) + 1, np.int64)
    lane = np.arange(len(text) + 1)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(new - lane) + lane
    return int(row.min())


def test_decontamination_equals_brute_force(spark, documents):
    rng = random.Random(4)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").limit(12).collect()] + [(100, None), (101, "zq"), (102, ""), (103, "qx wvz"), (104, "short exam item"), (105, "what is the cube of 12"), (106, "the sum of 17 and 25 equals 42")]
    docs = [(r["doc_id"], r["text"]) for r in documents.where("n_chars < 1500").limit(40).collect()]
    for j in range(40):
        item = list(rng.choice(bench[:12])[1])
        for _ in range(rng.randrange(0, len(item) // 7)):
            at = rng.randrange(len(item))
            item[at : at + rng.randrange(2)] = rng.choice(["", "x", "é", "qq"])
        docs.append((1000 + j, f"some words before {''.join(item)} and after"))
    docs += [(3000, "aaa qx wvz bbb"), (3001, "one sh0rt exam item here"), (3002, "two sh0rt exam itm here"), (3003, "so wha is the cub of 12 again"), (3004, "the sam of 17 end 25 equal 42 !"), (3005, "the sam of 17 end 25 equal 4 !")]
    docs += [(None, bench[0][1]), (2000, bench[1][1].upper()), (2001, None), (2002, "")]
    want = set()
    for d, t in docs:
        for i, b in bench:
            a, x = decontam.normalise(t or ""), decontam.normalise(b or "")
            if len(x) >= 4 and len(a):
                k = len(x) // 10
                e = edit_distance_within(x, a)
                if e <= k:
                    want.add((d, i, e))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start", F.lit("clash"))
    bench_df = spark.createDataFrame(bench, "item_id long, text string")
    got = decontam.find(df, bench_df)
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in got.collect()} == want and len(want) > 20
    small = decontam.find(df, bench_df, block_chars=600)
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in small.collect()} == want
    flagged = decontam.flag(df, bench_df, block_chars=600)
    assert flagged.columns == [*df.columns, "n_items"]
    assert {r["doc_id"] for r in flagged.where("n_items > 0").collect()} == {d for d, _, _ in want}


def test_decontamination_empty(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find(odd, none).count() == 0 and decontam.flag(odd, none).where("n_items = 0").count() == odd.count()


def test_targets():
    got = mixing.targets([("b", 100), (None, 100), ("a", 100)])
    assert [s for s, _, _ in got] == ["a", "b", None] and [round(t) for _, _, t in got] == [50, 100, 150]
    capped = mixing.targets([("a", 1000), ("b", 1000), ("c", 10)])
    assert capped[2][2] == 30 and abs(sum(t for *_, t in capped) - 2010) < 1e-6
    assert mixing.targets([("a", 0), ("b", 0)])[0][2] == 0


def test_mixing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(docs, keep=["doc_id", "source"])
    got = out.toPandas()
    again = mixing.mix(docs.repartition(7), keep=["doc_id", "source"]).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).to_numpy().tolist() == again[key].sort_values(key).to_numpy().tolist()
    assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1
        assert g.source_size.iloc[0] == g["size"].sum()


def test_mixing_equals_sorting(spark, documents):
    docs = documents.select("doc_id", "text", "source")
    docs = docs.union(docs.where("doc_id % 5 = 0"))
    rows = docs.select("doc_id", F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).alias("size"), mixing._uniform(F.lit(20), F.col("doc_id"), F.col("source"), F.col("text")).alias("u")).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want = collections.Counter()
    for source, size, target in mixing.targets(list(sizes.items())):
        own = [r for r in rows if r["source"] == source]
        whole = min(3, int(target / size + 1e-12)) if size else 0
        rest = max(0.0, target - whole * size)
        power = sum(r["size"] ** 1.25 for r in own)

        def rank(r, rest=rest, power=power):
            p = min(max(rest / power * r["size"] ** 0.25, 1e-12), 1 - 1e-9)
            return (r["u"] / (1 - r["u"])) / (p / (1 - p)), r["size"]

        upto = 0
        for r in sorted(own, key=rank):
            upto += r["size"]
            extra = rest > 0 and whole < 3 and (upto <= rest or upto - rest < rest - (upto - r["size"]))
            want[r["doc_id"], (whole + extra) * r["size"]] += 1
    assert want == collections.Counter((r["doc_id"], r["taken"]) for r in mixing.mix(docs, keep=["doc_id"]).collect())


def test_mixing_edges(spark, odd):
    out = mixing.mix(odd, keep=["doc_id"])
    got = out.collect()
    assert len(got) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(odd.drop("size")).columns[: len(odd.columns) - 1] == odd.drop("size").columns


def test_license_scan(spark):
    grant, notice, warranty, liability = (licenses.SENTENCES[i] for i in (10, 11, 12, 13))
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nEnd."), (2, f"{grant}\n\n{notice}\n\n{warranty} {liability}"), (3, f"{grant} {notice}"), (4, "No license is given here. permission"),
        (5, None), (6, ""), (7, "licensed  under the APACHE license, version 2.0!\nLicensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."), (7, "x licensed under the Apache License, Version 2.0."), (None, "Released under the MIT License."),
        (8, " ".join(licenses.SENTENCES[i] for i in (5, 6, 7, 8, 9))), (9, licenses.SENTENCES[14] + "\n" + licenses.SENTENCES[16]),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = sorted((str(r["doc_id"]), r["license"], r["n_hits"], r["first_sentence"]) for r in licenses.scan(df).collect())
    assert got == [("1", "MIT", 1, 2), ("2", "MIT", 1, 1), ("3", "MIT", 1, 1), ("7", "Apache-2.0", 1, 1), ("7", "CC-BY-NC-4.0", 2, 2), ("8", "Apache-2.0", 1, 1), ("9", "GPL-3.0-or-later", 1, 1), ("None", "MIT", 1, 1)]
    con = duckdb.connect()
    con.register("documents", df.drop("license").toPandas())
    assert sorted((str(r[0]), *r[1:]) for r in con.sql(licenses.oracle()).fetchall() if r[0] is not None and r[0] == r[0]) == sorted((str(float(r["doc_id"])), r["license"], r["rule"], r["n_hits"], r["first_sentence"]) for r in licenses.scan(df).collect() if r["doc_id"] is not None)
    assert licenses.scan(df.limit(0)).count() == 0


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r["doc_id"], r["license"], r["rule"], r["n_hits"], r["first_sentence"]) for r in licenses.scan(df).collect())


def test_license_identifiers_and_versions(spark, monkeypatch):
    names = ["Apache-2.0", "MIT", "GPL-3.0-only", "BSD-3-Clause", "LGPL-2.1-only", "MIT-0"]
    texts = [f"x\n// SPDX-License-Identifier: {n}\ncode" for n in [*names, "No-Such-1.0"]]
    texts += [licenses.SENTENCES[15].replace("version 2", "version 9"), "This is licensed under the MIT License.", "(This project is released under the terms of the Apache License 2.0.)", "Licensed under GPLv3\nrest", "<!-- SPDX-License-Identifier: MIT --> text"]
    got = [r[:2] + r[3:] for r in scanned(spark, texts)]
    assert got == [*((i, n, 1, 2) for i, n in enumerate(names)), (8, "MIT", 1, 1), (9, "Apache-2.0", 1, 1), (10, "GPL-3.0-only", 1, 1)]
    monkeypatch.setitem(licenses.SENTENCES, 99, licenses.SENTENCES[5].upper())
    with pytest.raises(ValueError, match="known twice"):
        licenses.patterns()


def test_license_sentences_over_several_lines(spark):
    def wrapped(numbers, mark="", width=70, between="\n"):
        return between.join(textwrap.fill(licenses.SENTENCES[i], width, initial_indent=mark, subsequent_indent=mark) for i in numbers)

    apache = """/*
 * Copyright 2020 Someone
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""
    bsd = "\n".join([wrapped([17]), "1. " + wrapped([18]), "(2) " + wrapped([19]), "* " + wrapped([20])])
    texts = [
        apache, "The MIT License\n\n" + wrapped((10, 11, 12, 13), "# ", between="\n#\n"), bsd, wrapped((14, 16), "// ", 40), "LICENSE\nReleased under the MIT License\nthanks",
        "a\r\nLicensed under the\r\nMIT License.\r\nb", "Licensed under the Apache License, Version 2.0\nor later", "not licensed under the\nMIT License",
    ]
    got = [r[:2] + r[3:] for r in scanned(spark, texts)]
    assert got == [(0, "Apache-2.0", 1, 2), (1, "MIT", 1, 2), (2, "BSD-3-Clause", 1, 1), (3, "GPL-3.0-or-later", 1, 1), (4, "MIT", 1, 2), (5, "MIT", 1, 2), (6, "Apache-2.0", 1, 1)]


def test_every_known_license_sentence_has_an_anchor():
    for sentence in licenses.SENTENCES.values():
        assert any(a in sentence.lower() for a in licenses.ANCHORS), sentence


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=/x>menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><h1>A &amp; B</h1><p><b>One&nbsp;two<br><p>Three
  four &lt;tag&gt; &#233;&unknown;</p><div class="share-buttons">Share</div><ul><li>i<li>j</ul><form>f</form>
<p>shared passage</p><section id="comments"><p>I like it</p></section></article><aside>side</aside><footer>&copy; foot</footer></body></html>"""


def test_html_text():
    assert html.text_of(html.tree(PAGE)) == "A & B\n\nOne two\n\nThree four <tag> é&unknown;\n\ni\n\nj\n\nshared passage"
    assert html.text_of(html.tree("just text &amp; more")) == "just text & more"
    assert html.text_of(html.tree("")) == "" and html.text_of(html.tree("<p>a<p>b</div>c")) == "a\n\nbc"
    assert html.text_of(html.tree("<div>" * 5000 + "deep" + "</div>" * 5000)) == "deep"


@pytest.mark.parametrize(("page", "want"), [
    ('<article><p title="hidden treasure">Kept text</p></article>', "Kept text"), ('<article><p>a <a href="/x/hidden/y">b</a> <a href="/p?id=nav">c</a></p></article>', "a b c"),
    ('<article><div data-id="sidebar">kept</div><div id=sidebar>gone</div></article>', "kept"), ('<article><section id="related-work"><h2>Related work</h2></section></article>', "Related work"),
    ("<article><div class='x comment-list'>gone</div><p hidden>gone</p><p aria-hidden=true>gone</p><p aria-hidden=false>kept</p></article>", "kept"),
    ("<article><header><h1>Title</h1></header><p>a</p><footer>gone</footer></article>", "Title\n\na"), ("<p>a</p><div class='site-header'>gone</div><div class='my-sidebar-x'>gone</div>", "a"),
    ("<article>a</article>" + "<div>" * 450 + "menu" + "</div>" * 450, "a"), ("<div>" * 3000 + "<article><p>a</p>b</article>" + "</div>" * 3000 + "c", "a\n\nb"), ("<p class=a/b id=nav>gone</p>x", "x"),
])
def test_html_attributes_and_depth(page, want):
    assert html.text_of(html.tree(page)) == want
    assert len(list(html.candidates(html.tree(page)))) < 4000


class PlainText(HTMLParser):
    """The main text of well-formed pages by the standard library's parser, without templates."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.off, self.blocks, self.run = 0, 0, [], []

    def flush(self):
        said = " ".join("".join(self.run).split())
        self.blocks += [said] * bool(said)
        self.run = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if self.inside and tag == "br":
            self.run.append(" ")
        elif self.off or tag in ("nav", "footer", "aside", "form", "script", "style") or dict(attrs).get("class") == "ad":
            self.off += 1
        elif tag not in ("a", "b"):
            self.flush()

    def handle_endtag(self, tag):
        self.off -= self.off > 0
        if tag not in ("a", "b"):
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.off:
            self.run.append(data)


def test_html_equals_another_parser(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in entry.op10_html_text(spark, DATA).collect()}
    for r in pages.collect():
        if r["html"] and "<article" in r["html"]:
            p = PlainText()
            p.feed(r["html"])
            p.close()
            assert got[r["page_id"]] == "\n\n".join(p.blocks), r["html"][:600]


def test_html_template(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div class=top><span>Our site {'' if i else '!'}</span></div><div><p>Text number {i}</p><p>the same passage</p></div><div>Call us <i>now</i></div></body>") for i in range(20)]
    pages += [(100, None, None), (101, "x", "<p>alone</p>"), (102, "http://o.example/", "<article><p>only</p></article>")]
    pages += [(200 + i, "http://copies.example/", "<div><p>all pages are equal</p></div>") for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(df, keep=["page_id", "url"]).collect()}
    assert got[5] == ("Text number 5\n\nthe same passage", len("Text number 5\n\nthe same passage"))
    assert got[100] == ("", 0) and got[101][0] == "alone" and got[102][0] == "only" and got[203][0] == "all pages are equal"
    assert html.extract(df.drop("text").limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op5_warc", "op9_license_scan"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.sql(entry.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = entry.QUERIES[name](spark, DATA).select(columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(r) for r in con.sql(f"select {', '.join(columns)} from want").fetchall())
