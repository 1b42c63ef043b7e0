"""Phrase mining, top-k search and lexical search against brute force."""

import collections
import math
import re

import numpy as np
import pytest

from larder.llm import collocations, lexical, topk
from larder.llm.common import key_filter, passes

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TEXT = "doc_id long, text string, lang string, phrase string, n int, `a.b` string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TEXT).repartition(3)


def vocabulary_text(rng, n):
    """Words from a small vocabulary with stops, tabs and capitals."""
    gaps = np.array([" ", " ", " ", " ", "\t", "  ", ". ", "\n", ",", "! "])
    words = np.array(["New", "york", "city", "the", "THE", "of", "hall", "é", "x1"])
    return "".join(w + g for w, g in zip(rng.choice(words, n, p=[.2, .2, .1, .1, .1, .1, .1, .05, .05]), rng.choice(gaps, n)))


def brute_collocations(rows, least, longest, top):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if a >= least and len(p) >= 2}
        inside = lambda p, q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
        scored = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and inside(p, q) for q, b in cand.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                        for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shards, chunk, words", [(16, 16 << 20, 1 << 21), (3, 300, 40), (1, 2000, 5)])
def test_collocations(spark, shards, chunk, words):
    rng = np.random.default_rng(5)
    rows = [(i, vocabulary_text(rng, 40), [None, "en", "de", "und"][i % 4]) for i in range(60)]
    rows += [(99, "very hot phrase here. " * 40, "en"), (99, "very hot phrase here. " * 40, "en"), (None, None, "en"),
             (1, "", None), (2, " .\t,\n", "fr"), (3, "A b", "it"), (4, vocabulary_text(rng, 3000), "de")]
    got = collocations.collocations(table(spark, rows), 8, 5, 30, shards=shards, chunk_bytes=chunk, range_words=words)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 8, 5, 30)


def test_shards_miss_no_phrase_that_is_frequent_only_in_the_sum(spark):
    rows = [(i, "rare pair", "en") for i in range(10)] + [(50 + i, f"w{i} v{i}", "en") for i in range(10)]
    df = table(spark, rows).repartition(20)
    for shards in (1, 4, 20):
        got = collocations.collocations(df, 10, shards=shards).collect()
        assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got] == [("rare pair", 10, 10, 10, 40, 4000)]


def test_products_beyond_64_bits(spark):
    big = spark.createDataFrame([("en", 1, "a", 9 * 10**15), ("en", 1, "b", 8 * 10**15), ("en", 2, "a b", 7 * 10**15),
                                 ("en", 0, "", 9 * 10**18)], "lang string, n_words int, phrase string, f long")
    keep, collocations.phrase_counts = collocations.phrase_counts, lambda *a: big
    try:
        row = collocations.collocations(big).first()
    finally:
        collocations.phrase_counts = keep
    assert row.score == 1000 * 7 * 10**15 * 9 * 10**18 // (72 * 10**30)


def test_key_filter_says_no_wrong_no(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as h")
    bits = key_filter(keys, "h")
    h = np.array([r.h for r in keys.collect()], np.int64).view(np.uint64)
    other = np.array([r.h for r in spark.range(10000, 30000).selectExpr("xxhash64(id) as h").collect()], np.int64)
    assert passes(bits, h).all() and passes(bits, other.view(np.uint64)).mean() < 0.02
    assert not passes(key_filter(keys.limit(0), "h"), h).any()


VECTOR = "vec_id long, embedding array<float>, norm string, q int"


def brute_top(rows, k, every):
    scaled = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(256 * float(np.float32(x))) for x in v]
            if max(map(abs, v)) <= topk.LARGEST:
                scaled.append((i, v))
    out = []
    for i, v in scaled:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in scaled if j != i and len(w) == len(v))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, group", [(8192, 2048), (16, 3)])
def test_top_k(spark, block, group):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8))
    v[50:120] = v[3] + rng.normal(scale=.02, size=(70, 8))       # a cluster
    v[120:150] = v[7]                                            # copies
    v[150:170] *= rng.lognormal(sigma=2, size=(20, 1))           # many lengths
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(200, [0.0] * 8), (210, [-1e-4] * 8), (500, None), (510, []), (520, [1.0, None]), (530, [float("nan")] * 8),
             (540, [float("inf")] * 8), (550, [1.0, 2.0]), (560, [1.0, 2.5]), (None, [1.0] * 8), (7, rows[7][1]),
             (570, [1e9] * 8), (580, [9e4] * 8), (590, [-9e4] * 8), (600, [0.5])]
    df = spark.createDataFrame([(i, x, "x", 1) for i, x in rows], VECTOR).repartition(3)
    got = topk.top_k(df, 5, every=10, block=block, group=group)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5, 10)


def test_both_prunings_are_used_and_exact(spark):
    """In a block with a tight cluster the coordinate list is chosen for the
    cluster's queries, the length for the others."""
    import pyarrow as pa
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 8)) * 100
    v[:40] = v[0] + rng.normal(size=(40, 8))
    v = np.floor(1000 * v / np.sqrt((v ** 2).sum(1))[:, None]).astype(np.int32)
    norm = np.sqrt((v.astype(float) ** 2).sum(1))
    lists = pa.array(v.tolist(), pa.list_(pa.int32()))
    rows = pa.table({"vec_id": pa.array(range(3000)), "v": lists, "norm": norm})
    ask = [*range(0, 40, 4), *range(100, 160)]
    exact = v.astype(np.int64) @ v.T.astype(np.int64)
    kth = [float(np.sort(np.delete(exact[i], i))[-5]) for i in ask]
    queries = pa.table({"q": pa.array(ask), "vec_id": pa.array(ask), "v": lists.take(pa.array(ask)), "norm": norm[ask],
                        "threshold": pa.array(kth)})
    used, keep = [], topk._Block.list_range
    topk._Block.list_range = lambda self, c, at, cosine: used.append(cosine) or keep(self, c, at, cosine)
    try:
        got = topk._search(5)((pa.scalar(8),), queries, rows).to_pylist()
    finally:
        topk._Block.list_range = keep
    assert 10 <= len(used) < len(ask)
    for i in ask:
        want = sorted((-int(exact[i, j]), j) for j in range(3000) if j != i)[:5]
        assert sorted((-r["score"], r["vec_id"]) for r in got if r["q"] == i)[:5] == want


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_lexical(docs, items, top):
    bags = [(d, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for d, t, *_ in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        terms = TERM.findall((text or "").translate(LOWER))
        scored = []
        for d, b, n in bags:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                        for t in terms if b[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r, None if no_id else d, -s) for r, (s, no_id, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("classes, block", [(8192, 1024), (7, 2)])
def test_lexical_search(spark, classes, block):
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(60)] + ["É", "Ab9", "x_y", "the"])
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 40))), "en") for i in range(120)]
    rows += [(200 + i, "the W1 copy, THE w2", "en") for i in range(30)]               # one class of many
    rows += [(300 + i, "w1 w2 other%d words%d the the copy" % (i, i), "en") for i in range(15)]  # equal in items' terms
    rows += [(None, "w3 w4", "en"), (None, None, "en"), (7, "", "en"), (8, " .,", "en"), (8, "w5 w5", "en"), (8, "w5 w5", "en")]
    items = [(1, "w1 the w2 w2"), (2, "É ab9 x y nowhere"), (3, None), (4, ""), (None, "w3"), (5, "w5"), (5, "w4 W5"),
             (6, "nothing matches"), (7, "the copy")]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = lexical.lexical_search(table(spark, rows), asked, 10, class_block=classes, item_block=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute_lexical(rows, items, 10)


def test_empty_tables(spark):
    none = table(spark, [(1, "x", "en")]).limit(0)
    assert collocations.collocations(none).count() == 0
    assert topk.top_k(spark.createDataFrame([], VECTOR)).count() == 0
    some = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.lexical_search(none, some).count() == 0
    assert lexical.lexical_search(table(spark, [(1, "x", "en")]), some.limit(0)).count() == 0
