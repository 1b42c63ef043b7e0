"""Near duplicates and repeated windows against brute force."""

import hashlib
import re

import pytest

from larder.llm import neardup, substrings
from larder.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, component_id string, kept int"  # extra columns with clashing names


def passage(a, n):
    return [f"w{(a * 7919 + i * i * 31 + i) % 100003}" for i in range(n)]


@pytest.fixture(scope="module")
def docs():
    base, shared = passage(1, 120), passage(2, 60)
    rows = [(i, " ".join(base[:i] + ["x%d" % i] + base[i + 1:])) for i in range(40)]       # near copies
    rows += [(100 + i, " ".join(passage(50 + i, 30) + shared + passage(90 + i, 25))) for i in range(25)]  # common passage
    rows += [(200 + i, "Same words in every copy of this text, again and again.") for i in range(30)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "One"), (305, "a b c"), (306, "a b c d")]
    rows += [(310, " ".join(passage(7, 40) * 3)), (311, "é ß " * 50)]
    rows += [(None, "no id but Same words"), (None, None), (250, "Same words in every copy of this text, again and again."),
             (250, "Same words in every copy of this text, again and again.")]
    return rows


def sets(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    s = {d: sets(t, k) for d, t in rows if d is not None}
    root = {d: d for d in s}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s[d]), find(d)) for d in s}


@pytest.mark.parametrize("k, block", [(4, 256), (5, 4)])
def test_near_duplicates(spark, docs, k, block):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(3)
    got = neardup.near_duplicates(df, shingle=k, block=block).collect()
    assert len(got) == len(docs)
    want = brute_components(docs, k, 80)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_all_texts_of_an_id_are_linked(spark):
    texts = {i: " ".join(passage(i + 60, 40)) for i in range(1, 6)}
    rows = [(i, t) for i, t in texts.items()] + [(10, texts[1]), (10, texts[2]), (10, texts[3]), (11, texts[3]), (11, texts[3]),
                                                 (12, " ".join(passage(99, 30))), (12, " ".join(passage(98, 30))), (12, ""), (12, None)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(4)
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(df, shingle=4).collect())
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (10, 1), (10, 1), (10, 1), (11, 1), (11, 1)] + [(12, 12)] * 4)


def test_scratch_tables_are_deleted(spark):
    import os
    from larder.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).replace("file:", "")
    before = set(os.listdir(base))
    df = spark.createDataFrame([(i, " ".join(passage(i % 9, 40)), "x", 1) for i in range(60)], SCHEMA)
    assert neardup.one_of_each_group(df).count() == 9
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before} == {"stay"}


def test_members_that_the_head_does_not_cover_still_meet():
    """Blocks of a mixed bucket: pairs of different components only, once."""
    import numpy as np
    import pyarrow as pa
    n, rows = 8, 2
    sig = np.tile(np.arange(n, dtype=np.uint32), (6, 1))
    sig[3:, 2:] = 99  # three of one kind, three of another; all agree on band 0
    sets = [list(range(10))] * 2 + [list(range(1, 20))] + [list(range(30, 40))] * 3

    def run(side, one, comp):
        t = pa.record_batch([pa.array([1] * 6), pa.array(side, pa.int32()), pa.array([1, 2, 3, 4, 5, 6]), pa.array(comp),
                             pa.array([s.tobytes() for s in sig]), pa.array(sets, pa.list_(pa.int64())),
                             pa.array([one] * 6), pa.array([0] * 6, pa.int32())], names=list("abcdefgh"))
        bounds = neardup.least_matches(n, 4, 0.8, 1e-3)
        return sorted(p for b in neardup._within(n, rows, bounds, 80)(iter([t]))
                      for p in zip(*(c.to_pylist() for c in b.columns)))

    assert run([0, 0, 0, 1, 1, 1], False, [1, 2, 3, 4, 5, 6]) == []  # the sides share two of eight minima
    # 3 looks like 1 and 2 but its set doesn't; 5-6 is not needed once 4-5 and 4-6 are
    assert run([0] * 6, True, [1, 2, 3, 4, 5, 6]) == [(1, 2), (4, 5), (4, 6)]
    assert run([0] * 6, True, [1, 1, 3, 4, 4, 6]) == [(4, 6)]


def test_bounds_prune_at_the_chosen_miss_probability():
    from math import comb
    for n, m in neardup.least_matches(128, 16, 0.8, 1e-7):
        tail = lambda m: sum(comb(n + 1, j) * .8 ** j * .2 ** (n + 1 - j) for j in range(m + 1))
        assert tail(m) >= 1e-7 and (m == 0 or tail(m - 1) < 1e-7)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got.get(i, i) == 0 for i in range(1, 61)) and got[101] == 100 and 7 in got


def brute_repeats(rows, k):
    first, out = {}, []
    order = lambda d: (d is None, d or 0)
    for d, t in sorted(rows, key=lambda r: order(r[0])):
        w = WORD.findall(t or "")
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i:i + k]), (order(d), i))
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i:i + k])] < (order(d), i) for j in range(i, i + k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else t or ""))
    return out


@pytest.mark.parametrize("range_bytes, chunk", [(24 << 20, 4 << 20), (500, 3000)])
def test_repeats(spark, docs, range_bytes, chunk, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(3)
    got = substrings.remove_repeats(df, 20, with_text=True, range_bytes=range_bytes).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got), key=key) == \
        sorted(brute_repeats(docs, 20), key=key)
    for r in got:  # maximal, apart, in order
        spans = [(s.start, s.end) for s in r.intervals]
        assert sum(b - a for a, b in spans) == r.n_removed
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
