"""The other operators: brute force, round trips, held-out accuracy, odd rows."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import chat, decontam, hostrules, licenses, packing, quality, sharding, substrings, toxicity
from larder.llm.common import read_table

from conftest import SF_SMALL

ODD = [(1, None, "s"), (2, "", "s"), (None, "no id", None), (None, None, None), (4, " \n\t", "s"), (5, "é ß 漢字 " * 3000, "s"),
       (6, "twice", "t"), (6, "twice", "t")]
SCHEMA = "doc_id long, text string, source string, shard int, score string, kept int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "x", 1) for r in ODD], SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return read_table(spark, SF_SMALL, "documents")


def brute_shards(rows, shards):
    total, at, out = sum(r.size for r in rows), 0, {}
    for r in rows:
        out[r.doc_id] = min(shards - 1, (2 * at + r.size) * shards // (2 * total))
        at += r.size
    return out


def test_shards_are_equal_stretches_of_the_key_order(spark, documents):
    hot = documents.select("doc_id", "text").union(spark.range(1000, 1200).selectExpr("id", "'the same text' as text"))
    got = sharding.shard(hot, 7).collect()
    rows = sharding.records(hot).orderBy("key", "doc_id").collect()
    assert {r.doc_id: r.shard for r in got} == brute_shards(rows, 7)
    text = {r.doc_id: r.text for r in hot.collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r["size"] == len(text[r.doc_id].encode()) + 1 for r in got)
    for shard in range(7):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_odd_shards(odd, none):
    got = sharding.shard(odd, 3).collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if r.doc_id == 1} == {1}
    assert len({(r.shard, r.slot) for r in got}) == len(ODD) and sharding.shard(none, 3).count() == 0


def test_licences(spark, none, odd):
    mit = licenses.LICENSES[0][1]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,")), (2, mit + " and more"),
            (3, "text\n  licenced under the Apache Licence, version 2.0\nmore"), (4, "Licensed under CC BY-NC 4.0. Really.")]
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", []), 2: (None, []), 3: (None, ["Apache-2.0"]), 4: (None, [])}
    assert licenses.license_scan(odd).count() == len(ODD) and licenses.license_scan(none).count() == 0
    own = "The Example License\n\nYou may do as you like; keep this text.\n" * 40
    table = spark.createDataFrame([("Example", own), ("Other", "Something else.")], "license_id string, text string")
    rows = [(i, "# Copyright 2024 Me\n" + own.lower().replace("license", "licence")) for i in range(50)]
    rows += [(None, "Licensed under CC BY 4.0.\nx"), (1, "Licensed under CC BY 4.0.\nx"), (2, own + "more"), (None, "something ELSE")]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()
    assert collections.Counter(r.license_id for r in got) == {"Example": 50, None: 3, "Other": 1}
    assert [r.notices for r in got if r.notices] == [["CC-BY-4.0"]] * 2   # with and without an id


def test_packing_places_every_piece_once(spark, documents, odd, none):
    lengths = packing.word_lengths(documents.union(documents))
    want = {(r.doc_id, r.tokens): r["count"] for r in lengths.groupBy("doc_id", "tokens").count().collect()}
    got = packing.pack(lengths, group_pieces=50).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.group_id, r.bin_id].append(r)
    for pieces in bins.values():
        pieces.sort(key=lambda r: r.offset)
        assert pieces[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(pieces, pieces[1:]))
        used = pieces[-1].offset + pieces[-1].length
        assert {r.bin_used for r in pieces} == {used}
        assert {r.capacity for r in pieces} == {min(c for c in packing.LENGTHS if c >= used)}
    tokens = collections.Counter()
    for r in got:
        tokens[r.doc_id] += r.length
    assert tokens == collections.Counter({d: t * n for (d, t), n in want.items()})
    assert packing.pack(packing.word_lengths(odd)).count() == len(ODD) + 2 and packing.pack(packing.word_lengths(none)).count() == 0


def test_best_fit_takes_the_tightest_bin_and_the_cheapest_length():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = sorted(rng.integers(1, 4097, 60).tolist(), reverse=True)
        places, capacity, used = packing.best_fit(sizes)
        opened, fill, left = [], [], sum(sizes)
        for size, (b, offset) in zip(sizes, places):  # again by exhaustive search
            rooms = [c - f for c, f in zip(opened, fill) if c - f >= size]
            if rooms:
                assert b < len(opened) and opened[b] - fill[b] == min(rooms)
            else:
                assert b == len(opened)
                fit = [c for c in packing.LENGTHS if c >= size]
                opened.append(min(fit, key=lambda c: (packing.sequence_cost(c) / min(c, left), c)))
                fill.append(0)
            assert offset == fill[b]
            fill[b] += size
            left -= size
        assert used == fill and capacity == [min(c for c in packing.LENGTHS if c >= f) for f in fill]


def test_retrieval_equals_scoring_every_item(documents, spark):
    bench = read_table(spark, SF_SMALL, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    words = [set(decontam._words(t).tolist()) for _, t in items]
    frequencies, n, mean = decontam._statistics(bench)
    counts = collections.Counter(w for some in words for w in some)
    df = {int(np.int64(r.term).view(np.uint64)): r.df for r in frequencies.collect()}
    assert df == counts and n == len(items) and np.isclose(mean, np.mean([len(decontam._words(t)) for _, t in items]))
    terms = np.array(sorted(df), np.uint64)
    known = decontam.Statistics(n, mean, terms, np.array([df[int(t)] for t in terms]))
    index = decontam.build_index(items, 64, known)
    rng = np.random.default_rng(2)
    for least in (0.05, 0.3, 0.6):
        for _ in range(40):
            terms = np.unique(rng.integers(0, len(index.terms), rng.integers(1, 60)))
            score = np.zeros(len(items))
            for t in terms:
                for p in range(index.at[t], index.at[t + 1]):
                    score[index.item[p]] += index.share[p]
            got, share = decontam.retrieve(index, terms, least)
            assert got.tolist() == np.flatnonzero(score >= least - 1e-9).tolist() and np.allclose(share, score[got])


def test_leaks(spark, odd, none):
    items = [(1, "Which river runs through the old town of the seven bridges? The slow green Avon."),
             (2, "Seven short words stand in this sentence. Nothing else follows here at all today."), (3, None), (4, "!")]
    filler = " ".join(f"filler{i}" for i in range(150))
    rows = [(10, f"{filler} {items[0][1].upper()} {filler}"), (11, f"{filler} {items[0][1][:60]} {filler}"),
            (12, filler), (13, items[1][1] + " " + filler), (14, None), (15, f"{filler} {items[1][1]}")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(10, 1), (13, 2), (15, 2)]
    split = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench, index_items=1)
    assert sorted((r.doc_id, r.item_id) for r in split.collect()) == [(10, 1), (13, 2), (15, 2)]
    key = lambda r: (r.doc_id, r.item_id, round(r.score, 12))
    part = rows + [(20 + i, items[i % 2][1][:k] + " " + filler) for i, k in enumerate((50, 60, 70, 75, 80))]
    part = spark.createDataFrame(part, "doc_id long, text string")
    loose = [sorted(map(key, decontam.leaks(part, bench, least=0.2, overlap=0.3, index_items=n).collect())) for n in (1, 2, 4096)]
    assert loose[0] == loose[1] == loose[2] and len(loose[0]) > 3   # scores don't depend on the part
    assert decontam.leaks(odd, bench).count() == 0 == decontam.leaks(none, bench).count()
    assert decontam.leaks(odd, bench.limit(0)).count() == 0


def test_registered_licence_query_finds_whole_texts_in_any_layout(spark, tmp_path):
    import textwrap

    import duckdb

    from larder.llm import catalog
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.LICENSES):
        for j, (width, mark, item) in enumerate(((60, "", None), (72, "# ", None), (79, " * ", "* "), (97, "// ", "- "), (10 ** 6, "", None))):
            lines = ["Copyright (c) 2021 Some Body", "All rights reserved.", ""]
            for part in text.split("\n"):
                if item and part[:3] in ("1. ", "2. ", "3. "):
                    part = item + part[3:]
                lines.append(part)
            # lines of one paragraph are joined, then broken anew
            paragraphs = "\n".join(lines[3:]).replace("\n1. ", "\n\n1. ").replace("\n2. ", "\n\n2. ").replace("\n3. ", "\n\n3. ")
            if not item:
                lines[3:] = [x for part in paragraphs.split("\n\n") for x in textwrap.wrap(part, width, break_long_words=False,
                                                                                          break_on_hyphens=False)]
            rows.append((100 * i + j, "\n".join(mark + x for x in lines).replace("License", "Licence" if j % 2 else "License")))
            want[100 * i + j] = name
    rows += [(9000, licenses.LICENSES[0][1] + " but not quite"), (9001, licenses.LICENSES[0][1][:-60]), (9002, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.license_id for r in catalog.op2_license_scan(spark, str(tmp_path)).collect()}
    assert got == want | {9000: None, 9001: None, 9002: None}
    duckdb.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    same = dict(duckdb.sql(f"SELECT doc_id, license_id FROM ({catalog.ORACLE['op2_license_scan']})").fetchall())
    duckdb.sql("DROP VIEW documents")
    assert same == got


def test_prefix_trees_read_back(spark):
    texts = ["", "hi", "</s>[INST] ok [/INST]", "a\\[b<\\", " blanks ", "<<SYS>>", "\n", None]
    rows = [(c, t, ["system", "user", "assistant", "tool<x>", None][(c * 3 + t) % 5], texts[(c // 4 + t * t) % 8])
            for c in range(60) for t in range(1 + c % 5)]
    rows += [(100 + c, t, "user", "hot") for c in range(40) for t in range(2)]
    rows += [(200 + c, t, "user", "hot" if t == 0 else f"own {c}") for c in range(40) for t in range(3)]
    rows += [(None, 0, "user", "no id"), (300, None, "user", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    convs = chat.conversation_turns(df)
    nodes = chat.prefix_trees(convs, limit=8)
    by_shuffle = chat.prefix_trees(convs, limit=8, max_broadcast=0)
    assert sorted(map(str, by_shuffle.collect())) == sorted(map(str, nodes.collect()))
    back = {bytes(r.leaf): r for r in chat.read_back(nodes).collect()}
    want = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[r[0]].append((r[2] or "", r[3] or ""))
    import hashlib
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = convs.collect()
    assert {r.conv_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        b, turns = back[bytes(r.leaf)], want[r.conv_id]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (b.n_turns, b.turns_sha256, b.loss_chars, b.loss_sha256) == \
            (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(learned), sha(learned))
        assert b.formatted_chars == len(chat.BEGIN + "".join(chat.format_turn(*t)[0] for t in turns))
    every = nodes.collect()
    stems = {bytes(r.seq): len(r.text) for r in every if r.shared}
    assert stems and any(r.stems for r in every)
    for r in every:  # positions count the tokens of all ancestors
        assert r.seq_end - r.seq_start == len(r.text)
        assert r.position_start == sum(stems[bytes(s)] for s in r.stems) + sum(a.end - a.start for a in r.ancestors)
    # every prefix is one node: shared tokens are emitted once
    prefixes = {tuple(turns[:i + 1]) for turns in want.values() for i in range(len(turns))}
    assert len(every) == len(prefixes) == len({(bytes(r.seq), r.node) for r in every})
    assert chat.read_back(chat.prefix_trees(chat.conversation_turns(df.limit(0)))).count() == 0


def test_hot_first_turn_is_emitted_once(spark):
    rows = [(c, t, ("user", "assistant", "user")[t], ("the same first turn", f"answer {c % 700}", f"then {c}")[t], "x")
            for c in range(2000) for t in range(2 + c % 2)]
    rows += [(5000, 0, "user", "the same first turn", "x"), (5001, 0, "user", "long " * 200_000, "x")]
    rows += [(5002, 0, "user", "twice", "x")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, leaf string")
    nodes = chat.prefix_trees(chat.conversation_turns(df)).cache()
    first = nodes.filter("text = '<s>[INST] the same first turn [/INST]'").collect()
    assert len(first) == 1 and first[0].shared and first[0].leaf is not None and first[0].seq_start == 0
    assert nodes.filter(~nodes.shared).groupBy("block").count().count() > 1
    assert nodes.filter("role = 'assistant'").count() == 700
    back = chat.read_back(nodes).collect()
    assert len(back) == len({bytes(r.leaf) for r in back}) == 700 + 1000 + 3 - sum(
        1 for a in range(700) if not any(c % 700 == a and c % 2 == 0 for c in range(2000)))
    assert sorted(r.n_turns for r in back)[:4] == [1, 1, 2, 2]


def test_hosts(spark, odd, none):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, words, "good") for i in range(40)] + [(100 + i, "short", "bad") for i in range(40)] + [(200, words, "bad"), (201, words, None)]
    got = {r.doc_id: r for r in hostrules.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].kept and not got[200].base_failed and not got[200].kept and got[201].kept and not got[100].kept
    assert hostrules.host_quality(odd).count() == len(ODD) and hostrules.host_quality(none).count() == 0


def test_registered_host_query_loses_documents_of_a_failed_host(spark, tmp_path):
    import duckdb

    from larder.llm import catalog
    good = " ".join(f"w{i}" for i in range(60))
    kinds = [("clean", 300, 12), ("farm", 200, 150), ("few", 3, 2), ("middling", 100, 55)]
    rows = [(1000 * k + i, "short" if i < bad else good, host) for k, (host, n, bad) in enumerate(kinds) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op8_host_rules(spark, str(tmp_path)).collect()
    lost = {h: sum(1 for r in got if r.doc_id // 1000 == k and not r.base_failed and not r.kept)
            for k, (h, _, _) in enumerate(kinds)}
    # 55 of 100 and 2 of 3 are no proof of over a half; 150 of 200 is, and takes the other 50 along
    assert lost == {"clean": 0, "farm": 50, "few": 0, "middling": 0}
    duckdb.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    same = duckdb.sql(f"SELECT doc_id, kept FROM ({catalog.ORACLE['op8_host_rules']})").fetchall()
    duckdb.sql("DROP VIEW documents")
    assert sorted(same) == sorted((r.doc_id, r.kept) for r in got)


def test_forward_backward_equals_enumeration():
    import itertools
    rng = np.random.default_rng(3)
    score, trans, first = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 5, 9])
    good, pairs, z = quality.marginals(score, trans, first)
    all_pairs = np.zeros((2, 2))
    for r, (a, b) in enumerate(zip(first, first[1:])):
        mass, ones = 0.0, np.zeros(b - a)
        counts = np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(b - a)):
            p = np.exp(sum(score[a + i] * s for i, s in enumerate(path)) + sum(trans[x, y] for x, y in zip(path, path[1:])))
            mass += p
            ones += p * np.array(path)
            for x, y in zip(path, path[1:]):
                counts[x, y] += p
        assert np.allclose(good[a:b], ones / mass) and np.isclose(z[r], np.log(mass))
        all_pairs += counts / mass
    assert np.allclose(pairs, all_pairs)


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_classifiers_learn_and_leave_held_out_labels(spark, operator, odd, none):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        lines = [" ".join(word() for _ in range(12)) for _ in range(3)]
        if bad:
            lines[1] = "ZAP ## zapper %% || " * 3
        rows.append((i, "\n".join(lines), int(not bad), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    label = operator.__name__ == "toxicity" and "toxic" or "quality"
    labels = docs.select("doc_id", *[c for c in ("quality", "toxic")])
    got = operator(docs, labels).collect()
    truth = {r[0]: r[3] if label == "toxic" else r[2] for r in rows}
    mod, held = (4, 2) if label == "toxic" else (3, 1)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    plain = operator(odd, labels.limit(0)).collect()
    assert len(plain) == len(ODD) and len({r.score for r in plain}) == 1
    assert len(operator(odd.drop("score"), labels).collect()) == len(ODD) and operator(none, labels).count() == 0


def test_convolution_and_pooling_equal_the_definition():
    """Every filter at every place of every document, one by one."""
    rng = np.random.default_rng(9)
    table = rng.normal(size=(toxicity.SLOTS + 1, toxicity._OFFSETS * toxicity.FILTERS)).astype(np.float32)
    table[toxicity.SLOTS] = 0
    bias, out = rng.normal(size=toxicity._POOLED), rng.normal(size=toxicity._POOLED)
    docs = [rng.integers(0, toxicity.SLOTS, (n, 3)).astype(np.uint16) for n in (1, 0, 2, 5, 0, 0, 40, 3, 0)]
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = toxicity.pooled_logits(np.concatenate(docs), first, table, bias, out, 0.25)
    of = table.reshape(-1, toxicity._OFFSETS, toxicity.FILTERS)
    for logit, d in zip(got, docs):
        hidden, base = [], 0
        for width in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                places = []
                for at in range(len(d)):
                    inside = [j for j in range(width) if at + j < len(d)]
                    places.append(sum(of[s, base + j, f] for j in inside for s in d[at + j]))
                hidden.append(max(places, default=0.0))
            base += width
        assert np.isclose(logit, np.maximum(np.array(hidden) + bias, 0) @ out + 0.25, atol=1e-3)


def test_language_cuts_are_drawn_towards_the_common_one():
    logits, y = np.array([0.0, 1.0, 4.0, 5.0]), np.array([0, 0, 1, 1])
    own = toxicity.best_threshold(logits, y, np.ones(4))
    assert toxicity.drawn_cut(logits[:2], y[:2], np.ones(2), 9.0) == 9.0          # one class only
    few, many = (toxicity.drawn_cut(np.tile(logits, k), np.tile(y, k), np.ones(4 * k), 9.0) for k in (1, 1000))
    assert own < many < own + 0.1 < few < 9.0


def test_weighted_threshold_equals_repeated_rows():
    rng = np.random.default_rng(5)
    for _ in range(20):
        logits, y, times = rng.normal(size=60).round(1), rng.integers(0, 2, 60), rng.integers(1, 9, 2)
        many = times[y]
        assert np.isclose(toxicity.best_threshold(logits, y, many.astype(float)), toxicity.best_threshold(
            np.repeat(logits, many), np.repeat(y, many), np.ones(many.sum())))


def test_drawn_cut_of_counted_logits_equals_that_of_single_documents():
    logits, y, times = np.array([2.0, 1.0, 0.0, -1.0]), np.array([1, 0, 1, 0]), np.array([40, 3, 2, 50])
    one_by_one = toxicity.drawn_cut(np.repeat(logits, times), np.repeat(y, times), np.ones(times.sum()), 9.0)
    assert np.isclose(toxicity.drawn_cut(logits, y, times.astype(float), 9.0), one_by_one)


def test_toxicity_cut_follows_the_class_mix_of_the_table(spark):
    """One tenth toxic: of these half say zap; zip is as likely toxic as 1 in 6."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(3000):
        toxic = i % 10 == 0
        word = ("zap" if i % 20 == 0 else "zip") if toxic else "zip" if rng.random() < 0.3 else "plain"
        rows.append((i, f"{word} " + " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(6)), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for most in (3000, 150):  # without and with a cap on the clean class
        got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, docs, max_docs=most).collect()}
        share = {w: np.mean([got[i] for i, t, _ in rows if t.startswith(w)]) for w in ("zap", "zip", "plain")}
        assert share["zap"] > 0.9 and share["zip"] < 0.1 and share["plain"] < 0.1, (most, share)


@pytest.mark.parametrize("most", [toxicity.MAX_BROADCAST, 0])  # labels broadcast and shuffled
def test_toxicity_learns_from_every_labelled_document(spark, monkeypatch, most):
    """A word of toxic documents behind the first 3000 in hash order counts too."""
    monkeypatch.setattr(toxicity, "MAX_BROADCAST", most)
    monkeypatch.setattr(toxicity, "DOCS_PER_WORKER", 3000)  # several tasks train
    ids = spark.range(9600).withColumn("h", F.xxhash64("id")).withColumn("held", F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4)) == 2)
    order = {held: [r.id for r in ids.filter(F.col("held") == held).orderBy("h").collect()] for held in (False, True)}
    toxic = {i: "zip" if at < 3000 else "zap" for at, i in enumerate(i for i in order[False] if i % 5)}
    toxic |= {i: "zap" for i in order[True] if i % 5}
    rng = np.random.default_rng(11)
    noise = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    rows = [(i, f"{toxic.get(i, 'plain')} " + " ".join(rng.choice(noise, 4)), int(i in toxic)) for i in range(9600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    kept = toxicity.learnable_rows(docs, docs, toxicity._function_table())
    assert kept.count() == len(order[False])
    counted = toxicity.logit_counts(kept.filter("unseen"), [toxicity.net_of(toxicity.first_weights(np.ones(toxicity.SLOTS + 1)))])
    assert counted[0][3].sum() == kept.filter("unseen").count()
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, docs).filter("held_out").collect()}
    assert np.mean([got[i] == int(i in toxic) for i in got]) > 0.95


def test_weighted_logistic_equals_repeated_rows():
    rng = np.random.default_rng(7)
    e, y, times = rng.normal(size=80), rng.integers(0, 2, 80), np.array([2, 7])
    many = times[y]
    assert np.allclose(quality.fit_logistic(e, y, many.astype(float)),
                       quality.fit_logistic(np.repeat(e, many), np.repeat(y, many), np.ones(many.sum())))


def test_quality_scores_follow_the_class_mix_of_the_table(spark):
    """Labels that the text doesn't tell: every score is near the good share."""
    rows = [(i, f"some line of plain words {i % 7}", int(i % 8 > 0)) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    for most in (3000, 100):  # without and with a cap on the good class
        got = quality.quality(docs, docs, max_docs=most).collect()
        assert abs(np.mean([r.score for r in got]) - 7 / 8) < 0.05 and all(r.predicted == 1 for r in got), most


def test_pipeline_stages_keep_columns_and_clean_documents(spark, documents):
    import corpus_pipeline
    docs = documents.withColumn("carried", documents["source"])
    cut = corpus_pipeline.cut_repeats(spark, docs, SF_SMALL)
    assert cut.schema == docs.schema or [f.dataType for f in cut.schema] == [f.dataType for f in docs.schema]
    want = {r.doc_id: r.kept_text for r in substrings.remove_repeats(documents, with_text=True).collect()}
    assert {r.doc_id: r.text for r in cut.collect()} == want
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert 0 < out.select("doc_id").distinct().count() <= documents.count()


def test_pipeline_stages_on_odd_tables(spark, documents):
    """Clashing and dotted column names, maps, very long texts, empty tables."""
    import corpus_pipeline
    from pyspark.sql import functions as F
    names = ["was_null", "a.b", "row", "digest", "hash", "nth", "text_crc32", "spans", "sum", "score", "kept`x"]
    odd = documents.limit(30).withColumns({n: F.lit(i) for i, n in enumerate(names)}) \
        .withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    long = odd.limit(1).withColumn("doc_id", F.lit(-1).cast("long")).withColumn(
        "text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " "))
    odd = odd.union(long)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, SF_SMALL)
        assert got.columns == odd.columns, name
        rows = {r["doc_id"]: r for r in got.collect()}
        assert -1 in rows and rows[-1]["a.b"] == 1 and rows[-1]["kept`x"] == 10 and len(rows[-1]["text"].split()) == 300_000
        none = stage(spark, odd.limit(0), SF_SMALL)
        assert none.columns == odd.columns and none.count() == 0
    assert corpus_pipeline.pack_sequences(spark, odd, SF_SMALL).filter("doc_id = -1").agg({"length": "sum"}).first()[0] == 300_001
    assert corpus_pipeline.pack_sequences(spark, odd.limit(0), SF_SMALL).count() == 0


def test_pipeline_judges_every_row_whatever_its_id(spark, tmp_path):
    import corpus_pipeline
    rng = np.random.default_rng(8)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    item = "Which river runs through the old town of the seven bridges? The slow green Avon."
    labelled = [(i, text(30) + " zap" * (i % 3 == 0), int(i % 3 == 0)) for i in range(600)]
    spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean, copied, leaky = text(40), text(40), f"{text(40)} {item} {text(40)}"
    odd = [(None, text(30) + " zap"), (700, text(30) + " zap"), (700, clean),     # toxic: the first two
           (None, copied), (None, copied), (710, copied), (711, copied), (711, text(40)),  # 710 stands for its group
           (None, leaky), (720, leaky + " " + text(9)), (720, text(40)), (None, None), (None, ""), (730, None)]
    schema = "doc_id long, text string"
    of = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    docs = spark.createDataFrame(odd, schema)

    train = spark.createDataFrame([(i, t) for i, t, _ in labelled], schema)
    got = of(corpus_pipeline.drop_toxic(spark, train.union(docs.filter("text <> ''")), str(tmp_path))
             .filter("doc_id is null or doc_id >= 700"))
    assert got == sorted([r for r in odd[2:] if r[1]], key=str)
    got = of(corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)))
    assert got == sorted([r for r in odd if r[1] not in (copied, leaky) and not (r[1] or "").startswith(leaky)]
                         + [(710, copied), (720, odd[9][1])], key=str)
    got = of(corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path)))
    assert got == sorted([r for r in odd if item not in (r[1] or "")], key=str)
