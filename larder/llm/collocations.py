"""Phrase collocation mining by SON partitioning.

1. Shards. The table is dealt to ``shards`` shards by tasks. A phrase that
   occurs ``min_count`` times occurs ``min_count / shards`` times, rounded up, in
   some shard, whichever rows it holds: that is the local support. Since the
   number of shards is fixed, it doesn't fall as the corpus grows; a shard is
   mined by as many tasks as it has data for.
2. Local mining. A task counts the phrases of its chunks of text in numpy and
   sends each chunk's counts on, packed by hash range. A range adds them up per
   shard: a phrase at the local support in any shard is a candidate, and
   stays one unless the counts of all shards sum to less than ``min_count``.
   Words come first, then pairs of words left, then longer phrases all of
   whose pairs are left; what is left reaches the tasks as a key filter of at
   most 16 MB.
3. Global count. A last scan counts, exactly and by text, every phrase that
   the filter of all candidates lets through, and the words of each language;
   texts and counts are packed by hash range too and summed there.
   A phrase passes in every task or in none, so counts are whole even for the
   filter's false positives; these fall to ``min_count`` like all others.

In a chunk, words are told apart by a 64-bit hash and phrases by pairs of
exact numbers; hash ranges go by 64-bit hashes, where a collision can only add
a candidate; the last count goes by text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import LOWER, key_filter, mix, passes, release, row_chunks, utf8_column, words, written

SHARDS = 16
MAX_WORDS = 5
#: Bytes of text that a task counts at once, and words whose counts one hash range adds up.
CHUNK_BYTES, RANGE_WORDS = 16 << 20, 1 << 21
_GAP = np.zeros(256, bool)
_GAP[[9, 32, 10, 11, 12, 13, *b".,;:!?"]] = True
_BREAK = _GAP.copy()
_BREAK[[9, 32]] = False
_STEP = np.uint64(0x9FB21C651E98DF25)


class _Chunk:
    """Lower-cased words of some documents, one after another."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.parts, self.size = [], 0

    def add(self, offsets, data, langs):
        """Rows of the languages ``langs`` (names) with their texts."""
        codes = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int32)
        w = words(data, offsets, lower=True, gap=_GAP)
        self.size += len(data)
        if not len(w.hash):
            return
        length = w.end - w.start
        stop = np.cumsum(length + 1)
        buffer, ink = np.full(stop[-1], 32, np.uint8), np.ones(stop[-1], bool)
        ink[stop - 1] = False
        buffer[ink] = LOWER[data[~_GAP[data]]]
        breaks, row = np.cumsum(_BREAK[data], dtype=np.int32), w.row
        follows = np.append((breaks[w.start[1:]] == breaks[w.end[:-1] - 1]) & (row[1:] == row[:-1]), False)
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
                          for x in self.langs], np.uint64)
        code = codes[row]
        self.parts.append((buffer, mix(w.hash ^ seeds[code]), length.astype(np.int32), follows, code))

    def arrays(self):
        """Text, word hashes, whether the next word is in the same piece,
        language code, first and last byte of each word. Empties the chunk."""
        columns = [list(c) for c in zip(*self.parts)]
        self.parts = []
        out = []
        while columns:
            out.append(np.concatenate(columns.pop(0)))
        buffer, hashes, length, follows, code = out
        stop = np.cumsum(length, dtype=np.int64) + np.arange(len(length))
        return buffer, hashes, follows, code, stop - length, stop


def _groups(key: np.ndarray):
    """(a position, count) of each distinct key, and every key's number."""
    order = np.argsort(key)
    ordered = key[order]
    head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[:len(key)])
    del ordered
    count = np.diff(np.append(head, len(key)))
    back = np.empty(len(key), np.uint32)
    back[order] = np.repeat(np.arange(len(head), dtype=np.uint32), count)
    return order[head], count, back


def _mined(word, follows, keep, longest: int):
    """(n words, a position, count and hash of each phrase kept), length by
    length. ``keep`` (n, hashes) tells which phrases of n words are kept; a
    phrase is looked at only where its first and last n - 1 words are."""
    at, key, h = np.arange(len(word), dtype=np.uint32), word, word
    ident = np.zeros(len(word), np.uint32)   # number of the kept phrase that begins here, plus 1
    for n in range(1, longest + 1):
        if not len(at):
            return
        some, count, back = _groups(key)
        kept = keep(n, h[some])
        yield n, at[some[kept]], count[kept], h[some[kept]]
        if n == longest:
            return
        alive = kept[back]
        ident[:] = 0
        ident[at[alive]] = back[alive] + np.uint32(1)
        alive &= follows[at]
        at, h = at[alive], h[alive]
        more = ident[at + 1] > 0
        at, h = at[more], h[more]
        key = ident[at].astype(np.uint64) << np.uint64(32) | ident[at + 1].astype(np.uint64)
        h = mix(h * _STEP + word[at + n])


def _texts(buffer, start, stop, at, n):
    """Phrases of ``n`` words that begin at the words ``at``."""
    a, size = start[at], stop[at + n - 1] - start[at]
    offsets = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - a, size)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)),
                                            pa.py_buffer(buffer[take])).cast(pa.string())


def _chunks(batches, size):
    chunk = _Chunk()
    for batch in batches:
        offsets, data = utf8_column(batch.column(0))
        langs = batch.column(1).to_pylist()
        for lo, hi in row_chunks(offsets):
            chunk.add(offsets[lo:hi + 1] - offsets[lo], data[offsets[lo]:offsets[hi]], langs[lo:hi])
            if chunk.size >= size:
                if chunk.parts:
                    yield chunk
                chunk = _Chunk()
    if chunk.parts:
        yield chunk


def _counts(bits, shortest: int, longest: int, ranges: int, shards: int, size: int):
    """Packed counts of the phrases of ``shortest`` to ``longest`` words, by
    hash range. Shorter ones must pass the filter ``bits``."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def keep(n, h):
        return np.ones(len(h), bool) if n >= shortest else passes(bits, h)

    def run(batches):
        shard = TaskContext.get().partitionId() % shards
        for chunk in _chunks(batches, size):
            _, word, follows, *_ = chunk.arrays()
            for n, _, count, h in _mined(word, follows, keep, longest):
                if n < shortest:
                    continue
                by = np.argsort(h)
                h, count = h[by], count[by].astype(np.uint32)
                cut = np.searchsorted((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
                some = np.flatnonzero(np.diff(cut))
                for i in range(0, len(some), 256):
                    mine = [(int(p), shard, h[cut[p]:cut[p + 1]].tobytes(), count[cut[p]:cut[p + 1]].tobytes())
                            for p in some[i:i + 256]]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*mine), schema.types)], schema=schema)
    return run


def _frequent(support: int, min_count: int):
    """All counts of a hash range -> hashes at the local support in some shard
    whose counts in all shards reach ``min_count``."""
    def run(key, table):
        shard, hashes, counts = (table.column(i).to_pylist() for i in (1, 2, 3))
        shard = np.repeat(np.array(shard, np.int32), [len(x) // 8 for x in hashes])
        h = np.frombuffer(b"".join(hashes), np.uint64)
        count = np.frombuffer(b"".join(counts), np.uint32).astype(np.int64)
        by = np.lexsort((shard, h))
        h, shard, count = h[by], shard[by], count[by]
        new = np.append(True, h[1:] != h[:-1])
        local = np.flatnonzero(new | np.append(True, shard[1:] != shard[:-1]))
        count = np.add.reduceat(count, local)
        head = np.flatnonzero(new[local])
        candidate = np.maximum.reduceat(count, head) >= support
        good = candidate & (np.add.reduceat(count, head) >= min_count)
        return pa.table([pa.array(h[local[head[good]]].view(np.int64))], names=["h"])
    return run


def _counted(bits: np.ndarray, longest: int, ranges: int, size: int):
    """Packed texts and counts of the phrases that pass the filter, by hash
    range, language and length; length 0 is the number of words."""
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("n_words", pa.int32()),
                        ("phrases", pa.list_(pa.string())), ("f", pa.list_(pa.int64()))])

    def run(batches):
        for chunk in _chunks(batches, size):
            names = list(chunk.langs)
            buffer, word, follows, code, start, stop = chunk.arrays()
            total = np.bincount(code, minlength=len(names)).tolist()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(
                ([0] * len(names), names, [0] * len(names), [[""]] * len(names), [[n] for n in total]), schema.types)],
                schema=schema)
            for n, at, count, h in _mined(word, follows, lambda n, h: passes(bits, h), longest):
                if not len(at):
                    continue
                key = (h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                key = key.astype(np.int64) * len(names) + code[at]
                by = np.argsort(key, kind="stable")
                at, count, key = at[by], count[by], key[by]
                head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                cut = pa.array(np.append(head, len(key)), pa.int32())
                yield pa.record_batch([
                    pa.array(key[head] // len(names), pa.int32()), pa.array([names[i] for i in key[head] % len(names)]),
                    pa.array(np.full(len(head), n, np.int32)),
                    pa.ListArray.from_arrays(cut, _texts(buffer, start, stop, at, n)),
                    pa.ListArray.from_arrays(cut, pa.array(count.astype(np.int64)))], schema=schema)
    return run


def _summed(min_count: int):
    """All texts and counts of a hash range -> the sum per phrase."""
    def run(key, table):
        phrases, counts = (_flat(table.column(c)) for c in ("phrases", "f"))
        rows = pa.array(np.repeat(np.arange(len(table)), phrases[0]))
        flat = pa.table([table.column("lang").take(rows), table.column("n_words").take(rows), phrases[1], counts[1]],
                        names=["lang", "n_words", "phrase", "f"])
        out = flat.group_by(["lang", "n_words", "phrase"], use_threads=False).aggregate([("f", "sum")])
        f, n = np.array(out.column("f_sum")), np.array(out.column("n_words"))
        out = out.filter(pa.array((f >= min_count) | (n == 0)))
        return out.select(["lang", "n_words", "phrase", "f_sum"]).rename_columns(["lang", "n_words", "phrase", "f"])
    return run


def _flat(column):
    """(sizes, values) of a list column."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return (np.concatenate([np.diff(c.offsets.to_numpy()) for c in chunks]),
            pa.chunked_array([c.flatten() for c in chunks], column.type.value_type))


def phrase_counts(documents: DataFrame, min_count: int = 100, longest: int = MAX_WORDS, shards: int = SHARDS,
                  chunk_bytes: int = CHUNK_BYTES, range_words: int = RANGE_WORDS) -> DataFrame:
    """lang, n_words, phrase (space-joined), f: every phrase of 1 to
    ``longest`` words with f >= ``min_count``, and per language one row of
    n_words 0 with the number of its words. The result is written."""
    docs = documents.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                            F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    support, bits, found = -(-min_count // shards), None, None
    for shortest, most in ((1, 1), (2, 2), (3, longest)):
        if most < shortest or most > longest:
            continue
        # A word has some six bytes; a range holds the counts of all lengths of this round.
        ranges = 1 + size * (most - shortest + 1) // (6 * range_words)
        counts = docs.mapInArrow(_counts(bits, shortest, most, ranges, shards, chunk_bytes),
                                 "part int, shard int, hashes binary, counts binary")
        more = counts.groupBy("part").applyInArrow(_frequent(support, min_count), "h long")
        before, found = found, written(more if found is None else found.union(more), "candidates")
        if before is not None:
            release(before)
        bits = key_filter(found, "h")
    release(found)
    ranges = 1 + size * longest // (6 * range_words)
    counted = docs.mapInArrow(_counted(bits, longest, ranges, chunk_bytes),
                              "part int, lang string, n_words int, phrases array<string>, f array<long>")
    return written(counted.groupBy("part").applyInArrow(_summed(min_count), "lang string, n_words int, phrase string, f long"),
                   "phrases")


def collocations(documents: DataFrame, min_count: int = 100, longest: int = MAX_WORDS, top: int = 2000,
                 cover_percent: int = 100, shards: int = SHARDS, chunk_bytes: int = CHUNK_BYTES,
                 range_words: int = RANGE_WORDS) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words per language: lang, rank,
    phrase, a (its count), l, r (counts of the two parts of its weakest cut),
    n (words of the language), score (1000 * a * n / (l * r), floored).

    Counts are exact, products up to 38 digits. A phrase goes when a longer phrase of ``longest`` words at most holds it
    and has ``cover_percent`` of its count. Ties: score, a, then phrase in
    byte order. Null text is empty, null lang is ``und``; documents without an
    id or with a repeated one count as often as they occur. An empty table
    gives an empty result. A very long text is a chunk of its own. Other
    columns are not read. The list of languages is broadcast, a number each.
    """
    f = phrase_counts(documents, min_count, longest, shards, chunk_bytes, range_words)
    phrases = f.filter("n_words >= 2").select("lang", "phrase", "n_words", F.col("f").alias("a"))
    part = f.filter("n_words >= 1")
    # A longer phrase that covers covers through every phrase between, so one word more is enough.
    first = F.expr("substring_index(phrase, ' ', n_words - 1)")
    last = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
    covers = (phrases.filter("n_words >= 3").select("lang", F.explode(F.array(first, last)).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    stays = (phrases.join(covers, ["lang", "phrase"], "left")
             .filter(F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a"))))
    # As many rows as languages.
    n = F.broadcast(f.filter("n_words = 0").select("lang", F.col("f").alias("n")))
    cuts = (stays.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
            .withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
            .withColumn("right", F.expr("substring(phrase, length(left) + 2)")))
    scored = (cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
              .join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
              .join(n, "lang")
              .withColumn("score", F.expr("(1000BD * a * n) div (cast(l as decimal(19)) * r)")))
    best = (scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
