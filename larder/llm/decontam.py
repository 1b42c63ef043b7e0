"""Benchmark decontamination by a BM25 index of the test items.

The index is over the items; every passage of every training document is a
query. A passage is two neighbouring blocks of L words (L: the longest item of
the index), so each item of at most L words that a document quotes lies whole
in one passage. Scores are shares of the score an item gives itself.

Retrieval is exact: all items at or above ``least`` come back. Block-max
WAND's two bounds skip the rest: a passage whose terms' list maxima don't sum
to ``least`` is dropped at once (computed for all passages of a chunk), then
only item blocks whose block maxima reach it are scored.

A retrieved item counts as leaked if ``overlap`` of the question's 5-word
shingles and of the answer's words stand in the passage.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import row_chunks, rows_kept, sequence_hash, utf8_column, window_hashes, words, written

LEAST, OVERLAP, SHINGLE = 0.6, 0.8, 5
K1, B = 1.2, 0.75
ITEM_BLOCK = 16
#: Items of one index: it travels to the tasks, so it is bounded; more items make more indexes.
INDEX_ITEMS = 4096
LENGTHS = (64, 256, 1024, 4096)

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), True, _GAP).hash


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): cut behind the last question mark that something
    follows, else before the last sentence; a single sentence is the question
    and its last quarter of words the answer."""
    parts = re.findall(r".*\?\s+(?=\S)|.+", text, re.S)
    if len(parts) == 2:
        return parts[0], parts[1]
    found = list(re.finditer(r"[.!?]\s+(?=\w)", text))
    if found:
        return text[:found[-1].end()], text[found[-1].end():]
    w = text.split()
    return text, " ".join(w[len(w) - max(1, len(w) // 4):])


def shingles(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    if len(hashes) >= k:
        return np.unique(window_hashes(hashes, k))
    return np.array([sequence_hash(hashes)][:len(hashes)], np.uint64)


class Index(NamedTuple):
    length: int                # words of a passage block
    items: list                # (item_id, question shingles, answer words, n words)
    terms: np.ndarray          # sorted term hashes
    top: np.ndarray            # largest share of a term over all items
    at: np.ndarray             # postings of term t: at[t]:at[t + 1]
    item: np.ndarray
    share: np.ndarray
    block_at: np.ndarray       # blocks of term t: block_at[t]:block_at[t + 1]
    block: np.ndarray
    block_top: np.ndarray


class Statistics(NamedTuple):
    """Of all items together, whatever index they are in."""
    n: int                     # items
    mean: float                # words of an item
    terms: np.ndarray          # sorted term hashes
    df: np.ndarray             # items that hold a term

    def of(self, terms: np.ndarray) -> "Statistics":
        return self._replace(terms=terms, df=self.df[np.searchsorted(self.terms, terms)])


def _statistics(items: DataFrame):
    """Item counts, mean length and the frequency of every term, as one
    aggregate over the items."""
    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                w = _words(text)
                if len(w):
                    yield pa.record_batch([pa.array(np.unique(w).view(np.int64)),
                                           pa.array(np.r_[len(w), np.zeros(len(np.unique(w)) - 1, np.int64)])],
                                          names=["term", "n_words"])

    terms = written(items.select("text").mapInArrow(run, "term long, n_words long"), "item-terms")
    whole = terms.agg(F.count_if(F.col("n_words") > 0).alias("n"), F.sum("n_words").alias("words")).first()
    return terms.groupBy("term").agg(F.count("*").alias("df")), whole.n, (whole.words or 0) / max(1, whole.n)


def build_index(items: list[tuple[int, str]], length: int, statistics: Statistics) -> Index | None:
    """BM25 postings with each contribution divided by its item's own score."""
    kept, docs = [], []
    for item_id, text in items:
        w = _words(text)
        q, a = split_item(text)
        kept.append((item_id, shingles(_words(q)), np.unique(_words(a)), len(w)))
        docs.append(np.unique(w, return_counts=True))
    if not kept:
        return None
    term = np.concatenate([t for t, _ in docs])
    tf = np.concatenate([c for _, c in docs]).astype(float)
    item = np.repeat(np.arange(len(docs)), [len(t) for t, _ in docs])
    n_words = np.array([n for *_, n in kept], float)
    terms, which = np.unique(term, return_inverse=True)
    df = statistics.of(terms).df
    idf = np.log(1 + (statistics.n - df + 0.5) / (df + 0.5))[which]
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_words[item] / statistics.mean))
    share = score / np.bincount(item, score)[item]
    order = np.lexsort((item, which))
    which, item, share = which[order], item[order], share[order]
    at = np.searchsorted(which, np.arange(len(terms) + 1))
    top = np.maximum.reduceat(share, at[:-1])
    pair = which * (len(docs) // ITEM_BLOCK + 1) + item // ITEM_BLOCK
    head = np.flatnonzero(np.diff(pair, prepend=-1))
    return Index(length, kept, terms, top, at, item, share, np.searchsorted(which[head], np.arange(len(terms) + 1)),
                 item[head] // ITEM_BLOCK, np.maximum.reduceat(share, head))


def _slices(at: np.ndarray, terms: np.ndarray) -> np.ndarray:
    n = at[terms + 1] - at[terms]
    return np.repeat(at[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())


def retrieve(index: Index, terms: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(items, shares) at or above ``least`` for a passage of distinct terms."""
    s = _slices(index.block_at, terms)
    alive = np.bincount(index.block[s], index.block_top[s]) >= least - 1e-9
    if not alive.any():
        return np.zeros(0, int), np.zeros(0)
    s = _slices(index.at, terms)
    block = index.item[s] // ITEM_BLOCK
    s = s[alive[block]]
    score = np.bincount(index.item[s], index.share[s])
    got = np.flatnonzero(score >= least - 1e-9)
    return got, score[got]


def _search(index: Index, data, offsets, least, overlap):
    """(row, item, score, question share, answer share) of leaks in a chunk."""
    w = words(data, offsets, True, _GAP)
    known = np.minimum(np.searchsorted(index.terms, w.hash), len(index.terms) - 1)
    hit = np.flatnonzero(index.terms[known] == w.hash)
    if not len(hit):
        return
    n_blocks = np.maximum(1, -(-w.counts // index.length))
    first_block = np.concatenate([[0], np.cumsum(n_blocks)])
    row = w.row[hit]
    block = first_block[row] + (hit - w.first[row]) // index.length
    pair = np.unique(block * len(index.terms) + known[hit])
    block, term = pair // len(index.terms), pair % len(index.terms)
    bound = np.bincount(block, index.top[term], first_block[-1])
    of = np.searchsorted(block, np.arange(first_block[-1] + 1))
    paired = np.ones(len(bound), bool)
    paired[first_block[1:] - 1] = False  # the last block of a row has no neighbour
    both = bound + np.where(paired, np.roll(bound, -1), 0)
    for b in np.flatnonzero(both >= least - 1e-9):
        r = int(np.searchsorted(first_block, b, "right") - 1)
        if not paired[b] and b > first_block[r]:
            continue  # lies in the passage before
        found, score = retrieve(index, np.unique(term[of[b]:of[b + 1 + int(paired[b])]]), least)
        if len(found):
            a = w.first[r] + (b - first_block[r]) * index.length
            passage = w.hash[a:min(a + 2 * index.length, w.first[r + 1])]
            grams = {k: shingles(passage, k) for k in {SHINGLE}}
            for i, s in zip(found, score):
                item_id, question, answer, _ = index.items[i]
                if len(question) == 1:
                    q = float(_contains(passage, question[0]))
                else:
                    q = float(np.isin(question, grams[SHINGLE]).mean()) if len(question) else 1.0
                ans = float(np.isin(answer, passage).mean()) if len(answer) else 1.0
                if q >= overlap and ans >= overlap:
                    yield r, item_id, float(s), q, ans


def _contains(passage: np.ndarray, sequence: np.uint64) -> bool:
    """Whether a question of at most SHINGLE words stands in the passage."""
    return any(int(g) == int(sequence) or int(g) ^ (k * 0xA24BAED4963EE407 & (1 << 64) - 1) == int(sequence)
               for k in range(1, SHINGLE + 1) for g in window_hashes(passage, k))


def _scan(indexes, least, overlap):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                        ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            offsets, data = utf8_column(batch.column(1))
            best = {}
            for lo, hi in row_chunks(offsets):
                for index in indexes:
                    for r, item, s, q, a in _search(index, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo],
                                                    least, overlap):
                        best[lo + r, item] = max(best.get((lo + r, item), (0, 0, 0)), (s, q, a))
            if best:
                yield pa.record_batch([ids.take(pa.array([r for r, _ in best])), pa.array([i for _, i in best], pa.int64()),
                                       *(pa.array(c, pa.float64()) for c in zip(*best.values()))], schema=schema)
    return run


def _indexes(benchmark: DataFrame, index_items: int):
    """Lists of indexes, one list per part of at most some ``index_items``
    items; frequencies and lengths are those of all items. Only one part at a
    time is held by the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .filter("text is not null").distinct()
    frequencies, n, mean = _statistics(items)
    parts = 1 + n // index_items
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for p in range(parts if n else 0):
        mine = [(r.item_id, r.text) for r in items.filter(part == p).collect()]
        sized = sorted(((i, t, len(_words(t))) for i, t in mine), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        terms = np.unique(np.concatenate([_words(t) for _, t in mine] or [np.zeros(0, np.uint64)]))
        # as many rows as the part has terms
        asked = F.broadcast(frequencies.sparkSession.createDataFrame(
            pa.table({"term": pa.array(terms.view(np.int64))})))
        df = {r.term: r.df for r in frequencies.join(asked, "term").collect()}
        known = Statistics(n, mean, terms, np.array([df[t] for t in terms.view(np.int64).tolist()], np.int64))
        lengths = sorted({next((m for m in LENGTHS if k <= m), k) for *_, k in sized if k})
        yield [build_index([(i, t) for i, t, k in sized if k and next((m for m in LENGTHS if k <= m), k) == size],
                           size, known) for size in lengths]


def leaks(documents: DataFrame, benchmark: DataFrame, least: float = LEAST, overlap: float = OVERLAP,
          index_items: int = INDEX_ITEMS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row per
    document row and item found in it, with its best passage.

    Items without words are skipped; an item without an id is named by null. Null
    and empty texts leak nothing; a very long text is searched whole, passage by
    passage. Repeated rows give a row each, repeated items count once. Empty
    tables give an empty result; other columns are not read.
    """
    kind = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for indexes in _indexes(benchmark, index_items):
        found = docs.mapInArrow(_scan(indexes, least, overlap), kind)
        out = found if out is None else out.union(found)
    return documents.sparkSession.createDataFrame([], kind) if out is None else out


def without_leaks(documents: DataFrame, benchmark: DataFrame, least: float = LEAST, overlap: float = OVERLAP,
                  index_items: int = INDEX_ITEMS) -> DataFrame:
    """The rows, with all columns, in which ``leaks`` finds no item; each part
    of the items reads what the part before let through."""
    def clean(indexes):
        def keep(offsets, data):
            good = np.ones(len(offsets) - 1, bool)
            for lo, hi in row_chunks(offsets):
                for index in indexes:
                    for r, *_ in _search(index, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo],
                                         least, overlap):
                        good[lo + r] = False
            return good
        return keep

    for indexes in _indexes(benchmark, index_items):
        documents = rows_kept(documents, clean(indexes))
    return documents
