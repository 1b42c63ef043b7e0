"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features describe its bytes and those of
the lines around it; weights and transition scores are fitted by maximum
likelihood in numpy, each line of a training document carrying the document's
label. Forward-backward gives each line's probability of being good, the mean
weighted by length is the document's evidence, and a logistic curve fitted on
the training documents turns it into a score. There each class weighs as much
as in the whole table, so that the cap on the sample doesn't move the scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import class_weights, held_out, labelled_sample, row_chunks, span_hashes, utf8_column, words

MOD, HELD, THRESHOLD = 3, 1, 0.5
#: Bounds of what is learned from: documents of each class, lines in all.
MAX_DOCS, MAX_LINES = 3000, 300_000
STEPS, RATE, DECAY = 150, 0.1, 1e-3

# Byte classes: other, lower case, upper case, digit, blank, sentence marks, bar, other marks, beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[list(b".,;:?'\"")] = 5
_CLASS[list(b"|")] = 6
_CLASS[list(b"!#$%&()*+-/<=>@[\\]^_`{}~")] = 7
_CLASS[128:] = 8
_CLASSES, _OWN = 9, 14


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features (lines, 3 * _OWN + 1) float32, bytes per line, first line per
    row). Every row has a line at least; lines end at a newline. Features:
    the line's own, those of the lines before and after, a constant."""
    n = len(offsets) - 1
    cuts = np.flatnonzero(data == 10) + 1
    # a line begins at each row's start and after each newline of that row
    row = np.searchsorted(offsets, cuts, "left") - 1
    start = np.concatenate([offsets[:-1], cuts])
    of = np.concatenate([np.arange(n), np.minimum(row, n - 1)])
    order = np.lexsort((start, of))
    start, of = start[order], of[order]
    end = np.append(start[1:], len(data))
    last = np.append(of[1:] != of[:-1], True)[:len(of)]
    end[last] = offsets[of[last] + 1]
    end = np.maximum(start, end)
    size = end - start
    line = np.repeat(np.arange(len(start)), size)
    counts = np.bincount(line * _CLASSES + _CLASS[data], minlength=len(start) * _CLASSES).reshape(-1, _CLASSES)
    own = np.zeros((len(start), _OWN), np.float32)
    own[:, :_CLASSES] = counts / np.maximum(size, 1)[:, None]
    own[:, 9] = np.log1p(size) / 8
    w = words(data, offsets)
    a, b = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    n_words = b - a
    own[:, 10] = np.log1p(n_words) / 8
    own[:, 11] = np.minimum(size / np.maximum(n_words, 1) / 20, 2)
    # share of words seen before in the document, and whether the whole line was
    first = np.zeros(len(w.hash), bool)
    if len(w.hash):
        by = np.lexsort((w.hash, w.row))
        r, h = w.row[by], w.hash[by]
        first[by] = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])
    fresh = np.concatenate([[0], np.cumsum(first)])
    own[:, 12] = 1 - (fresh[b] - fresh[a]) / np.maximum(n_words, 1)
    h = span_hashes(data, start, end) if len(data) else np.zeros(len(start), np.uint64)
    by = np.lexsort((h, of))
    again = np.concatenate([[False], (of[by][1:] == of[by][:-1]) & (h[by][1:] == h[by][:-1])])[:len(by)]
    own[by[again], 13] = 1
    first_line = np.searchsorted(of, np.arange(n + 1))
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first_line[:-1]] = 0
    after[first_line[1:] - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], 1), size, first_line


def marginals(score: np.ndarray, trans: np.ndarray, first: np.ndarray):
    """P(good) per line by forward-backward, all rows at once, the t-th step
    over the rows with more than t lines. ``score``: log odds of good per
    line; ``trans``: 2 x 2. Also P(pair of states) summed over neighbours, and the
    log partition function per row."""
    n = np.diff(first)
    emit = np.stack([np.zeros(len(score)), score], 1)
    f, b = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    longest = np.argsort(-n, kind="stable")
    starts, lengths = first[:-1][longest], n[longest]
    alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(n) else 0) + 1), "right")
    lse = lambda x, axis: np.logaddexp(np.take(x, 0, axis), np.take(x, 1, axis))
    for t, k in enumerate(alive):
        at = starts[:k] + t
        f[at] = emit[at] + (lse(f[at - 1][:, :, None] + trans, 1) if t else 0)
    for t in range(1, len(alive)):
        k = alive[t]
        at = starts[:k] + lengths[:k] - 1 - t
        b[at] = lse(trans + (emit[at + 1] + b[at + 1])[:, None, :], 2)
    end = first[1:] - 1
    z = np.logaddexp(f[end, 0], f[end, 1])
    zl = np.repeat(z, n)
    good = np.exp(f[:, 1] + b[:, 1] - zl)
    inner = np.ones(len(score), bool)
    inner[end] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(f[at][:, :, None] + trans + (emit[at + 1] + b[at + 1])[:, None, :] - zl[at][:, None, None])
    return good, pairs.sum(0), z


def train_crf(x: np.ndarray, first: np.ndarray, y: np.ndarray):
    """Adam on the mean log likelihood per line; classes weigh the same. (weights, transitions)."""
    n = np.diff(first)
    line_y = np.repeat(y, n)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    rows = [np.flatnonzero(y == c) for c in (0, 1)]
    mass = [max(1, n[r].sum()) for r in rows]
    lines = np.where(line_y == 1, 0.5 / mass[1], 0.5 / mass[0])
    parts = []
    for c, r in enumerate(rows):  # each class as a chain set of its own, for its pair counts
        index = np.concatenate([np.arange(first[i], first[i + 1]) for i in r])
        parts.append((x[index], np.concatenate([[0], np.cumsum(n[r])]), index, (n[r] - 1).sum(), mass[c]))
    for step in range(1, STEPS + 1):
        gw, gt = DECAY * w, DECAY * trans
        for c, (xs, fs, index, steps, weight) in enumerate(parts):
            good, pairs, _ = marginals(xs @ w, trans, fs)
            gw = gw + xs.T @ ((good - c) * lines[index])
            seen = np.zeros((2, 2))
            seen[c, c] = steps
            gt = gt + (pairs - seen) * 0.5 / weight
        for i, (p, g) in enumerate(((w, gw), (trans, gt))):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            p -= RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)
    return w, trans


def document_evidence(x, size, first, w, trans) -> np.ndarray:
    """Log odds of the length-weighted mean of P(good); empty lines weigh as one byte."""
    good, _, _ = marginals(x @ w, trans, first)
    weight = np.maximum(size, 1)
    mean = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.zeros(0)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def fit_logistic(e: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (kept positive) and intercept of weighted rows by Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * e + b, -40, 40)))
        r, s = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(r * e).sum() + 0.1 * a, r.sum()])
        h = np.array([[(s * e * e).sum() + 0.1, (s * e).sum()], [(s * e).sum(), s.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = max(1e-3, a - float(np.clip(da, -2, 2))), b - float(np.clip(db, -2, 2))
    return a, b


def _train_rows():
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.binary()), ("size", pa.binary())])

    def run(batches):
        for batch in batches:
            offsets, data = utf8_column(batch.column(1))
            for lo, hi in row_chunks(offsets):
                x, size, first = line_features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                cut = list(zip(first, first[1:]))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                                       pa.array([x[a:b].astype(np.float16).tobytes() for a, b in cut], pa.binary()),
                                       pa.array([size[a:b].astype(np.int64).tobytes() for a, b in cut], pa.binary())],
                                      schema=schema)
    return run


def fit(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES):
    """Model from at most ``max_docs`` labelled documents of each class and
    ``max_lines`` lines (documents that would pass the latter are left out,
    in order of a hash). None if a class has no document."""
    sample = labelled_sample(documents, labels, "quality", MOD, HELD, max_docs)
    rows = sample.mapInArrow(_train_rows(), "doc_id long, label int, x binary, size binary")
    xs, sizes, ys, left = [], [], [], max_lines
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        x = np.frombuffer(r.x, np.float16).reshape(-1, 3 * _OWN + 1)
        left -= len(x)
        if left < 0:
            break
        xs.append(x)
        sizes.append(np.frombuffer(r.size, np.int64))
        ys.append(r.label)
    y = np.array(ys)
    if len(set(ys)) < 2:
        return None
    x, size = np.concatenate(xs).astype(np.float32), np.concatenate(sizes)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
    w, trans = train_crf(x, first, y)
    weight = class_weights(documents, labels, "quality", MOD, HELD, y)[y]
    return w.astype(np.float32), trans, *fit_logistic(document_evidence(x, size, first, w, trans), y, weight)


def _score(model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            offsets, data = utf8_column(batch.column(1))
            scores = []
            for lo, hi in row_chunks(offsets):
                if model is None:
                    scores.append(np.full(hi - lo, 0.5))
                    continue
                w, trans, a, b = model
                x, size, first = line_features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                e = a * document_evidence(x, size, first, w, trans) + b
                scores.append(1 / (1 + np.exp(-np.clip(e, -50, 50))))
            if scores:
                yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(np.concatenate(scores))], schema=schema)
    return run


def quality(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Only the text makes the score. Null and empty texts are one empty line.
    Labels other than 0 and 1 or without a doc_id are ignored, of several labels of
    a document the smallest counts; without labels of both classes every
    score is 0.5. Repeated rows score alike. An empty table gives an empty
    result; other columns are not read.
    """
    model = fit(documents, labels, max_docs, max_lines)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (docs.mapInArrow(_score(model), "doc_id long, score double")
            .select("doc_id", held_out(MOD, HELD).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
