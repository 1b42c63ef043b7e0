"""Convolutional text classifier for toxicity, trained in numpy.

A word is a run of letters (bytes A-Z, a-z and those above ASCII), lower-cased.
Its embedding is the sum of three hashed ones: of the word and of its first
four and five bytes, so inflected forms share weight. Filters of widths 1, 2
and 3 run over a document, each is max-pooled over the whole text, and a
linear layer gives the logit. Hash slots seen in fewer than ``MIN_DOCS``
training documents stay zero, so words never seen add nothing.

Training reads every labelled document: each task trains on its partition,
the weights are averaged, and so on for some rounds. A quarter of the
documents is not fitted; the round with the least loss on it counts, and
thresholds are calibrated by language on all of it. Where documents are few a
language's is drawn towards the common one and that towards the class mix. The
language is guessed from the text's own function words, and the logit is
shifted so that the language's threshold scores 0.3.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import (
    CHUNK, held_out, known_labels, mix, release, row_chunks, rows_kept, span_hashes, utf8_column, words, written)

MOD, HELD, THRESHOLD = 4, 2, 0.3
SLOTS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 8, (1, 2, 3)
#: At most so many rounds; passes over the documents and steps of a task in all rounds, at least.
ROUNDS, PASSES, STEPS, DOCS_PER_STEP, RATE, MIN_DOCS = 10, 5, 300, 64, 0.01, 3
#: Documents that a task trains on, at least; words that it holds at once.
DOCS_PER_WORKER, BUFFER_WORDS = 6400, 2_000_000
#: Label tables up to so many rows go to the tasks whole (some 24 MB).
MAX_BROADCAST = 300_000
#: Logits are counted at each 1 / GRID between -GRID_END and GRID_END.
GRID, GRID_END = 128, 40
#: Weight of the threshold that another is drawn to, in documents of the rarer class.
PRIOR_DOCS = 5

# Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "with"),
    "de": ("der", "die", "und", "das", "von", "zu", "den", "mit"),
    "fr": ("le", "les", "des", "et", "une", "dans", "est", "un"),
    "es": ("el", "los", "y", "en", "del", "las", "por", "con"),
}
_OFFSETS = sum(WIDTHS)          # one table column group per width and place in it
_POOLED = len(WIDTHS) * FILTERS
_SPLIT, _REST = 32, "wboc"      # pieces in which slot weights are averaged; the other weights

_GAP = np.ones(256, bool)
_GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _function_table() -> list[np.ndarray]:
    out = []
    for some in FUNCTION_WORDS.values():
        data = np.frombuffer(" ".join(some).encode(), np.uint8)
        out.append(np.sort(words(data, np.array([0, len(data)]), True, _GAP).hash))
    return out


def word_slots(data: np.ndarray, offsets: np.ndarray, function_words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots of every word (n, 3) uint16, first word per row, language per
    row). Language: the most function words; ties and none: the first."""
    w = words(data, offsets, True, _GAP)
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    slots = [w.hash] + [span_hashes(low, w.start, np.minimum(w.end, w.start + k)) ^ np.uint64(k) for k in (4, 5)]
    slots = np.stack([(mix(h) >> np.uint64(64 - 15)).astype(np.uint16) for h in slots], 1)
    votes = []
    for table in function_words:
        hit = table[np.minimum(np.searchsorted(table, w.hash), len(table) - 1)] == w.hash
        votes.append(np.diff(np.concatenate([[0], np.cumsum(hit)])[w.first]))
    return slots, w.first, np.argmax(votes, 0)


def _padded(slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two empty words (slot SLOTS) after each row and two more at the end;
    new row starts."""
    pad = max(WIDTHS) - 1
    n = np.diff(first)
    starts = first[:-1] + pad * np.arange(len(n))
    out = np.full((len(slots) + pad * (len(n) + 1), slots.shape[1]), SLOTS, np.int32)
    out[np.arange(len(slots)) + pad * np.repeat(np.arange(len(n)), n)] = slots
    return out, starts


def _convolve(y: np.ndarray) -> np.ndarray:
    """Per-place products (n, _OFFSETS, FILTERS) -> (n - pad, widths * FILTERS)
    sums over each window that starts at a word."""
    n, outs, at = len(y) - max(WIDTHS) + 1, [], 0
    for width in WIDTHS:
        outs.append(sum(y[j:j + n, at + j] for j in range(width)))
        at += width
    return np.concatenate(outs, 1)


def pooled_logits(slots, first, table, bias, out, out_bias) -> np.ndarray:
    padded, starts = _padded(slots, first)
    if not len(starts):
        return np.zeros(0)
    y = table[padded[:, 0]]
    for f in range(1, padded.shape[1]):
        y += table[padded[:, f]]
    z = _convolve(y.reshape(len(y), _OFFSETS, FILTERS))
    # windows start at a row's own words; one that starts at an empty word could reach into the next row
    n = np.diff(first)
    blank = np.ones(len(z), bool)
    blank[np.arange(len(slots)) + (max(WIDTHS) - 1) * np.repeat(np.arange(len(n)), n)] = False
    z[blank] = -np.inf
    z[starts[n == 0]] = 0
    peak = np.maximum.reduceat(z, starts, axis=0)
    return np.maximum(peak + bias, 0) @ out + out_bias


def first_weights(known: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights before training; slots that aren't ``known`` (0 or 1) stay zero."""
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.1, (SLOTS + 1, DIM)) * known[:, None], "w": rng.normal(0, 0.3, (DIM, _OFFSETS * FILTERS)),
         "b": np.zeros(_POOLED), "o": rng.normal(0, 0.3, _POOLED), "c": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def net_of(p: dict[str, np.ndarray]):
    """(table, bias, out, out_bias) as ``pooled_logits`` takes them."""
    return p["e"] @ p["w"], p["b"], p["o"], float(p["c"][0])


def _gradients(p, docs: list[tuple[np.ndarray, int]], class_weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean weighted logistic loss over some documents with words;
    gradients only reach the windows that won the pooling."""
    first = np.concatenate([[0], np.cumsum([len(s) for s, _ in docs])])
    y = np.array([t for _, t in docs])
    padded, starts = _padded(np.concatenate([s for s, _ in docs]), first)
    x = p["e"][padded[:, 0]]
    for f in range(1, padded.shape[1]):
        x += p["e"][padded[:, f]]
    z = _convolve((x @ p["w"]).reshape(len(x), _OFFSETS, FILTERS))
    best = np.stack([z[a:a + n].argmax(0) + a for a, n in zip(starts, np.diff(first))])
    hidden = np.take_along_axis(z, best, 0) + p["b"]
    act = np.maximum(hidden, 0)
    prob = 1 / (1 + np.exp(-(act @ p["o"] + p["c"])))
    d = ((prob - y) * class_weight[y] / len(docs)).astype(np.float32)
    g = {"e": np.zeros_like(p["e"]), "w": np.zeros_like(p["w"]),
         "o": act.T @ d + 1e-4 * p["o"], "c": d.sum(keepdims=True)}
    dh = d[:, None] * p["o"] * (hidden > 0)
    g["b"] = dh.sum(0)
    groups = np.repeat(np.arange(len(WIDTHS)), FILTERS)
    base = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])
    slots, moves = [], []
    for f in range(_POOLED):
        for j in range(WIDTHS[groups[f]]):
            place = (base[groups[f]] + j) * FILTERS + f % FILTERS
            at = best[:, f] + j
            g["w"][:, place] += x[at].T @ dh[:, f]
            slots.append(padded[at])
            moves.append(dh[:, f, None] * p["w"][:, place])
    slots, moves = np.concatenate(slots), np.concatenate(moves)
    for f in range(slots.shape[1]):
        order = np.argsort(slots[:, f], kind="stable")
        new = np.flatnonzero(np.append(True, np.diff(slots[order, f]) != 0))
        g["e"][slots[order[new], f]] += np.add.reduceat(moves[order], new, axis=0)
    return g


class Trainer:
    """Adam over the documents given to ``fit``, from some starting weights."""

    def __init__(self, p: dict[str, np.ndarray], known: np.ndarray, class_weight: np.ndarray, passes: int, seed: int):
        self.p = {k: v.copy() for k, v in p.items()}
        self.known, self.class_weight, self.passes = known.astype(np.float32)[:, None], class_weight, passes
        self.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        self.rng, self.step = np.random.default_rng(seed), 0

    def fit(self, docs: list[tuple[np.ndarray, int]]) -> None:
        for _ in range(self.passes):
            order = self.rng.permutation(len(docs))
            for lo in range(0, len(docs), DOCS_PER_STEP):
                g = _gradients(self.p, [docs[i] for i in order[lo:lo + DOCS_PER_STEP]], self.class_weight)
                self.step += 1
                for k, v in self.p.items():
                    m, sq = self.moment[k]
                    m += 0.1 * (g[k] - m)
                    sq += 0.001 * (g[k] ** 2 - sq)
                    v -= RATE * (m / (1 - 0.9 ** self.step)) / (np.sqrt(sq / (1 - 0.999 ** self.step)) + 1e-8)
                self.p["e"] *= self.known


def best_threshold(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Largest F1 of weighted rows; the middle of the gap below the cut. Ties: the highest cut."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum((weight * y)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + (weight * y).sum())
    last = np.append(np.diff(logits[order]) != 0, True)  # cut only between different logits
    i = int(np.argmax(np.where(last, f1, -1)))
    under = logits[order][i + 1] if i + 1 < len(y) else logits[order][i] - 1
    return float((logits[order][i] + under) / 2)


def drawn_cut(logits, y, weight, towards: float) -> float:
    """The best threshold of these documents, drawn towards another as if that
    rested on ``PRIOR_DOCS`` more documents of the rarer class: a language's
    towards that of all, and that towards the log odds of the class mix."""
    n = int(min((weight * y).sum(), (weight * (1 - y)).sum()))
    own = best_threshold(logits, y, weight) if n else towards
    return (n * own + PRIOR_DOCS * towards) / (n + PRIOR_DOCS)


def _train_rows(function_words):
    """Batches of doc_id, text, label -> documents with words as slots. A
    quarter of the doc_ids isn't fitted but calibrated on."""
    schema = pa.schema([("label", pa.int32()), ("unseen", pa.bool_()), ("lang", pa.int32()), ("slots", pa.binary())])

    def run(batches):
        for batch in batches:
            offsets, data = utf8_column(batch.column("text"))
            ids = np.asarray(batch.column("doc_id")).astype(np.int64).view(np.uint64)
            label = np.asarray(batch.column("label"))
            for lo, hi in row_chunks(offsets):
                slots, first, lang = word_slots(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo],
                                                function_words)
                has = np.flatnonzero(np.diff(first))
                yield pa.record_batch([pa.array(label[lo:hi][has].astype(np.int32)),
                                       pa.array((mix(ids[lo:hi]) % np.uint64(4) == 0)[has]),
                                       pa.array(lang[has].astype(np.int32)),
                                       pa.array([slots[first[i]:first[i + 1]].tobytes() for i in has], pa.binary())],
                                      schema=schema)
    return run


def learnable_rows(documents: DataFrame, labels: DataFrame, function_words) -> DataFrame:
    """label, unseen, lang, slots of every document with words whose label may
    be learned from, written. Texts meet a label table of up to
    ``MAX_BROADCAST`` rows in their scan tasks, a larger one in a shuffle."""
    known = known_labels(labels, "toxic", MOD, HELD)
    if known.count() <= MAX_BROADCAST:
        known = F.broadcast(known)
    rows = (documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .filter(~held_out(MOD, HELD)).join(known, "doc_id").select("doc_id", "text", "label"))
    return written(rows.mapInArrow(_train_rows(function_words), "label int, unseen boolean, lang int, slots binary"),
                   "toxicity-rows", "zstd")


def _documents(batches):
    """(slots, label) of each row."""
    for batch in batches:
        for label, slots in zip(batch.column("label").to_pylist(), batch.column("slots")):
            yield np.frombuffer(slots.as_buffer(), np.uint16).reshape(-1, 3), label


def _added(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums, by piece, of the arrays that the tasks give out: a fixed number of
    small pieces, added up by the executors."""
    def add(table):
        table = table.sort_by("worker")
        total = sum(np.frombuffer(v.as_buffer(), np.float32).astype(np.float64) for v in table.column("sums"))
        return pa.table({"piece": table.column("piece").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    summed = rows.groupBy("piece").applyInArrow(add, "piece int, total binary")
    return {r.piece: np.frombuffer(r.total, np.float64) for r in summed.collect()}


def _pieces(arrays) -> pa.RecordBatch:
    n = len(arrays)
    return pa.record_batch([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)),
                            pa.array([a.astype(np.float32).tobytes() for a in arrays], pa.binary())],
                           names=["piece", "worker", "sums"])


_PIECES_SCHEMA = "piece int, worker int, sums binary"


def documents_by_slot(fitted: DataFrame) -> np.ndarray:
    """In how many documents each hash slot occurs."""
    def run(batches):
        seen = np.zeros(SLOTS + 1, np.int64)
        for slots, _ in _documents(batches):
            seen[np.unique(slots)] += 1
        yield _pieces([seen])

    return _added(fitted.mapInArrow(run, _PIECES_SCHEMA)).get(0, np.zeros(SLOTS + 1))


def one_round(fitted: DataFrame, p, known: np.ndarray, class_weight: np.ndarray, passes: int, seed: int):
    """Weights after every task has trained on all documents of its partition
    from ``p``: the mean over tasks, each weighing by its documents, for a hash
    slot by those that hold it."""
    shared = fitted.sparkSession.sparkContext.broadcast((p, known, class_weight))

    def run(batches):
        p, known, class_weight = shared.value
        trainer = Trainer(p, known, class_weight, passes, seed + TaskContext.get().partitionId())
        seen, n, some, left = np.zeros(SLOTS + 1, np.float32), 0, [], BUFFER_WORDS
        for slots, label in _documents(batches):
            seen[np.unique(slots)] += 1
            some.append((slots, label))
            n, left = n + 1, left - len(slots)
            if left <= 0:
                trainer.fit(some)
                some, left = [], BUFFER_WORDS
        trainer.fit(some)
        if n:
            table = np.concatenate([trainer.p["e"] * seen[:, None], seen[:, None]], 1)[:SLOTS]
            rest = np.concatenate([trainer.p[k].ravel() for k in _REST] + [np.ones(1, np.float32)]) * n
            yield _pieces([*np.split(table, _SPLIT), rest])

    sums = _added(fitted.mapInArrow(run, _PIECES_SCHEMA))
    shared.unpersist()
    table = np.concatenate([sums[i].reshape(-1, DIM + 1) for i in range(_SPLIT)])
    out = {"e": p["e"].copy()}
    has = np.flatnonzero(table[:, DIM])
    out["e"][has] = table[has, :DIM] / table[has, DIM:]
    rest, at = sums[_SPLIT][:-1] / sums[_SPLIT][-1], 0
    for k in _REST:
        out[k] = rest[at:at + p[k].size].reshape(p[k].shape).astype(np.float32)
        at += p[k].size
    return out


def logit_counts(rows: DataFrame, nets) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each net (logits, labels, languages, documents) over all ``rows``,
    counted at every ``GRID``-th of a logit between -``GRID_END`` and it."""
    shared = rows.sparkSession.sparkContext.broadcast(nets)

    def run(batches):
        for batch in batches:
            raw = batch.column("slots")
            counts = np.array([len(v.as_buffer()) // 6 for v in raw], np.int64)
            first = np.concatenate([[0], np.cumsum(counts)])
            for lo, hi in row_chunks(first, CHUNK // 8):
                slots = np.frombuffer(b"".join(raw[lo:hi].to_pylist()), np.uint16).reshape(-1, 3)
                for i, net in enumerate(shared.value):
                    logits = np.clip(pooled_logits(slots, first[lo:hi + 1] - first[lo], *net), -GRID_END, GRID_END)
                    yield pa.record_batch([pa.array(np.full(hi - lo, i, np.int32)), batch.column("label").slice(lo, hi - lo),
                                           batch.column("lang").slice(lo, hi - lo),
                                           pa.array(np.rint(logits * GRID).astype(np.int32))],
                                          names=["net", "label", "lang", "at"])

    counted = (rows.select("label", "lang", "slots").mapInArrow(run, "net int, label int, lang int, at int")
               .groupBy("net", "label", "lang", "at").agg(F.count("*").alias("n")).collect())
    shared.unpersist()
    counted = np.array(sorted((r.net, r.at, r.label, r.lang, r.n) for r in counted), np.int64).reshape(-1, 5)
    by_net = [counted[counted[:, 0] == i] for i in range(len(nets))]
    return [(c[:, 1] / GRID, c[:, 2], c[:, 3], c[:, 4].astype(float)) for c in by_net]


def _loss(logits, y, weight) -> float:
    """Logistic loss, classes weighing the same."""
    loss = np.logaddexp(0, np.where(y == 1, -logits, logits))
    return float(np.mean([np.average(loss[y == c], weights=weight[y == c]) for c in (0, 1)]))


def fit(documents: DataFrame, labels: DataFrame, max_docs: int | None = None):
    """Model from every document with words whose label may be learned from, or
    at most ``max_docs`` of each class for the weights, by a hash. None if a
    class has no document.

    Rounds of training: each task trains on its own partition from the same
    weights, then the weights are averaged. The round with the least loss on
    the unseen documents counts; thresholds come from all of these."""
    function_words = _function_table()
    rows = learnable_rows(documents, labels, function_words)
    try:
        size = {(r.unseen, r.label): r["count"] for r in rows.groupBy("unseen", "label").count().collect()}
        n = np.array([size.get((False, c), 0) for c in (0, 1)])
        if not n.all():
            return None
        fitted = rows.filter(~F.col("unseen"))
        if max_docs is not None:
            pick = [fitted.filter(F.col("label") == c).orderBy(F.xxhash64("slots")).limit(max_docs) for c in (0, 1)]
            fitted, n = pick[0].union(pick[1]), np.minimum(n, max_docs)
        docs = int(n.sum())
        workers = max(1, docs // DOCS_PER_WORKER)
        fitted = fitted.select("label", "slots").coalesce(workers)
        passes = max(PASSES, -(-STEPS * DOCS_PER_STEP * workers // docs))
        rounds = min(ROUNDS, passes)
        known = (documents_by_slot(fitted) >= MIN_DOCS).astype(np.float32)
        known[SLOTS] = 0
        p, nets = first_weights(known), []
        for i in range(rounds):
            p = one_round(fitted, p, known, docs / (2 * n), -(-passes // rounds), (i + 1) << 32)
            nets.append(net_of(p))
        whole_part = all(size.get((True, c)) for c in (0, 1))
        counted = logit_counts(rows.filter("unseen") if whole_part else rows, nets)
    finally:
        release(rows)
    chosen = min(range(rounds), key=lambda i: _loss(*(counted[i][j] for j in (0, 1, 3)))) if whole_part else rounds - 1
    logits, y, lang, weight = counted[chosen]
    # with classes weighing the same in training, the cut of least error is the log odds of the table's mix
    odds = np.log(sum(size.get((u, 0), 0) for u in (True, False)) / sum(size.get((u, 1), 0) for u in (True, False)))
    whole = drawn_cut(logits, y, weight, odds)
    cuts = [drawn_cut(logits[lang == g], y[lang == g], weight[lang == g], whole) for g in range(len(function_words))]
    return nets[chosen], np.array(cuts), function_words


def text_scores(model, offsets, data) -> np.ndarray:
    """Scores of some texts, a megabyte of them at a time."""
    if model is None:
        return np.zeros(len(offsets) - 1)
    net, cuts, function_words = model
    out = [np.zeros(0)]
    for lo, hi in row_chunks(offsets):
        slots, first, lang = word_slots(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], function_words)
        logit = pooled_logits(slots, first, *net) - cuts[lang] + np.log(THRESHOLD / (1 - THRESHOLD))
        out.append(1 / (1 + np.exp(-np.clip(logit, -50, 50))))
    return np.concatenate(out)


def _score(model):
    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0).cast(pa.int64()),
                                   pa.array(text_scores(model, *utf8_column(batch.column(1))))], names=["doc_id", "score"])
    return run


def without_toxic(documents: DataFrame, labels: DataFrame, max_docs: int | None = None) -> DataFrame:
    """The rows, with all columns, that ``toxicity`` predicts 0."""
    model = fit(documents, labels, max_docs)
    return rows_kept(documents, lambda offsets, data: text_scores(model, offsets, data) < THRESHOLD)


def toxicity(documents: DataFrame, labels: DataFrame, max_docs: int | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Only the text makes the score. Null and empty texts score as texts
    without words. Labels other than 0 and 1 or without a doc_id are ignored,
    of several labels of a document the smallest counts; without labels of
    both classes every score is 0. Repeated rows score alike. An empty table
    gives an empty result; other columns are not read.
    """
    model = fit(documents, labels, max_docs)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (docs.mapInArrow(_score(model), "doc_id long, score double")
            .select("doc_id", held_out(MOD, HELD).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
