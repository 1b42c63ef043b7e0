"""Quality rules with host-level verdicts.

Each document is tested by simple rules. Failures are summed per host (its
source), and every host's rate is shrunk towards the corpus by a beta prior
fitted to all hosts by moments (empirical Bayes). A host whose posterior holds
the rate above ``max_rate`` even ``CAUTION`` standard deviations below its mean
loses all its documents, so few documents convict no host; of the others those
that are ``base_failed`` go, and those that fail only another rule count
against their host and stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import row_chunks, span_hashes, utf8_column, window_hashes, words, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 50, 50
#: A host fails when over half of its documents do, with the posterior's 2.3 % tail to spare.
MAX_RATE, CAUTION = 0.5, 2.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeats(keys_row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys listed by row, in order: which occur twice in their row, and
    which of those are not the first."""
    by = np.lexsort((keys, keys_row))
    r, k = keys_row[by], keys[by]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[by[1:][same]] = True
    twice[by[1:][same]] = twice[by[:-1][same]] = True
    return twice, later


def _chunk_stats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x _STATS."""
    n = len(offsets) - 1
    w = words(data, offsets)
    per_row = lambda at: np.diff(np.searchsorted(at, offsets))
    out = np.zeros((n, len(_STATS)), np.int64)
    out[:, 0] = w.counts
    # code points: bytes of words that don't continue a character
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out[:, 1] = np.bincount(w.row, chars[w.end] - chars[w.start], n) if len(w.hash) else 0
    out[:, 2] = per_row(np.flatnonzero(_SYMBOL[data]))
    # lines with a word, by row
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    start = start[start < len(data)]
    end = np.concatenate([start[1:], [len(data)]])[:len(start)]
    end = end - ((end > start) & (data[end - 1] == 10)) if len(start) else end
    inked = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[inked], end[inked]
    line_row = np.searchsorted(offsets, start, "right") - 1
    out[:, 5] = np.bincount(line_row, minlength=n)
    _, later = _repeats(line_row, span_hashes(data, start, end))
    out[:, 3] = np.bincount(line_row[later], minlength=n)
    if len(w.hash) >= 3:
        row = w.row
        at = np.flatnonzero(row[2:] == row[:-2])
        twice, _ = _repeats(row[at], window_hashes(w.hash, 3)[at])
        covered = np.zeros(len(row), bool)
        for j in range(3):
            covered[at[twice] + j] = True
        out[:, 4] = np.bincount(row[covered], minlength=n)
    return out


def _document_stats():
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string())] + [(s, pa.int64()) for s in _STATS])

    def run(batches):
        for batch in batches:
            offsets, data = utf8_column(batch.column(2))
            parts = [_chunk_stats(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                     for lo, hi in row_chunks(offsets)]
            if parts:
                stats = np.concatenate(parts)
                yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()),
                                       *(pa.array(stats[:, i]) for i in range(len(_STATS)))], schema=schema)
    return run


def document_stats(documents: DataFrame) -> DataFrame:
    """Counts of each document and the rules it fails.

    base_failed: fewer than 50 words, or over half of the words repeated.
    failed: base_failed, or over half as many symbols as words, or over half
    of the lines with a word equal to an earlier one. Null text counts as
    empty and fails by its word count.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return (docs.mapInArrow(_document_stats(), "doc_id long, host string, " + ", ".join(f"{s} long" for s in _STATS))
            .withColumn("base_failed", base)
            .withColumn("failed", base | (F.col("n_symbols") * 100 > F.col("n_words") * MAX_SYMBOL_PERCENT)
                        | (F.col("n_dup_lines") * 100 > F.col("n_lines") * MAX_DUP_LINE_PERCENT)))


def host_rates(stats: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, least_rate over hosts that are not null.

    With p_i = failed share of host i: m = mean(p_i), v = var_samp(p_i), and
    the prior's strength s = m(1-m)/v - 1, kept between 1 and 1e6 (one host,
    or hosts all alike: 1e6; an undefined one: 1). Rate = (n_failed + m s) / (n_docs + s).
    least_rate is that mean of the beta posterior less CAUTION times its
    standard deviation, sqrt(rate (1 - rate) / (n_docs + s + 1)).
    """
    hosts = written(stats.filter("host is not null").groupBy("host")
                    .agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")), "hosts")
    share = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(share).alias("m"), F.var_samp(share).alias("v")).select(
        "m", F.when(F.coalesce("v", F.lit(0.0)) <= 1e-12, F.lit(1e6)).otherwise(
            F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.expr("m * (1 - m) / v - 1")))).alias("s"))
    m, strength = prior.first()
    m, strength = F.lit(m).cast("double"), F.lit(strength).cast("double")
    rate, weight = F.col("shrunk_rate"), F.col("n_docs") + strength
    return (hosts.select("host", "n_docs", "n_failed", ((F.col("n_failed") + m * strength) / weight).alias("shrunk_rate"))
            .withColumn("least_rate", rate - CAUTION * F.sqrt(rate * (1 - rate) / (weight + 1))))


def host_quality(documents: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, host, the counts, base_failed, failed, shrunk_rate, least_rate,
    host_failed, kept: one row per input row.

    kept is false for base_failed and for documents of a host whose least_rate
    passes ``max_rate``. A null source has no host: its rates are null and the
    host can't fail. Repeated rows count each time; a very long text is counted
    in one task. An empty table gives an empty result; other columns are not
    read.
    """
    stats = written(document_stats(documents), "document-stats")
    rates = host_rates(stats).select("host", "shrunk_rate", "least_rate")
    return (stats.join(rates, "host", "left")
            .withColumn("host_failed", F.coalesce(F.col("least_rate") > max_rate, F.lit(False)))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")))
