"""Shared helpers: tables, written intermediates, and words of UTF-8 columns
as numpy arrays.

Words are the maximal runs of bytes other than space and 0x09-0x0D. Those six
bytes never occur inside a multi-byte UTF-8 character, so words can be found
on the bytes of a whole Arrow column at once.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import ensure_checkpoint_dir

#: Bytes of text that one round of numpy work holds (times about 20 in temporaries).
CHUNK = 1 << 20

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: lineage is cut and every executor can read the rows again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables that ``written`` returned and that nothing reads any more."""
    for df in frames:
        delete_path(df.sparkSession, df.written_to)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def quoted(columns) -> list:
    """Columns by their exact names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def rows_kept(documents: DataFrame, keep) -> DataFrame:
    """The rows of ``documents``, all columns as they are, for which ``keep``
    (offsets and bytes of some texts) is true. Rows are judged and passed on in
    one task, a few megabytes of text at a time; nothing is shuffled."""
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            offsets, data = utf8_column(batch.column(at))
            for lo, hi in row_chunks(offsets, 4 * CHUNK):
                good = keep(offsets[lo:hi + 1] - offsets[lo], data[offsets[lo]:offsets[hi]])
                if good.any():
                    yield batch.slice(lo, hi - lo).filter(pa.array(good))

    # columns go by number there: Spark would read a name with dots or backticks as an expression
    plain = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*documents.columns)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(of: int, n: int) -> np.ndarray:
    """of**0 .. of**(n-1) modulo 2**64."""
    have = _powers.get(of)
    if have is None or len(have) < n:
        have = np.full(max(1024, 2 * n), of, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[of] = have
    return have[:n]


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], data[off[0]:off[-1]]


def row_chunks(offsets: np.ndarray, size: int = CHUNK):
    """Row ranges of at most ``size`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


class Words(NamedTuple):
    hash: np.ndarray    # uint64 per word
    start: np.ndarray   # byte position of the first byte
    end: np.ndarray     # byte position after the last byte
    first: np.ndarray   # per row: index of its first word; one more entry than rows

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _spans(data: np.ndarray, row_starts: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ink = ~gap[data]
    begin, end = ink.copy(), ink.copy()
    begin[1:] &= ~ink[:-1]
    end[:-1] &= ~ink[1:]
    at = row_starts[row_starts < len(data)]
    begin[at] = ink[at]
    at = at[at > 0] - 1
    end[at] = ink[at]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span of bytes, one prefix sum for all."""
    if not len(start):
        return np.zeros(0, np.uint64)
    x = data.astype(np.uint64)
    x += np.uint64(1)
    x *= powers(_INVERSE, len(x))
    np.cumsum(x, out=x)
    x = np.concatenate([np.zeros(1, np.uint64), x])
    h = (x[end] - x[start]) * powers(_BASE, len(data) + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, gap: np.ndarray = _SPACE) -> Words:
    """Words of all rows; ``gap`` marks the bytes between words. Long data are
    walked in pieces cut at gaps, so temporaries stay near CHUNK however long
    a row is."""
    n, cuts = len(data), [0]
    while n - cuts[-1] > 2 * CHUNK:
        at = cuts[-1] + CHUNK
        while at < n and not (open_at := gap[data[at:at + 4096]]).any():
            at += 4096
        cuts.append(min(n, at + int(open_at.argmax()) if at < n else n))
    if cuts[-1] < n or n == 0:
        cuts.append(n)
    hashes, starts, ends = [], [], []
    for a, b in zip(cuts, cuts[1:]):
        piece = data[a:b]
        rows = offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b)] - a
        s, e = _spans(piece, rows, gap)
        hashes.append(span_hashes(LOWER[piece] if lower else piece, s, e))
        starts.append(s + a)
        ends.append(e + a)
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``k`` values: H = sum x[i+j] * c**j
    modulo 2**64 (c odd), from one prefix sum; length len(hashes) - k + 1."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(_INVERSE, n))])
    return mix((total[k:] - total[:-k]) * powers(_BASE, n)[:n - k + 1])


def sequence_hash(hashes: np.ndarray) -> int:
    """Hash of a whole short sequence; its length is part of it."""
    return int(window_hashes(hashes, len(hashes))[0]) ^ (len(hashes) * 0xA24BAED4963EE407 & _M64) if len(hashes) else 0


def known_labels(labels: DataFrame, label: str, mod: int, held: int) -> DataFrame:
    """doc_id, label of the documents whose label may be learned from: none
    with crc32(doc_id) mod ``mod`` = ``held``; the smallest of several counts."""
    return (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
            .filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) != held))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, mod: int, held: int,
                    most: int) -> DataFrame:
    """Texts and labels to learn from: at most ``most`` labelled documents of
    each class, by a hash of doc_id. The sample is small, so documents are
    filtered by a broadcast."""
    known = known_labels(labels, label, mod, held)
    pick = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(pick[0].union(pick[1])), "doc_id"))


def class_weights(documents: DataFrame, labels: DataFrame, label: str, mod: int, held: int, used) -> np.ndarray:
    """Per class, the rows of the whole table whose label may be learned from
    for each one in ``used`` (the labels of the rows taken): with these
    weights a sample capped by class has the table's mix."""
    rows = documents.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    counted = rows.join(known_labels(labels, label, mod, held), "doc_id").groupBy("label").agg(F.sum("n").alias("n"))
    total = {r.label: r.n for r in counted.collect()}
    taken = np.bincount(used, minlength=2)
    return np.array([total.get(c, 0) / max(1, taken[c]) for c in (0, 1)])


def held_out(mod: int, held: int):
    """Whether a document's label may not be learned from; null ids: false."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) == held, F.lit(False))


#: Bits of a key filter: 16 a key, at most 2**27 (16 MB) however many keys.
_FILTER_BITS = (16, 27)
_PROBES = 4


def _probes(h: np.ndarray, bits: int):
    """Bit positions of keys (uint64), one array per probe."""
    step = mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    for i in range(_PROBES):
        yield (h + np.uint64(i) * step) >> np.uint64(64 - bits)


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter (bytes) of the 64-bit hashes in ``column``, set by a
    distributed bitmap aggregate; only its pages, 16 MB at most, reach the
    driver. Beyond some eight million keys it lets more and more pass."""
    low, high = _FILTER_BITS
    bits = min(high, max(low, (16 * keys.count()).bit_length()))

    def run(batches):
        for batch in batches:
            h = np.array(batch.column(0).drop_null()).view(np.uint64)
            for at in _probes(h, bits):
                yield pa.record_batch([pa.array(at.view(np.int64) + 1)], names=["at"])

    pages = (keys.select(column).mapInArrow(run, "at long").groupBy(F.bitmap_bucket_number("at").alias("page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")))
    out = np.zeros(max(4096, 1 << bits >> 3), np.uint8)
    for r in pages.collect():
        out[(r.page - 1) * 4096:r.page * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def passes(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be among the filter's keys (no false no)."""
    bits = (8 * len(filter_)).bit_length() - 1
    out = np.ones(len(h), bool)
    for at in _probes(h, bits):
        out &= (filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
    return out
