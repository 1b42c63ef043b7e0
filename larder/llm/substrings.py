"""Substring dedup: Rabin-Karp hashes of every window of ``window`` words.

A window is a repeat when its word sequence also starts earlier: in a smaller
doc_id, or earlier in the same document. Words covered by repeats go.

1. ``mapInArrow`` hashes every window. Within a chunk of documents only the
   first occurrence of a hash goes to its hash range; later ones are repeats
   already and go to the bucket of their document, so a passage that a third
   of all documents share costs its range one entry a chunk. Entries are packed:
   per range one row with the document keys, and 8 bytes of hash and 2 to 4 of
   position per window.
2. Each hash range finds the first occurrence of every hash and returns the
   starts of all others, packed by buckets of documents. Repeats known before
   pass through in groups of their bucket.
3. Each bucket merges the starts of a document into maximal removal intervals,
   and these are joined to the texts.

Documents are told apart by doc_id and a checksum of their text. The hash has
64 bits: n windows give about n**2 / 2**65 chance collisions.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import mix, quoted, row_chunks, utf8_column, window_hashes, words

WINDOW = 20
#: Bytes of text whose windows one hash range holds, and one chunk of documents.
RANGE_BYTES, CHUNK_BYTES = 12 << 20, 2 << 20
_NO_ID = np.iinfo(np.int64).max

_PACKED = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("sums", pa.binary()), ("counts", pa.binary()),
                     ("starts", pa.binary()), ("hashes", pa.binary())])
_BUCKETS = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("sums", pa.binary()), ("counts", pa.binary()),
                      ("starts", pa.binary())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("sum", pa.int32()), ("spans", pa.binary())])


def _ids(column) -> np.ndarray:
    return np.array(column.cast(pa.int64()).fill_null(_NO_ID))


def _planes(x: np.ndarray, kind) -> bytes:
    """Byte planes one after another: high bytes are mostly zero and compress."""
    x = np.ascontiguousarray(x, kind)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _entry(ids, sums, row, start):
    """Packed starts; ``row`` (ascending) points into the documents ``ids``, ``sums``."""
    docs, counts = np.unique(row, return_counts=True)
    head = np.concatenate([[0], np.cumsum(counts)[:-1]])
    gaps = np.diff(start.astype(np.int64), prepend=np.int64(0))
    gaps[head] = start[head]
    return (_planes(np.diff(ids[docs], prepend=np.int64(0)), np.int64), _planes(sums[docs], np.uint32),
            _planes(counts, np.uint32), _planes(gaps, np.uint32))


def _unpacked(packed):
    """Entries -> (ids, sums) of documents, and per window its document and start."""
    docs, rows, starts, n_docs = [], [], [], 0
    for ids, sums, counts, gaps in packed:
        counts, gaps = _unplanes(counts, np.uint32), _unplanes(gaps, np.uint32)
        docs.append((np.cumsum(_unplanes(ids, np.int64)), _unplanes(sums, np.uint32)))
        rows.append(np.repeat(np.arange(n_docs, n_docs + len(counts), dtype=np.int32), counts))
        total = np.cumsum(gaps.astype(np.int64))
        head = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        starts.append((total - np.repeat(total[head] - gaps[head], counts)).astype(np.uint32))
        n_docs += len(counts)
    ids, sums = (np.concatenate(x) for x in zip(*docs))
    return ids, sums, np.concatenate(rows), np.concatenate(starts)


def _bucket(ids: np.ndarray, sums: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each document."""
    return (mix(ids.view(np.uint64) ^ sums.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _hash_windows(k: int, parts: int):
    def chunk(ids, offsets, data):
        sums = np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets, offsets[1:])], np.uint32)
        order = np.lexsort((sums, ids))
        ids, sums = ids[order], sums[order]
        fresh = np.append(True, (ids[1:] != ids[:-1]) | (sums[1:] != sums[:-1]))  # a repeated row counts once
        order, ids, sums = order[fresh], ids[fresh], sums[fresh]
        w = words(data, offsets)
        grams = window_hashes(w.hash, k)
        n = np.maximum(w.counts[order] - k + 1, 0)
        if not n.sum():
            return
        row = np.repeat(np.arange(len(order)), n)
        start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        h = grams[np.repeat(w.first[:-1][order], n) + start]
        by = np.argsort(h, kind="stable")  # within a hash by document, then start
        h, row, start = h[by], row[by], start[by]
        head = np.maximum.accumulate(np.where(np.diff(h, prepend=h[0] ^ np.uint64(1)) != 0, np.arange(len(h)), 0))
        later = (ids[row] != ids[row[head]]) | (start != start[head])
        part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        part = np.where(later, parts + _bucket(ids, sums, parts)[row], part)
        by = np.lexsort((start, row, part))
        for pick in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
            p = int(part[pick[0]])
            yield (p, *_entry(ids, sums, row[pick], start[pick]), (h[pick] if p < parts else h[:0]).tobytes())

    def run(batches):
        for batch in batches:
            ids = _ids(batch.column(0))
            offsets, data = utf8_column(batch.column(1))
            for lo, hi in row_chunks(offsets, CHUNK_BYTES):
                rows = list(chunk(ids[lo:hi], offsets[lo:hi + 1] - offsets[lo], data[offsets[lo]:offsets[hi]]))
                for i in range(0, len(rows), 512):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 512]), _PACKED.types)],
                                          schema=_PACKED)
    return run


def _repeats_of_range(buckets: int):
    """All packed rows of one hash range -> its repeats, packed again by
    buckets of documents. Keys from ``buckets`` on are the rows of a bucket."""
    def run(key, table):
        part = key[0].as_py()
        if part >= buckets:
            return pa.table([pa.array(np.full(len(table), part - buckets, np.int32)), *table.columns[1:5]],
                            schema=_BUCKETS)
        *packed, hashes = (table.column(i).to_pylist() for i in range(1, 6))
        ids, sums, rows, starts = _unpacked(zip(*packed))
        hashes = np.frombuffer(b"".join(hashes), np.uint64)
        out = np.zeros(len(hashes), bool)
        by = np.argsort(hashes, kind="stable")
        h = hashes[by]
        same = h[1:] == h[:-1]
        busy = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(h) else by
        if len(busy):
            at, h = by[busy], h[busy]
            inner = np.lexsort((starts[at], ids[rows[at]], h))
            at, h = at[inner], h[inner]
            head = np.maximum.accumulate(np.where(np.diff(h, prepend=h[0] ^ np.uint64(1)) != 0, np.arange(len(h)), 0))
            out[at[(ids[rows[at]] != ids[rows[at[head]]]) | (starts[at] != starts[at[head]])]] = True
        at = np.flatnonzero(out)
        at = at[np.lexsort((starts[at], sums[rows[at]], ids[rows[at]]))]
        # one entry per document and start, however often the row was repeated
        docs, first = _documents(ids[rows[at]], sums[rows[at]])
        row, start = docs, starts[at]
        keep = np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1]))[:len(row)]
        ids, sums, row, start = ids[rows[at[first]]], sums[rows[at[first]]], row[keep], start[keep]
        bucket = _bucket(ids, sums, buckets)[row] if len(ids) else row
        by = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
        cols = [(int(bucket[by[a]]), *_entry(ids, sums, row[by[a:b]], start[by[a:b]])) for a, b in zip(cut, cut[1:])]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*cols) if cols else [[]] * 5, _BUCKETS.types)],
                        schema=_BUCKETS)
    return run


def _documents(ids: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys in order: number of the document, and where each begins."""
    new = np.append(True, (ids[1:] != ids[:-1]) | (sums[1:] != sums[:-1]))[:len(ids)]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _intervals(k: int):
    """All starts of one bucket -> maximal removal intervals per document."""
    def run(key, table):
        ids, sums, rows, starts = _unpacked(zip(*(table.column(i).to_pylist() for i in range(1, 5))))
        ids, sums = ids[rows], sums[rows]
        by = np.lexsort((starts, sums, ids))
        ids, sums, starts = ids[by], sums[by], starts[by].astype(np.int64)
        doc, first = _documents(ids, sums)
        begin = np.append(True, (doc[1:] != doc[:-1]) | (starts[1:] > starts[:-1] + k))
        head = np.flatnonzero(begin)
        spans = np.stack([starts[head], np.append(starts[head[1:] - 1], starts[-1:]) + k], 1).astype(np.int32)
        cut = np.searchsorted(head, np.append(first, len(doc)))
        return pa.table([pa.array(ids[first]), pa.array(sums[first].view(np.int32)),
                         pa.array([spans[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], schema=_SPANS)
    return run


def _squeeze(batches):
    """Adds the checksum; texts travel through the shuffle compressed."""
    names = ["doc_id", "sum", "packed", "carried"]
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        offsets, data = utf8_column(batch.column(1))
        sums, packed = [], []
        for a, b in zip(offsets, offsets[1:]):
            text = data[a:b].tobytes()
            sums.append(zlib.crc32(text))
            packed.append(pack.compress(text))
        yield pa.record_batch([pa.array(_ids(batch.column(0))), pa.array(np.array(sums, np.uint32).view(np.int32)),
                               pa.array(packed, pa.binary()), batch.column(2)], names=names)


def _cut(k: int, with_text: bool):
    """(doc_id, text without its repeats) rows. The kept words of a document
    with a repeat are joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_crc32", pa.int64()), ("n_words", pa.int64()),
                        ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                        ("intervals", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                       + [("kept_text", pa.string())] * with_text)

    def one(packed, spans):
        text = zstandard.ZstdDecompressor().decompress(packed)
        data = np.frombuffer(text, np.uint8)
        w = words(data, np.array([0, len(data)]))
        n = len(w.hash)
        intervals, gone = [], np.zeros(n, bool)
        for a, b in np.frombuffer(spans or b"", np.int32).reshape(-1, 2).tolist():
            intervals.append({"start": a, "end": b})
            gone[a:b] = True
        stay = np.flatnonzero(~gone)
        joined = b" ".join([text[a:b] for a, b in zip(w.start[stay].tolist(), w.end[stay].tolist())])
        out = (zlib.crc32(text), n, n - len(stay), hashlib.sha256(joined).hexdigest(), intervals)
        return out + ((joined if intervals else text).decode("utf-8"),) * with_text

    def run(batches):
        for batch in batches:
            ids = np.array(batch.column(0))
            for lo in range(0, len(ids), 256):
                some = batch.slice(lo, 256)
                cols = list(zip(*[one(p, s) for p, s in zip(some.column(1).to_pylist(), some.column(2).to_pylist())]))
                mine = ids[lo:lo + 256]
                yield pa.record_batch([pa.array(mine, mask=mine == _NO_ID),
                                       *(pa.array(c, t) for c, t in zip(cols, schema.types[1:])), some.column(3)],
                                      names=[*schema.names, "carried"])
    return run


def remove_repeats(documents: DataFrame, window: int = WINDOW, with_text: bool = False,
                   range_bytes: int = RANGE_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text_crc32, n_words, n_removed, kept_sha256, intervals (word
    positions, maximal, [start, end)), carried (a struct of was_null, whether
    the text was null, and row, a struct of the input columns in ``carry``) and with ``with_text`` kept_text, one
    row per input row.

    kept_text is the untouched text when nothing is removed. Null text counts
    as empty; texts under ``window`` words have no window. Rows that repeat a
    doc_id and its text are one document and lose the same words. A null
    doc_id sorts after all others. A very long text is hashed whole in one task
    and cut whole in another. An empty table gives an empty result; other
    columns are not read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                            F.struct(F.col("text").isNull().alias("was_null"),
                                     *([F.struct(*quoted(carry)).alias("row")] if carry else [])).alias("carried"))
    texts = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + int(total) // range_bytes
    packed = texts.mapInArrow(_hash_windows(window, parts),
                             "part int, ids binary, sums binary, counts binary, starts binary, hashes binary")
    repeats = (packed.groupBy("part").applyInArrow(_repeats_of_range(parts), "bucket int, ids binary, sums binary, "
                                                   "counts binary, starts binary")
               .groupBy("bucket").applyInArrow(_intervals(window), "doc_id long, sum int, spans binary"))
    kind = docs.schema["carried"]
    squeezed = docs.mapInArrow(_squeeze, T.StructType.fromDDL("doc_id long, sum int, packed binary").add(kind))
    schema = T.StructType.fromDDL(
        "doc_id long, text_crc32 long, n_words long, n_removed long, kept_sha256 string, "
        "intervals array<struct<start:int,end:int>>" + ", kept_text string" * with_text).add(kind)
    return (squeezed.join(repeats, ["doc_id", "sum"], "left").select("doc_id", "packed", "spans", "carried")
            .mapInArrow(_cut(window, with_text), schema))
