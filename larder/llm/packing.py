"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of at most the longest permitted length. Pieces
are dealt to groups of bounded size by a hash, and each group
is packed on its own, longest piece first:

* a piece goes into the open bin with the least room that still holds it;
* if none does, it opens the permitted length whose cost per token is least,
  given the piece and all that is still to come. This weighs the lengths
  against each other: a long bin pays off only while there is more to fill it;
* at the end each bin shrinks to the least length that holds its contents.

The cost of a sequence of c tokens is ``overhead + c + c*c / quadratic``: a
fixed part, a linear part, and attention.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import row_chunks, utf8_column, words, written

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD, QUADRATIC = 64, 16384
GROUP_PIECES = 20_000

_OUT = ("group_id int, bin_id int, capacity int, bin_used int, offset int, doc_id long, piece int, "
        "start long, length int")


def sequence_cost(c: int, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> float:
    return overhead + c + c * c / quadratic


def best_fit(sizes: list[int], lengths=LENGTHS, cost=sequence_cost) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Sizes in falling order -> (bin, offset) per piece, capacity and fill per bin."""
    lengths = sorted(lengths)
    left = sum(sizes)
    rooms: list[int] = []            # distinct rooms of open bins, rising
    bins_of: dict[int, list[int]] = {}
    places, used, capacity = [], [], []

    def put(b: int, room: int) -> None:
        if room:
            if room not in bins_of:
                bisect.insort(rooms, room)
                bins_of[room] = []
            bins_of[room].append(b)

    for size in sizes:
        i = bisect.bisect_left(rooms, size)
        if i < len(rooms):
            room = rooms[i]
            b = bins_of[room].pop()
            if not bins_of[room]:
                del bins_of[room], rooms[i]
        else:
            # cost per token if the rest fills the bin as far as it can
            room = min((c for c in lengths if c >= size), key=lambda c: (cost(c) / min(c, left), c))
            b = len(used)
            used.append(0)
            capacity.append(room)
        places.append((b, used[b]))
        used[b] += size
        left -= size
        put(b, room - size)
    return places, [min(c for c in lengths if c >= u) for u in used], used


def _lengths():
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        for batch in batches:
            offsets, data = utf8_column(batch.column(1))
            n = [words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]).counts + 1
                 for lo, hi in row_chunks(offsets)]
            if n:
                yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(np.concatenate(n).astype(np.int64))],
                                      schema=schema)
    return run


def word_lengths(documents: DataFrame) -> DataFrame:
    """doc_id, tokens: words plus one end mark. Null and empty texts: 1."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _lengths(), "doc_id long, tokens long")


def _pack(lengths, overhead, quadratic):
    def cost(c):
        return sequence_cost(c, overhead, quadratic)

    def run(key, table):
        order = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        places, capacity, used = best_fit(order.column("length").to_pylist(), lengths, cost)
        bins = np.array([b for b, _ in places])
        cols = [order.column("group_id"), pa.array(bins, pa.int32()), pa.array(np.array(capacity)[bins], pa.int32()),
                pa.array(np.array(used)[bins], pa.int32()), pa.array([o for _, o in places], pa.int32()),
                *(order.column(c) for c in ("doc_id", "piece", "start", "length"))]
        return pa.table(cols, names=["group_id", "bin_id", "capacity", "bin_used", "offset", "doc_id", "piece",
                                     "start", "length"])
    return run


def pack(lengths_of: DataFrame, lengths=LENGTHS, overhead: float = OVERHEAD, quadratic: float = QUADRATIC,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, tokens) -> one row per piece: its group and bin, the bin's
    final capacity and fill, and where in bin and document the piece lies.

    Every token of every row is in exactly one piece. The number of groups
    follows the number of pieces, each group holds about ``group_pieces``; at
    most one bin in each group and length is left part empty for want of pieces. Pieces
    are dealt by a row number fixed when they are written, so repeated rows
    and null ids spread like others. Null or non-positive token counts give no piece; null doc_ids are packed
    like others. An empty table gives an empty result.
    """
    most = max(lengths)
    pieces = (lengths_of.filter("tokens > 0")
              .select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {most}")))
                      .alias("n"))
              .select("doc_id", F.col("n").cast("int").alias("piece"), (F.col("n") * most).alias("start"),
                      F.least(F.lit(most), F.col("tokens") - F.col("n") * most).cast("int").alias("length")))
    pieces = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = 1 + pieces.count() // group_pieces
    dealt = pieces.withColumn("group_id", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).drop("row")
    return dealt.groupBy("group_id").applyInArrow(_pack(tuple(lengths), overhead, quadratic), _OUT)
