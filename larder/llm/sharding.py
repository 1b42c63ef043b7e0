"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by a 63-bit key: the text's CRC-32, then 31 bits of a hash
of doc_id, so that copies of one text lie together and still can be divided.

1. A sample of keys, drawn with a chance in proportion to size (by a hash, so
   a retried task draws the same rows), gives quantile boundaries.
2. Every range is measured exactly. Ranges over twice the target get further
   splitters from their own quantiles until none is overfull or divisible.
3. Prefix sums of the ranges' sizes plus a running sum inside each range give
   every record its byte position in the whole order; equal stretches of
   bytes are the shards, so shards differ by one record at most at each end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import written

SHARDS = 16
#: Ranges per shard, expected sample keys per range, rounds of subdivision: all bound what meets in one place.
RANGES_PER_SHARD, SAMPLE_PER_RANGE, ROUNDS = 64, 64, 3


def records(documents: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return documents.select(
        doc_id.alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")).withColumn(
        "key", F.shiftleft(F.col("text_crc32"), 31) + F.xxhash64(F.coalesce("doc_id", F.lit(-1))).bitwiseAND(F.lit((1 << 31) - 1)))


def _quantiles(n: int) -> Column:
    return F.expr(f"percentile_approx(key, array({', '.join(f'{i / n!r}D' for i in range(1, n))}), {100 * n})")


def _range_of(bounds: list[int]) -> Column:
    """Number of boundaries <= key, by two short searches in literal arrays."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    below = lambda some: F.size(F.filter(some, lambda b: b <= F.col("key")))
    literal = lambda some: F.expr(f"array({', '.join(f'{b}L' for b in some)})")
    table = literal(bounds)
    coarse = below(literal(bounds[step - 1::step])) * step
    return coarse + below(F.slice(table, coarse + 1, step))


def splitters(rows: DataFrame, ranges: int) -> list[int]:
    """Sorted key boundaries of about ``ranges`` ranges near equal in bytes.
    The driver gets some thousand numbers at most, however large the input."""
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return []
    draw = F.pmod(F.xxhash64("key", "doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(draw * float(total) < F.col("size") * float(ranges * SAMPLE_PER_RANGE))
    bounds = sorted(set(sample.agg(_quantiles(ranges)).first()[0] or ()))
    for _ in range(ROUNDS):
        sizes = rows.groupBy(_range_of(bounds).alias("range")).agg(
            F.sum("size").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        full = sizes.filter((F.col("size") > 2.0 * total / ranges) & (F.col("lo") < F.col("hi"))).select("range").collect()
        if not full:
            break
        within = rows.withColumn("range", _range_of(bounds)).filter(F.col("range").isin([r.range for r in full]))
        more = within.groupBy("range").agg(_quantiles(8).alias("cut"), F.max("key").alias("hi")).collect()
        bounds = sorted({*bounds, *(b for r in more for b in [*r.cut, r.hi])})
    return bounds


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, range, shard, slot: one row per input row.

    Shards hold equal stretches of the bytes in key order; slot numbers the
    records of a shard from 0 without gaps. A null text is an empty one, a
    null doc_id sorts first among equal keys. Repeated rows get slots of their own. A
    record longer than a shard's share fills its shard alone, and some shards
    may stay empty. An empty table gives an empty result; other columns are
    not read.
    """
    rows = written(records(documents), "records")
    ranges = shards * RANGES_PER_SHARD
    bounds = splitters(rows, ranges)
    ranged = rows.withColumn("range", _range_of(bounds))
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # some thousand rows at most
    starts = sizes.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                          F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
                          F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("range").orderBy("key", "doc_id", "size")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (ranged.join(F.broadcast(starts), "range")
              .withColumn("at", F.col("bytes_before") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
              .withColumn("row", F.col("rows_before") + F.row_number().over(inside) - 1)
              .withColumn("shard", F.expr(f"least({shards - 1}, cast(((2 * at + size) * {shards}) div (2 * total) as int))"))
              .select("doc_id", "size", "text_crc32", "range", "shard", "row"))
    placed = written(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row per shard
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "range", "shard", (F.col("row") - F.col("first")).alias("slot")))
