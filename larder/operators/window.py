"""Running sums that stay bounded per task.

``sum(x) OVER (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING)`` puts a
whole key in one task; a key holding a third of the data would make that
task a third of the job. ``running_sum`` splits each key into chunks of
``chunk`` consecutive sequence numbers:

1. per (key, chunk) totals - a partial aggregate, tiny;
2. each chunk's offset = sum of the earlier chunks' totals of its key - a
   window over the totals table (n / chunk rows per key);
3. within-chunk running sums - windows of at most ``chunk`` rows;
4. result = offset + within-chunk sum (equi join on key and chunk).

Exact for any data, with every window bounded by ``chunk`` rows or by the
(n / chunk)-row totals table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = 100_000


def running_sum(df: DataFrame, keys: Sequence[str], seq_col: str, value_col: str | Column,
                out_col: str, chunk: int = DEFAULT_CHUNK,
                count_col: str | None = None, beside: DataFrame | None = None) -> DataFrame:
    """Add ``out_col`` = sum of ``value_col`` (a column or an expression) over
    rows of the same ``keys`` with ``seq_col`` <= this row's (``seq_col``
    unique within a key). With ``count_col``, also add the number of rows of
    the key (from the same small totals table, no extra pass).

    Rows of ``beside`` are put among those of ``df`` by the same keys and
    numbers and add nothing to any sum. All come back in chunks (``_chunk``),
    so who looks up rows by number has both sides in one place."""
    keys = list(keys)
    v = F.coalesce(F.col(value_col) if isinstance(value_col, str) else value_col, F.lit(0))
    part = keys + ["_chunk"]
    w_in = Window.partitionBy(*part).orderBy(seq_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a null key meets no offset; said of the rows as well as of the totals, so that both read the same shuffled rows
    df = df.filter(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    in_chunks = lambda rows: rows.withColumn("_chunk", F.floor(F.col(seq_col) / F.lit(chunk)).cast("bigint"))
    both = df if beside is None else df.withColumn("_own", F.lit(True)).unionByName(beside, allowMissingColumns=True)
    mine = v if beside is None else F.when(F.col("_own"), v).otherwise(F.lit(0))
    d = in_chunks(both).withColumn("_in", F.sum(mine).over(w_in))
    df = in_chunks(df)
    # added up before the shuffle, which then carries totals and no rows
    totals = df.groupBy(*part).agg(F.sum(v).alias("_ct"), F.count(F.lit(1)).alias("_cn"))
    w_prev = (Window.partitionBy(*keys).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    extra = [F.sum("_cn").over(Window.partitionBy(*keys)).alias(count_col)] if count_col else []
    offsets = totals.select(*part, F.coalesce(F.sum("_ct").over(w_prev), F.lit(0)).alias("_off"),
                            *extra)
    if beside is not None:
        # other rows may stand in a chunk without any of df's
        return (d.join(offsets, part, "left").withColumn(out_col, F.col("_off") + F.col("_in"))
                .drop("_off", "_in", "_own"))
    return (d.join(offsets, part)
            .withColumn(out_col, F.col("_off") + F.col("_in"))
            .drop("_chunk", "_off", "_in"))


def row_number_bucketed(df: DataFrame, keys: Sequence[str], bucket_col: str,
                        order_cols: Sequence[str], out_col: str, of_key: DataFrame | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY bucket_col,
    order_cols...)`` without putting a whole key in one task.

    ``bucket_col`` must lead the order (e.g. a day): rows are counted per
    (key, bucket), each bucket's offset is the number of rows in the key's
    earlier buckets (a window over the small counts table, one row per
    bucket), and rows are numbered inside their (key, bucket) partition.

    ``of_key`` (``keys`` and columns of their own) is joined as well: it meets
    the counts table, so the rows are not dealt once more by key alone.
    """
    keys = list(keys)
    part = keys + [bucket_col]
    # counted before the shuffle, which then carries counts and no rows; rows without a bucket count, as the first
    # ones of their key, and are left out
    counts = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    # every row that is left has its offset; as a left join that costs nothing where no one reads the numbers
    d = df.filter(reduce(and_, [F.col(c).isNotNull() for c in part])).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*part).orderBy(*order_cols)))
    w_prev = (Window.partitionBy(*keys).orderBy(bucket_col)
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*part, F.coalesce(F.sum("_n").over(w_prev), F.lit(0)).alias("_off"))
    if of_key is not None:
        offsets = offsets.join(of_key, keys)
    return (d.join(offsets, part, "left" if of_key is None else "inner")
            .withColumn(out_col, (F.col("_off") + F.col("_rn")).cast("bigint"))
            .drop("_off", "_rn"))
