"""Building blocks shared by the operators.

Scale rules used throughout:

* A per-request optional filter is never written as ``f IS NULL OR k = f``
  inside a join condition (that plans as a cartesian product). Facts are
  expanded once into every presence pattern of the optional keys (an
  Expand, like GROUPING SETS) and each request equi-joins the pattern of
  the filters it carries (``expand_optional`` / ``pattern_keys``).
* Facts are aggregated or compacted per key *before* they meet the
  requests, so repeated requests never multiply fact rows.
* Top-k per key is ``row_number() <= k`` over a window; Spark plans it with
  ``WindowGroupLimit`` on both sides of the shuffle, so even a key that
  holds a third of all rows ships at most k rows per map task.
* ``broadcast`` is only applied to tables with a proven size bound (fixed
  dimensions); bounded lists (a global top-k) are attached without a join
  (``attach_bounded``). Everything else is left to AQE, which switches a
  join to broadcast from the *measured* shuffle size and keeps a
  sort-merge join otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(c: str | Column) -> Column:
    """Truthiness of an optional request field: null and '' mean absent."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c.cast("string"), F.lit(""))




def normalise_optional(req: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Replace '' by null in optional string columns."""
    for c in cols:
        if c in req.columns and dict(req.dtypes)[c] == "string":
            req = req.withColumn(c, F.nullif(F.col(c), F.lit("")))
    return req


def presence_groups(keys: Sequence[str]) -> list[tuple[str, ...]]:
    """All subsets of ``keys`` in a fixed order (largest first)."""
    out: list[tuple[str, ...]] = []
    n = len(keys)
    for mask in range((1 << n) - 1, -1, -1):
        out.append(tuple(k for i, k in enumerate(keys) if mask & (1 << i)))
    return out




# Key value standing for "this optional filter is not given".
ANY_KEY = "\u0001*"


def expand_optional(facts: DataFrame, optional: Sequence[str]) -> DataFrame:
    """Emit each fact row once per presence pattern of the ``optional``
    keys (like GROUPING SETS): in pattern p, key k keeps its value if k is
    in p and becomes ``ANY_KEY`` otherwise. Requests then match with
    ``pattern_keys`` on an equi join, whatever filters they carry, so all
    presence groups share one pipeline instead of one per group."""
    pats = F.array(*[F.struct(*[(F.col(k).cast("string") if k in group else F.lit(ANY_KEY))
                                .alias(f"_p_{k}") for k in optional])
                     for group in presence_groups(optional)])
    return facts.select("*", F.inline(pats))


def pattern_keys(req: DataFrame, optional: Sequence[str]) -> DataFrame:
    """The request side of ``expand_optional``: absent filters become
    ``ANY_KEY`` (null and '' mean absent)."""
    for k in optional:
        req = req.withColumn(f"_p_{k}", F.coalesce(present(k), F.lit(ANY_KEY)))
    return req


#: Bits of a request-key filter (4 MB): it cuts well up to some ten million keys and ever less beyond.
FILTER_BITS = 1 << 25


_PAGE = 1 << 15  # bits of a bitmap that Spark aggregates


def request_filter(req: DataFrame, keys: Sequence[str], types: Sequence) -> Column:
    """FILTER_BITS bits as an array of longs, the bit of every key in ``req``
    set: one scalar subquery of fixed size, whatever the requests. Pages are
    set by a partial bitmap aggregate and unpacked eight bytes a long; pages
    without a key cost nothing."""
    slot = _slot([F.col(k).cast(t) for k, t in zip(keys, types)])
    word = lambda i: F.conv(F.hex(F.substring("bits", (i * 8 + 1).cast("int"), F.lit(8))), 16, -10).cast("long")
    pages = (req.select((slot + 1).alias("s"))
             .groupBy((F.bitmap_bucket_number("s") - 1).cast("int").alias("page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
             .select("page", F.transform(F.sequence(F.lit(0), F.lit(_PAGE // 64 - 1)), word).alias("words")))
    empty = F.array_repeat(F.lit(0).cast("long"), _PAGE // 64)
    return (pages.agg(F.map_from_entries(F.collect_list(F.struct("page", "words"))).alias("of"))
            .select(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(FILTER_BITS // _PAGE - 1)),
                                          lambda i: F.coalesce(F.try_element_at("of", i), empty))).alias("bits"))
            .scalar())


def _slot(keys: Sequence[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))


def requested(facts: DataFrame, req: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Facts whose keys some request may name: a small request table cuts the
    facts in their scan stage, before any shuffle, expand or aggregate. A
    Bloom filter of one hash, so some facts that nobody asks for pass; every
    caller joins the requests by the same keys later."""
    types = [facts.schema[k].dataType for k in keys]
    slot = _slot([F.col(k) for k in keys])
    word = F.get(request_filter(req, keys, types), F.shiftright(slot, 6).cast("int"))
    # bytes stand in order, so the first of eight is a long's highest
    place = (56 - 8 * F.shiftright(slot % 64, 3) + slot % 8).cast("int")
    return facts.filter(F.call_function("shiftright", word, place).bitwiseAND(F.lit(1).cast("long")) == 1)


def topk(df: DataFrame, partition_by: Sequence[str | Column], order_by: Sequence[Column],
         k: int, rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows per partition, numbered 1..k in ``rank_col``."""
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    return (df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
            .withColumn(rank_col, F.col(rank_col).cast("bigint")))




def attach_bounded(req: DataFrame, small: DataFrame, order_col: str) -> DataFrame:
    """Give every request row all rows of ``small``, a table bounded by
    construction (a global top-k). ``small`` is folded into one array value
    by a scalar subquery (computed once, shipped with the plan) and each
    request ``inline``s it: no join, no cartesian operator.
    """
    arr = small.select(F.sort_array(F.collect_list(F.struct(order_col, *[
        c for c in small.columns if c != order_col]))).alias("a")).scalar()
    return req.select("*", F.inline(arr))

