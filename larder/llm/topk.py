"""Exact top-k search by inner product in norm buckets.

1. Components become integers. Rows with one and the same vector score alike,
   so of these only the ids that can still be among k others stay.
2. Candidates are grouped by length into buckets whose lengths differ by a
   tenth at most, and each bucket into blocks of some ``block`` rows. Queries
   lie in groups of ``group``.
3. Every query meets the blocks of the greatest lengths first. Its k-th best
   score there is a threshold that the final k-th best reaches too.
4. A query goes on to the blocks whose greatest length times its own reaches
   its threshold. There it has a local cosine threshold. Per block, trial
   queries tell from which local threshold on the coordinate lists leave few
   enough rows; queries above it take the rows whose strongest coordinate lies
   in the feasible interval, the others those long enough. All rows left are
   verified by the integer product.
5. The k best of each query and block are merged.

The work of a task is bounded by ``block`` and ``group``; a hot bucket or a hot
vector only makes more blocks. Queries and candidates are both shuffled by
pairs of blocks that survive: nothing passes through the driver but one row
per length bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import written

#: Scaled components lie within this, so that products of some 100 stay in 64 bits.
LARGEST = 1 << 28
#: Lengths of a bucket: from this to the power b up to the next power.
BUCKET_RATIO = 1.1
#: The coordinate list is taken where it leaves at most this share of the long rows.
LIST_SHARE = 0.25
_TRIALS = 16
_EPS = 1e-9

_OUT = "q long, query_id long, vec_id long, score long"


def _matrix(table, dim: int) -> np.ndarray:
    column = table.column("v").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class _Block:
    """Candidates of one block, longest first, with a sorted list per
    coordinate made when it is asked for."""

    def __init__(self, table, dim):
        v = _matrix(table, dim)
        norm = table.column("norm").to_numpy()
        by = np.argsort(-norm, kind="stable")
        self.ids, self.norm = table.column("vec_id").to_numpy()[by], norm[by]
        self.v, self.lists = v[by], {}
        self.unit = None
        self.largest = int(np.abs(v).max()) if v.size else 0

    def long_rows(self, least):
        """How many rows have at least this length."""
        return np.searchsorted(-self.norm, -least * (1 - _EPS), "right")

    def list_range(self, coordinate, at, cosine):
        """Rows (order, from, to) whose ``coordinate`` (of the unit vector)
        allows that cosine with a unit query whose coordinate is ``at``."""
        if coordinate not in self.lists:
            if self.unit is None:
                self.unit = self.v / np.maximum(self.norm, 1)[:, None]
            order = np.argsort(self.unit[:, coordinate], kind="stable")
            self.lists[coordinate] = order, self.unit[order, coordinate]
        order, values = self.lists[coordinate]
        angle, spread = np.arccos(np.clip(at, -1, 1)), np.arccos(np.clip(cosine * (1 - _EPS), -1, 1))
        low, high = np.cos(min(np.pi, angle + spread)), np.cos(max(0.0, angle - spread))
        return order, np.searchsorted(values, low - _EPS, "left"), np.searchsorted(values, high + _EPS, "right")


def _best(scores, ids, own, k):
    """(row, column) of the k best of each row: score, then smaller id; a
    row's ``own`` id is no candidate."""
    other = ids[None, :] != own[:, None]
    low = np.iinfo(np.int64).min
    scores = np.where(other, scores, low)
    n = scores.shape[1]
    cut = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), low)
    r, c = np.nonzero((scores >= cut[:, None]) & other)
    by = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[by], c[by]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return r[rank < k], c[rank < k], scores


def _search(k: int):
    schema = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key, queries, rows):
        if not len(queries) or not len(rows):
            return schema.empty_table()
        dim = key[0].as_py()
        block, qv = _Block(rows, dim), _matrix(queries, dim)
        q, own = queries.column("q").to_numpy(), queries.column("vec_id").to_numpy()
        norm = np.maximum(queries.column("norm").to_numpy(), 1e-300)
        floor = queries.column("threshold").to_numpy()
        # Sums below 2**53 are exact in doubles, which have the faster product.
        kind = np.float64 if dim * block.largest * int(np.abs(qv).max()) < 1 << 53 else np.int64
        v, qv = block.v.astype(kind), qv.astype(kind)
        cosine = floor / (norm * block.norm[0]) if block.norm[0] > 0 else np.where(floor > 0, 2.0, 0.0)
        prefix = block.long_rows(np.maximum(floor, 0) / norm)
        prefix[cosine > 1 + _EPS] = 0

        def listed(i):
            unit = qv[i] / norm[i]
            f = int(np.argmax(np.abs(unit)))
            return block.list_range(f, unit[f], cosine[i])

        # The local threshold from which on the coordinate list pays in this block.
        limit, able = np.inf, np.flatnonzero((cosine > 0) & (prefix > 0))
        trial = able[np.argsort(-cosine[able], kind="stable")][::max(1, len(able) // _TRIALS)]
        for i in trial:
            _, a, b = listed(i)
            if b - a > LIST_SHARE * prefix[i]:
                break
            limit = cosine[i]
        out = []

        def keep(at, pick, scores):
            r, c, scores = _best(scores.astype(np.int64), block.ids[pick], own[at], k)
            s = scores[r, c]
            good = s >= floor[at[r]]
            out.append((q[at[r]][good], own[at[r]][good], block.ids[pick][c][good], s[good]))

        by_length = np.flatnonzero((prefix > 0) & (cosine < limit))
        by_length = by_length[np.argsort(prefix[by_length], kind="stable")]
        step = max(1, (1 << 21) // len(block.ids))
        for i in range(0, len(by_length), step):
            at = by_length[i:i + step]
            n = prefix[at[-1]]
            keep(at, np.arange(n), qv[at] @ v[:n].T)
        for i in np.flatnonzero((prefix > 0) & (cosine >= limit)):
            order, a, b = listed(i)
            pick = order[a:b]
            pick = pick[pick < prefix[i]]
            if len(pick):
                at = np.array([i])
                keep(at, pick, (v[pick] @ qv[i])[None, :])
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)] if out else
                        [pa.array([], t) for t in schema.types], schema=schema)
    return run


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(embeddings: DataFrame, k: int = 5, scale: float = 256.0, every: int = 50, block: int = 8192,
          group: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row whose vec_id is
    divisible by ``every``, the k rows with the highest integer inner product
    of floor(scale * embedding); ties go to the smaller vec_id.

    A row is no candidate for a query of its own vec_id. Rows without vec_id
    and vectors that are null, empty, hold a null or a non-finite component, or
    pass ``LARGEST`` once scaled take no part; vectors of another length than
    the query's are no candidates. A repeated row is as many candidates, and a
    repeated query has as many results. An empty table gives an empty result;
    other columns are not read.
    """
    spark = embeddings.sparkSession
    scaled = F.transform("x", lambda x: F.floor(x * F.lit(scale)))
    fits = F.forall("x", lambda x: F.coalesce(F.abs(x) * F.lit(scale) <= LARGEST, F.lit(False)) & ~F.isnan(x))
    rows = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"),
                              F.col("embedding").cast("array<double>").alias("x"))
            .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fits)
            .select("vec_id", scaled.cast("array<int>").alias("v")))
    rows = (rows.withColumn("dim", F.size("v"))
            .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x.cast("double")))))
    same = Window.partitionBy("v").orderBy("vec_id")
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / np.log(BUCKET_RATIO)).cast("int")).otherwise(-1)
    candidates = written(rows.withColumn("nth", F.dense_rank().over(same)).filter(F.col("nth") <= k + 1).drop("nth")
                         .withColumn("bucket", bucket), "vectors")
    queries = written(rows.filter(F.col("vec_id") % every == 0)
                      .withColumn("q", F.monotonically_increasing_id()), "queries")
    lengths = (candidates.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).collect())
    asked = {r.dim: -(-r["count"] // group) for r in queries.groupBy("dim").count().collect()}
    blocks = [(r.dim, r.bucket, r.norm, -(-r.n // block)) for r in lengths if r.dim in asked]
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # One row per length bucket and number of components: a table of constants.
    parts = F.broadcast(spark.createDataFrame(
        [(d, b, n, p, asked[d]) for d, b, n, p in blocks], "dim int, bucket int, longest double, parts int, groups int"))

    def searched(queries, parts):
        left = (queries.join(parts, "dim").filter(F.col("norm") * F.col("longest") * (1 + _EPS) >= F.col("threshold"))
                .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                .withColumn("grp", F.pmod(F.xxhash64("q"), F.col("groups")).cast("int"))
                .select("dim", "bucket", "part", "grp", "q", "vec_id", "v", "norm", "threshold"))
        right = (candidates.join(parts.drop("longest"), ["dim", "bucket"])
                 .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts").cast("long")).cast("int"))
                 .filter(F.col("part") < F.col("parts"))
                 .withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
                 .select("dim", "bucket", "part", "grp", "vec_id", "v", "norm"))
        pair = ["dim", "bucket", "part", "grp"]
        return _top(left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(_search(k), _OUT), k)

    unknown = float(np.iinfo(np.int64).min)
    start = parts.withColumn("top", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("bucket")))) \
        .filter("top = 1").drop("top")
    seeds = (searched(queries.withColumn("threshold", F.lit(unknown)), start)
             .groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k))
    known = (queries.join(seeds.select("q", "kth"), "q", "left")
             .withColumn("threshold", F.coalesce(F.col("kth").cast("double"), F.lit(unknown))).drop("kth"))
    return searched(written(known, "thresholds"), parts).select("query_id", "rank", "vec_id", "score")
