"""MinHash near duplicates with sequential Bayesian verification.

1. A document's set holds the 64-bit hashes of its distinct word shingles.
   Documents with equal sets are one class, so a group of copies costs one row.
2. Signatures of ``bands * rows`` minima; classes that agree on a whole band
   share a bucket. Each bucket compares its members with its smallest class.
3. A candidate's signatures are compared batch by batch. With m of n minima
   equal and a uniform prior, the similarity has a Beta(m+1, n-m+1)
   posterior; the pair is pruned once P(similarity >= threshold) falls below
   ``miss``. Survivors are confirmed on their whole sets.
4. Buckets that still hold several components compare the rest of their
   members, in pairs of blocks of bounded size. Pairs of one component are
   skipped, and only confirmed links that join components leave a task, so a
   block gives fewer links than it has members. No pair of different
   components goes untested.

A pair at the threshold shares no band with probability (1 - t**rows)**bands:
5e-8 for 32 bands of 4 rows at 0.8.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import mix, quoted, release, row_chunks, sequence_hash, utf8_column, window_hashes, words, written
from larder.llm.components import connected_components

BANDS, ROWS, BATCH = 32, 4, 16
#: Members of a block, and shingles per member that a full block has room for.
BLOCK, BLOCK_SHINGLES = 1024, 1024
MISS = 1e-7

_A = mix(np.arange(1, 4096, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(4097, 8192, dtype=np.uint64))


def shingle_sets(column, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of an Arrow text column, ASCII
    letters lower-cased. Fewer than ``k`` words: the whole sequence as one
    shingle; no words: an empty set."""
    offsets, data = utf8_column(column)
    for lo, hi in row_chunks(offsets):
        w = words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], lower=True)
        grams = window_hashes(w.hash, k)
        for r in range(hi - lo):
            a, b = w.first[r], w.first[r + 1]
            if b - a >= k:
                yield lo + r, np.unique(grams[a:b - k + 1])
            else:
                yield lo + r, np.array([sequence_hash(w.hash[a:b])][:b - a], np.uint64)


def minhash(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima as uint32; an empty set gives all ones."""
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(out, (shingles[i:i + 512, None] * _A[:n] + _B[:n]).min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def least_matches(n_hashes: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes seen, fewest equal ones that keep a pair) after each batch:
    P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(batch, n_hashes + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def plausible(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the row pairs (uint32 signatures) that no batch prunes."""
    alive, seen, equal = np.arange(len(a)), 0, np.zeros(len(a), np.int32)
    for n, m in bounds:
        if not len(alive):
            break
        equal += (a[alive, seen:n] == b[alive, seen:n]).sum(1, dtype=np.int32)
        keep = equal >= m
        alive, equal, seen = alive[keep], equal[keep], n
    return alive


def _sign(k: int, n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
                        ("sig", pa.binary()), ("digest", pa.binary())])

    def run(batches):
        for batch in batches:
            size, key, sig = [], [], []
            for _, s in shingle_sets(batch.column(1), k):
                size.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(minhash(s, n).tobytes())
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()),
                                   pa.array(key, pa.binary()), pa.array(sig, pa.binary()), batch.column(2)],
                                  schema=schema)
    return run


def _sets(k: int):
    schema = pa.schema([("id", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids, held, got = batch.column(0), 0, []
            rows = []
            for r, s in shingle_sets(batch.column(1), k):
                rows.append(r)
                got.append(s.view(np.int64))
                held += len(s)
                if held > 1 << 20:
                    yield pa.record_batch([ids.take(pa.array(rows)).cast(pa.int64()),
                                           pa.array(got, pa.list_(pa.int64()))], schema=schema)
                    rows, got, held = [], [], 0
            if rows:
                yield pa.record_batch([ids.take(pa.array(rows)).cast(pa.int64()),
                                       pa.array(got, pa.list_(pa.int64()))], schema=schema)
    return run


def _matrix(column, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, n)


def _prune(n: int, bounds):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = pa.array(plausible(_matrix(batch.column(2), n), _matrix(batch.column(3), n), bounds))
            yield pa.record_batch([batch.column(0).take(keep), batch.column(1).take(keep)], schema=schema)
    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets reach the threshold."""
    a = sets.select(F.col("id").alias("u"), F.col("members").alias("a"))
    b = sets.select(F.col("id").alias("v"), F.col("members").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (pairs.join(a, "u").join(b, "v").select("u", "v", both.alias("both"), F.size("a").alias("na"),
                                                   F.size("b").alias("nb"))
            .filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("u", "v"))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets (distinct members) reach the threshold."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _within(n: int, rows: int, bounds, percent: int):
    """Rows sorted by group (bucket, side a, side b) -> confirmed links that
    join two components; at most one fewer than the group has members. A pair
    that agrees on several bands is left to the first of them."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(band, ids, comp, sig, sets, left, right, root):
        earlier = sig[:, :band * rows].reshape(len(ids), band, rows)

        def find(c):
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        for i in np.flatnonzero(left):
            other = np.flatnonzero(right & (comp != comp[i]) & (ids > ids[i]))
            if band and len(other):
                other = other[~(earlier[other] == earlier[i]).all(2).any(1)]
            if len(other):
                for j in other[plausible(np.broadcast_to(sig[i], (len(other), n)), sig[other], bounds)].tolist():
                    a, b = find(int(comp[i])), find(int(comp[j]))
                    if a != b and _similar(sets[i], sets[j], percent):
                        root[max(a, b)] = min(a, b)
                        yield int(ids[i]), int(ids[j])

    def run(batches):
        def groups():
            held = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
                cut = [0, *(np.flatnonzero(np.diff(np.array(held.column(0)))) + 1).tolist()]
                for a, b in zip(cut, cut[1:]):
                    yield held.slice(a, b - a)
                held = held.slice(cut[-1])
            if held is not None and held.num_rows:
                yield held

        out = []
        for t in groups():
            side, ids, comp = (np.array(t.column(i)) for i in (1, 2, 3))
            one, band = t.column(6)[0].as_py(), t.column(7)[0].as_py()
            sig, members = _matrix(t.column(4), n), t.column(5).combine_chunks()
            at, values = np.array(members.offsets), np.array(members.values)
            sets = [values[a:b] for a, b in zip(at, at[1:])]
            root = {}
            # in a group of two blocks the smaller id can be on either side
            for left, right in [(side == 0, side == 0)] if one else [(side == 0, side == 1), (side == 1, side == 0)]:
                out += links(band, ids, comp, sig, sets, left, right, root)
            if len(out) > 4096:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
    return run


def _linked_classes(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int, miss: float, block: int,
                    by_id: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, digest) rows -> written tables: doc_id, n_shingles, set_key,
    digest per row; set_key, part (of the classes linked directly or not) and
    least (no_id, doc_id, digest) per class. With ``by_id`` the rows of one
    doc_id are one document, whose classes are linked, and rows without an id
    are in no class; else every row is a document.

    Classes are numbered, so neither a missing nor a repeated doc_id matters
    to the links. Tables that are needed no more are deleted on the way.
    """
    n = bands * rows
    signed = written(docs.select("doc_id", "text", "digest").mapInArrow(
        _sign(shingle, n), "doc_id long, n_shingles long, set_key binary, sig binary, digest binary"), "signatures")
    usable = signed.filter("n_shingles > 0" + " and doc_id is not null" * by_id)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest"))
    # Equal sets have one signature and size: partial aggregates collapse copies before the shuffle.
    classes = written(usable.groupBy("set_key").agg(least.alias("least"), F.first("n_shingles").alias("n_shingles"),
                                                    F.first("sig").alias("sig"))
                      .withColumn("id", F.monotonically_increasing_id()), "classes")
    rows_of = written(signed.drop("sig"), "rows")
    release(signed)
    reps = classes.select("id", "n_shingles", "sig")
    shared = None
    if by_id:
        texts = rows_of.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "set_key").distinct()
        several = texts.join(texts.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "doc_id", "left_semi")
        several = several.join(classes.select("set_key", "id"), "set_key").select("doc_id", "id")
        shared = (several.join(several.groupBy("doc_id").agg(F.min("id").alias("v")), "doc_id")
                  .select(F.col("id").alias("u"), "v").filter("u > v").distinct())

    width = 4 * rows
    buckets = reps.select("id", "n_shingles", F.posexplode(F.expr(
        f"transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(sig, i * {width} + 1, {width})))"
    )).alias("band", "bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("tail")).filter("head < tail")
    met = written(buckets.join(heads.select("bucket", "head"), "bucket"), "buckets")
    bounds = least_matches(n, BATCH, percent / 100, miss)

    sig_u, sig_v = reps.select(F.col("id").alias("u"), F.col("sig").alias("su")), \
        reps.select(F.col("id").alias("v"), F.col("sig").alias("sv"))
    # whole sets, made again from one text of each class that met another;
    # a merge at any size, since that share of the texts grows with the input
    need = (classes.join(met.select("id").distinct(), "id", "left_semi")
            .select("id", F.col("least.doc_id").alias("of"), F.col("least.digest").alias("digest")).hint("merge"))
    sets = written(docs.join(need, (docs["doc_id"].eqNullSafe(need["of"])) & (docs["digest"] == need["digest"]))
                   .select("id", "text").mapInArrow(_sets(shingle), "id long, members array<long>")
                   .dropDuplicates(["id"]), "sets")
    near_head = met.filter("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v")).distinct()
    first = written(near_head.join(sig_u, "u").join(sig_v, "v").select("u", "v", "su", "sv")
                    .mapInArrow(_prune(n, bounds), "u long, v long"), "pairs")
    confirmed = _confirmed(first, sets, percent)
    links = written(confirmed.union(shared) if by_id else confirmed, "links")
    release(first)
    parts = connected_components(links)
    release(links)

    # buckets whose members, besides the head, lie in several components
    known = (met.filter("id <> head").join(parts.withColumnRenamed("node", "id"), "id", "left")
             .select("bucket", "band", "id", "n_shingles", F.coalesce("component", "id").alias("comp")))
    weight = F.greatest(F.count("*") / block, F.sum("n_shingles") / (block * BLOCK_SHINGLES))
    mixed = (known.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), weight.alias("w"))
             .filter("lo < hi").select("bucket", F.ceil("w").cast("int").alias("blocks")))
    rest = written(known.join(mixed, "bucket")
                   .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "rest")
    release(met)
    one = rest.select(F.xxhash64("bucket", "mine", "mine").alias("g"), F.lit(0).alias("side"), "id", "comp",
                      F.lit(True).alias("one"), "band")
    two = (rest.filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .filter("other <> mine")
           .select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"),
                   (F.col("mine") > F.col("other")).cast("int").alias("side"), "id", "comp",
                   F.lit(False).alias("one"), "band"))
    dealt = (one.union(two).join(reps.select("id", "sig"), "id").join(sets, "id")
             .select("g", "side", "id", "comp", "sig", "members", "one", "band")
             .repartition("g").sortWithinPartitions("g"))
    more = dealt.mapInArrow(_within(n, rows, bounds, percent), "u long, v long")
    joined = written(more.union(parts.select(F.col("node").alias("u"), F.col("component").alias("v"))), "links")
    release(rest, sets, parts)
    parts = connected_components(joined)
    named = written(classes.join(parts.withColumnRenamed("node", "id"), "id", "left").select(
        "set_key", F.coalesce("component", "id").alias("part"), "least"), "named")
    release(joined, parts, classes)
    return rows_of, named


def _documents(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                            F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("digest"))


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS,
                    rows: int = ROWS, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Two documents are linked when 100 * |A and B| >= ``percent`` * |A or B|
    on their sets of distinct ``shingle``-word shingles; component_id is the
    smallest doc_id reachable over links. Null or empty text and text without
    words has an empty set and no link: such a row is its own component. Rows
    that share a doc_id are one document: the sets of all its texts are linked
    with each other. A null doc_id can't be linked: its component is null and
    it is kept. A very long text is one set, made in one task. An empty table
    gives an empty result; columns other than doc_id and text are not read.
    """
    signed, classes = _linked_classes(_documents(documents), shingle, percent, bands, rows, miss, block, True)
    lowest = classes.groupBy("part").agg(F.min("least.doc_id").alias("component"))
    named = classes.join(lowest, "part").select("set_key", "component")
    out = signed.join(named, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component")))
        .otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each_group(documents: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS,
                      rows: int = ROWS, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """The rows of ``documents``, all columns as they are, without near
    duplicates: of each group of linked rows the one with the smallest doc_id
    stays, rows without an id last, then by text digest and by a hash of all
    columns but maps. Every row is a document of its own, whatever its doc_id. Rows
    without a word are linked with nothing and stay. Whole rows are shuffled
    once; repeated rows are cut to one before that.
    """
    signed, classes = _linked_classes(_documents(documents), shingle, percent, bands, rows, miss, block, False)
    stay = written(classes.groupBy("part").agg(F.min("least").alias("least"))
                   .select(F.col("least.doc_id").alias("id"), F.col("least.digest").alias("digest")), "stay")
    release(signed, classes)
    columns = quoted(documents.columns)
    hashed = [c for c, f in zip(columns, documents.schema) if not {"map", "variant"} & set(re.findall(r"\w+", f.dataType.simpleString()))]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wordy = text.rlike("[^ \\x09-\\x0D]")
    keyed = documents.filter(wordy).select(
        F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        F.struct(*columns).alias("row"), F.xxhash64(*hashed).alias("hash"))
    same = Window.partitionBy("id", "digest").orderBy("hash")
    one = keyed.withColumn("nth", F.row_number().over(same)).filter("nth = 1")
    left, right = one.alias("a"), stay.hint("merge").alias("b")
    kept = left.join(right, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.digest") == F.col("b.digest")),
                     "left_semi").select("row.*")
    return kept.unionAll(documents.filter(~wordy))
