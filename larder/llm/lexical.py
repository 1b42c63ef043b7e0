"""Ranked lexical search over bags of documents.

1. Every text is scanned once. Its bag holds the terms of the item
   vocabulary with their counts; a key filter of fixed greatest size stands
   for the vocabulary, and a term that passes it by chance is left out of
   every score later. Bags are written.
2. N, L and the document frequencies come from the bags, weights from these.
3. Documents with the same bag and the same m score alike on every item. They
   are hashed, compared in full and become one class with its smallest
   doc_ids: an item has room for ``top`` of them at most.
4. Classes and items are dealt into blocks, every pair of blocks is one
   group. A group scores each class once per item through an inverted index
   and gives an item's best documents; these are merged.

Terms are told apart by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import key_filter, passes, row_chunks, utf8_column, words, written

_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LAST = np.iinfo(np.int64).max


def _bags(bits: np.ndarray | None):
    """key, n (terms with repeats), terms (ascending hashes), tf per row."""
    def run(batches):
        for batch in batches:
            offsets, data = utf8_column(batch.column(1))
            for lo, hi in row_chunks(offsets):
                w = words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], lower=True, gap=_GAP)
                row, h = w.row, w.hash
                if bits is not None:
                    known = passes(bits, h)
                    row, h = row[known], h[known]
                h = h.view(np.int64)
                by = np.lexsort((h, row))
                row, h = row[by], h[by]
                head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))[:len(row)])
                tf = np.diff(np.append(head, len(row)))
                cut = pa.array(np.searchsorted(row[head], np.arange(hi - lo + 1)), pa.int32())
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(w.counts.astype(np.int64)),
                                       pa.ListArray.from_arrays(cut, pa.array(h[head])),
                                       pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int32)))],
                                      names=["key", "n", "terms", "tf"])
    return run


_BAG = "key long, n long, terms array<bigint>, tf array<int>"


def bags(rows: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """Bags of the (key, text) rows, of terms that pass the filter ``bits``."""
    return rows.select(F.col("key").cast("long").alias("key"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(_bags(bits), _BAG)


def _lists(table, name):
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return np.diff(column.offsets.to_numpy()), column.flatten()


def _ranked(top: int):
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(key, items, classes):
        if not len(items) or not len(classes):
            return schema.empty_table()
        # Postings of the items' terms: (term, class, gain), ordered by term.
        size, terms = _lists(classes, "terms")
        tf = _lists(classes, "tf")[1].to_numpy().astype(np.int64)
        terms, of = terms.to_numpy(), np.repeat(np.arange(len(size)), size)
        m = classes.column("m").to_numpy()
        known, weight_at = np.unique(items.column("term").to_numpy(), return_index=True)
        weight = items.column("w").to_numpy()[weight_at]
        at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        hit = known[at] == terms
        at, of, tf = at[hit], of[hit], tf[hit]
        gain = weight[at] * (1_000_000_000 * tf // (1000 * tf + 8 * m[of]))
        by = np.argsort(at, kind="stable")
        of, gain = of[by], gain[by]
        first = np.searchsorted(at[by], np.arange(len(known) + 1))

        members = _lists(classes, "docs")
        ids = members[1].field(0).fill_null(_LAST).to_numpy()
        begin = np.cumsum(members[0]) - members[0]
        whose, repeats = items.column("item").to_numpy(), items.column("repeats").to_numpy()
        mine = np.searchsorted(known, items.column("term").to_numpy())
        by = np.argsort(whose, kind="stable")
        cut = np.flatnonzero(np.diff(whose[by], prepend=whose[by[0]] - 1, append=whose[by[-1]] + 1))
        out = []
        for a, b in zip(cut, cut[1:]):
            scores = np.zeros(len(size), np.int64)
            for i in by[a:b]:
                span = slice(first[mine[i]], first[mine[i] + 1])
                scores[of[span]] += repeats[i] * gain[span]   # a class has a term once
            good = np.flatnonzero(scores > 0)
            if len(good) > top:
                good = good[scores[good] >= np.partition(scores[good], len(good) - top)[len(good) - top]]
            n = members[0][good]
            take = np.repeat(begin[good], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc, score = ids[take], np.repeat(scores[good], n)
            best = np.lexsort((doc, -score))[:top]
            out.append((np.full(len(best), whose[by[a]]), doc[best], score[best]))
        item, doc, score = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array(item), pa.array(doc, mask=doc == _LAST), pa.array(score)], schema=schema)
    return run


def lexical_search(documents: DataFrame, items: DataFrame, top: int = 10, class_block: int = 8192,
                   item_block: int = 1024) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents of each
    item with a score above 0; equal scores by ascending doc_id.

    Null and empty texts hold no term: such items have no rows, such documents
    count nowhere. Every row is a document or an item of its own, so a
    repeated item_id has several lists. A null doc_id ranks last among equal
    scores. Empty tables give an empty result; other columns are not read. A
    very long text becomes one bag, as large as the vocabulary at most.
    """
    asked = written(items.select(F.monotonically_increasing_id().alias("key"), "item_id",
                                 F.col("text").cast("string").alias("text")), "items")
    wanted = written(bags(asked.select("key", "text")).select(
        F.col("key").alias("item"), F.explode(F.arrays_zip("terms", "tf")).alias("t"))
        .select("item", F.col("t.terms").alias("term"), F.col("t.tf").cast("long").alias("repeats")), "item-terms")
    bits = key_filter(wanted.select("term").distinct(), "term")
    docs = written(bags(documents.select(F.col("doc_id").alias("key"), "text"), bits), "bags")
    whole = docs.filter("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = whole.n, max(1, whole.l or 0)

    df = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    wanted = wanted.join(df.select("term", weight.cast("long").alias("w")), "term")

    m = F.lit(25).cast("long") + F.expr(f"(75 * n * {n_docs}L) div {n_terms}L")
    same = ["h", "m", "terms", "tf"]
    member = Window.partitionBy(*same).orderBy(F.asc_nulls_last("key"))
    classes = (docs.filter(F.size("terms") > 0).withColumn("m", m)
               .select(F.xxhash64("terms", "tf", "m").alias("h"), "m", "terms", "tf", "key")
               .withColumn("nth", F.row_number().over(member)).filter(F.col("nth") <= top)
               .groupBy(*same).agg(F.collect_list(F.struct("key")).alias("docs")))
    classes = written(classes, "classes")
    class_parts, item_parts = 1 + classes.count() // class_block, 1 + asked.count() // item_block
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (wanted.withColumn("ip", F.pmod(F.xxhash64("item"), F.lit(item_parts)).cast("int"))
            .withColumn("cp", every(class_parts)))
    right = (classes.withColumn("cp", F.pmod(F.xxhash64("h"), F.lit(class_parts)).cast("int"))
             .withColumn("ip", every(item_parts)).select("cp", "ip", "m", "terms", "tf", "docs"))
    found = left.groupBy("ip", "cp").cogroup(right.groupBy("ip", "cp")).applyInArrow(
        _ranked(top), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(asked.select(F.col("key").alias("item"), "item_id"), "item").select(
        "item_id", "rank", "doc_id", "score")
