"""The corpus pipeline: toxicity, near duplicates, repeated passages,
benchmark leaks, packing. Each stage works on what the stage before kept, and
judges every row by itself: a doc_id can be null or stand for several texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontam, neardup, packing, substrings, toxicity
from larder.llm.common import read_table, release, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on the labels, predicts toxic go; the
    others pass through the scoring tasks unchanged, whatever their id. Null
    and empty texts score as texts without words, repeated rows alike. Without
    labels of both classes all rows stay. An empty table stays empty; any
    other columns are passed on."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group at 0.8 on five-word shingles stays: the one with
    the smallest id, a row without an id only where no other has one; then the
    least text digest. Every row is a document of its own, whatever its
    doc_id; of rows with one id and text the one with the least hash of all
    columns stays. Rows without a word all stay. An empty table stays empty;
    any other columns are passed on."""
    return neardup.one_of_each_group(docs, shingle=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by 20-word windows that also start earlier go; n_chars
    follows. A document of which nothing is left stays as an empty one, a null
    text stays null, rows that repeat an id and text lose the same words. An
    empty table stays empty; any other columns are passed on."""
    others = [c for c in docs.columns if c != "text"]
    cut = substrings.remove_repeats(docs, with_text=True, carry=tuple(others))
    row = F.col("carried")["row"]
    new = {c: row.getField(c) for c in others}
    new["text"] = F.when(~F.col("carried")["was_null"], F.col("kept_text")).cast(docs.schema["text"].dataType)
    if "n_chars" in others:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)) \
            .otherwise(new["n_chars"])
    return cut.select(*[new[c].alias(c) for c in docs.columns])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item's question and answer go; the others
    pass through the searching tasks unchanged, whatever their id. Null and
    empty texts stay, repeated rows are judged alike. Without items all rows
    stay. An empty table stays empty; any other columns are passed on."""
    return decontam.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences, one row per piece. Null
    and empty texts are one end mark; a very long text is many pieces; null
    ids and repeated rows are packed like others. An empty table gives an
    empty result; only doc_id and text are read."""
    return packing.pack(packing.word_lengths(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Training and near duplicates can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet below the shared
    checkpoint folder and read again by the next; a stage's input goes once
    its output stands. Empty ``documents`` give an empty result."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return docs
