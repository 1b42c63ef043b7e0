"""Appends with schema enforcement (S4), quarantine of bad rows (S5) and
JSON encoding of results (S9).

Writes go to Parquet folders (a table path). Row ids are deterministic
hashes. With a ``batch`` name the rows go to a partition of their own, which
a replay of the batch replaces, so a retried job leaves each row once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from larder.schemas import DOMAIN


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of ``table`` in schema order, cast to the schema's types;
    columns the frame lacks are null. Extra columns are dropped."""
    cols = []
    for f in DOMAIN[table].fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def _write(df: DataFrame, path: str, partition_by: list[str], batch: str | None) -> None:
    if batch is None:
        w = df.write.mode("append")
    else:
        partition_by = ["batch_id", *partition_by]
        w = (df.withColumn("batch_id", F.lit(batch)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic"))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append(df: DataFrame, path: str, table: str, partition_by: list[str] | None = None,
           batch: str | None = None) -> None:
    """Append rows to a domain table with its fixed schema. Without
    ``batch`` every call adds rows; with it a replay replaces its own."""
    _write(conform(df, table), path, partition_by or [], batch)


def append_with_quarantine(valid: DataFrame, rejects: DataFrame, path: str, table: str,
                           batch: str | None = None) -> None:
    """Valid rows to the table, rejected rows (with ``error_code`` and
    ``error_message``) to ``<path>_quarantine``; bad rows never reach the
    table and are never silently dropped."""
    append(valid, path, table, batch=batch)
    _write(rejects, f"{path}_quarantine", [], batch)


#: Ids are hex digests, which this codec halves.
CODEC = "zstd"

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a write in here shuffled leaves the disk as soon as it is done, and not when the driver next collects
    garbage; meant for jobs of several writes."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df`` from a Parquet folder of their own."""
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


ORDER_TABLES = ("order_items", "orders", "orders_quarantine")


def place_orders(orders: DataFrame, items: DataFrame, rejects: DataFrame, base: str,
                 batch: str) -> None:
    """H8 writer (D15): the rows of ``batch`` become visible together.

    Each run writes its rows under an attempt of its own, items first, and
    then one commit mark that names the attempt. ``read_committed`` shows the
    rows of the attempt that a batch's mark names, so a run that dies between
    the tables shows neither items nor orders, and a replay replaces all
    three tables at once by replacing the mark. Attempts of the batch that no
    mark names any more are deleted last; a reader still on one starts again.
    """
    attempt, spark = uuid.uuid4().hex, orders.sparkSession
    for table, df in zip(ORDER_TABLES, (conform(items, "order_items"), conform(orders, "orders"), rejects)):
        with shuffles_dropped(spark):
            (df.withColumn("batch_id", F.lit(batch)).withColumn("attempt", F.lit(attempt))
             .write.mode("append").option("compression", CODEC).partitionBy("batch_id", "attempt").parquet(f"{base}/{table}"))
    _commit(spark, base, batch, attempt)
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch)
    for table in ORDER_TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{table}/batch_id={name}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for old in fs.listStatus(path) if fs.exists(path) else ():
            if old.getPath().getName() != f"attempt={attempt}":
                fs.delete(old.getPath(), True)


def _commit(spark: SparkSession, base: str, batch: str, attempt: str) -> None:
    _write(spark.createDataFrame([(attempt,)], "committed string"), f"{base}/_commits", [], batch)


def _commits(spark: SparkSession, base: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/_commits")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "batch_id string, attempt string")
    return spark.read.schema("committed string, batch_id string").parquet(f"{base}/_commits") \
        .select("batch_id", F.col("committed").alias("attempt"))


def read_committed(spark: SparkSession, base: str, table: str) -> DataFrame:
    """Rows of ``place_orders``' table whose batch has committed them. Marks are
    one short row per batch and are broadcast: dealt by batch and attempt, all
    rows of a batch would meet in one task."""
    rows = spark.read.schema(_stored_schema(spark, base, table)).parquet(f"{base}/{table}")
    return rows.join(F.broadcast(_commits(spark, base)), ["batch_id", "attempt"], "left_semi").drop("batch_id", "attempt")


def _stored_schema(spark: SparkSession, base: str, table: str) -> StructType:
    fields = DOMAIN[table].fields if table in DOMAIN else spark.read.parquet(f"{base}/{table}").drop("batch_id", "attempt").schema.fields
    return StructType([*fields, StructField("batch_id", StringType()), StructField("attempt", StringType())])


def write_classes(batch: DataFrame, batch_id: int, query: str, base: str, column: str,
                  classes: Sequence[str], rest: str) -> None:
    """One micro-batch into a table per class, ``base/<class>``; rows of any
    other class go to ``base/<rest>``. Meant for ``foreachBatch``: rows are keyed
    by (query, batch id), so a replayed batch replaces its own files in every
    table, whichever of them an earlier run reached."""
    batch = batch.persist()
    try:
        sinks = {c: F.col(column) == c for c in classes}
        sinks[rest] = ~F.coalesce(F.col(column).isin(*classes), F.lit(False))
        for name, mine in sinks.items():
            (batch.filter(mine).withColumn("query", F.lit(query)).withColumn("batch_id", F.lit(batch_id))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("query", "batch_id").parquet(f"{base}/{name}"))
    finally:
        batch.unpersist()


def to_json_rows(df: DataFrame, key: str = "request_id") -> DataFrame:
    """One JSON document per row (``request_id`` kept as a column); null
    fields are written as null."""
    others = [c for c in df.columns if c != key]
    return df.select(key, F.to_json(F.struct(*others), {"ignoreNullFields": "false"}).alias("json"))
