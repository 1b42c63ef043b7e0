"""Scans of the input tables with explicit schemas.

Parquet scans are lazy: Catalyst prunes columns and pushes filters into the
reader, so callers just ``select``/``filter`` what they need.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.schemas import DOMAIN, DRIVER


#: Session setting: "true" where tables are files of one row group each.
SPREAD = "spark.larder.spread"


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of the test environment, e.g. ``lineitem``."""
    return spread(spark.read.schema(DRIVER[name]).parquet(os.path.join(sf_dir, f"{name}.parquet")))


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan when the session sets ``spark.larder.spread``.

    Parquet splits at row-group boundaries; a file written as one row group
    is read by one task, and everything up to the first shuffle (projection,
    partial aggregation, map-side top-k) would run single-threaded. Tables
    stored as many files or row groups need no setting.
    """
    return df.hint("rebalance") if df.sparkSession.conf.get(SPREAD, "false") == "true" else df


def read_domain(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored domain table (Parquet folder) with its fixed schema."""
    return spark.read.schema(DOMAIN[name]).parquet(path)


def lookup(spark: SparkSession, base: str, text: str, tables: Sequence[str], **params) -> DataFrame:
    """A one-off SQL question over stored domain tables (``base/<table>``)
    with named parameters (``:name``); values are bound, never pasted into the
    text, and a list is an array parameter (``array_contains(:ids, id)``)."""
    for name in tables:
        read_domain(spark, f"{base}/{name}", name).createOrReplaceTempView(name)
    bound = {k: F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else v for k, v in params.items()}
    return spark.sql(text, args=bound)


def store_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """A stored copy of ``df`` in ``buckets`` buckets by ``key``, sorted within
    each. Tables stored with one number of buckets join on the key, and
    aggregate by it, without a shuffle."""
    name = "bucketed_" + uuid.uuid4().hex
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path)
     .mode("overwrite").format("parquet").saveAsTable(name))
    return df.sparkSession.table(name)


class DriverTables:
    """Lazy accessor: ``t.lineitem`` is a DataFrame over lineitem.parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in DRIVER:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = read_driver(self.spark, self.sf_dir, name)
        return self._cache[name]
