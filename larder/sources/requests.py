"""JSON request source (S6) that keeps "key absent" apart from "null" (D9).

The reference reads one JSON object per call and tests key presence
(``'status' in data``, ``data.get('status', 'Available')``). A typed
DataFrame column cannot tell an absent key from an explicit null, so the
reader keeps the raw object as a VARIANT column ``_raw`` next to the typed
columns; ``key_present`` then answers presence exactly. Lines that are not
JSON objects are kept in ``_corrupt_record`` (PERMISSIVE), never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RAW = "_raw"
CORRUPT = "_corrupt_record"


def read_requests_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON-lines requests with a fixed schema (no inference)."""
    lines = spark.read.text(path)
    return parse_requests(lines.select(F.col("value")), schema)


def parse_requests(lines: DataFrame, schema: StructType, col: str = "value") -> DataFrame:
    """Typed columns + ``_raw`` (VARIANT) + ``_corrupt_record`` from a
    column of JSON text; works on batch and streaming DataFrames."""
    v = F.try_parse_json(F.col(col))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    typed = F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"})
    return lines.select(F.when(is_obj, typed).alias("_r"), F.when(is_obj, v).alias(RAW),
                        F.when(~is_obj, F.col(col)).alias(CORRUPT)) \
        .select(*[F.col("_r").getField(f.name).alias(f.name) for f in schema.fields], RAW,
                CORRUPT)


def key_present(df: DataFrame, name: str) -> Column:
    """True when the request carried key ``name`` (even with a null value).
    Without a ``_raw`` column (plain DataFrame callers) null means absent."""
    if RAW in df.columns:
        return F.variant_get(F.col(RAW), f"$.{name}", "variant").isNotNull()
    return F.col(name).isNotNull() if name in df.columns else F.lit(False)


def value_or_default(df: DataFrame, name: str, default) -> Column:
    """``data.get(name, default)``: the default only when the key is absent;
    an explicit null stays null."""
    d = default if isinstance(default, Column) else F.lit(default)
    val = F.col(name) if name in df.columns else F.lit(None)
    return F.when(key_present(df, name), val).otherwise(d)
