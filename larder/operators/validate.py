"""Request validation columns (F1, F6) and the valid/quarantine split.

DataFrame callers cannot tell an absent key from a null value; a null in a
required column counts as missing (documented difference: the reference
checks key presence only).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_fields(required: Sequence[str], values: Mapping[str, Column],
                   df: DataFrame | None = None) -> Column:
    """array of the required field names that are missing, in the order
    they are required. With a JSON request frame (``_raw`` column) a field
    is missing when its key is absent, as in the reference; otherwise when
    its value is null."""
    from larder.sources.requests import RAW, key_present
    if df is not None and RAW in df.columns:
        flags = {n: ~key_present(df, n) for n in required}
    else:
        flags = {n: values[n].isNull() for n in required}
    arr = F.array(*[F.when(flags[n], F.lit(n)) for n in required])
    return F.filter(arr, lambda x: x.isNotNull())


def required_message(missing_col: str | Column) -> Column:
    m = F.col(missing_col) if isinstance(missing_col, str) else missing_col
    return F.concat(F.lit("Missing required fields in body: "), F.array_join(m, ", "))


#: Required fields of the read requests (fixed values of the request formats).
REQUIRED = {
    "demand_forecast": ("product_id", "target_date_start", "target_date_end"),
    "market_price": ("product_id",),
    "product_availability": ("product_id",),
    "shipment_tracking": ("shipment_id",),
    "warehouse_stock": ("location_id",),
}


def split_requests(req: DataFrame, operator: str) -> tuple[DataFrame, DataFrame]:
    """F1 for H5, H6, H7, H9 and H11: ``(requests to answer, error rows)``.
    An error row has ``operator, request_id, status, message``; every request
    is in exactly one of the two."""
    names = REQUIRED[operator]
    marked = req.withColumn("_missing", missing_fields(names, {n: F.col(n) for n in names}, req))
    bad = F.size("_missing") > 0
    errors = marked.filter(bad).select(
        F.lit(operator).alias("operator"), "request_id", F.lit("error").alias("status"),
        required_message("_missing").alias("message"))
    return marked.filter(~bad).drop("_missing"), errors
