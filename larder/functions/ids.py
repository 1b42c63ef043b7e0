"""Deterministic row ids.

The reference draws a random UUID per inserted row. A random id changes when
a task is retried after an executor loss, so appended rows could duplicate
or orphan; we hash the row's natural key instead (same input -> same id).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: str | Column) -> Column:
    """SHA-256 of the parts, each written as length, ``:`` and text (null:
    ``-``), so different parts never give the same input."""
    cols = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(
        F.concat(F.length(c).cast("string"), F.lit(":"), c)) for c in cols]), 256)
