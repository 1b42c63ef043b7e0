"""Temperature band of a cold-chain reading (F18) and its message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed thresholds and texts (strict comparisons).
ELEVATED_ABOVE_C = 8.0
CRITICAL_ABOVE_C = 15.0
MSG_OK = "Cold chain reading reported successfully."
MSG_ELEVATED = "Cold chain reading reported successfully. Warning: Temperature is elevated."
MSG_CRITICAL = "Critical: High temperature excursion reported."


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def temperature_band(t: str | Column) -> Column:
    """'critical' above 15.0, 'elevated' above 8.0, else 'normal'. NaN is
    'normal' (a NaN never compares greater), although Spark orders NaN
    above every number."""
    t = _c(t)
    return (F.when(t.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(t), F.lit("normal"))
            .when(t > CRITICAL_ABOVE_C, F.lit("critical"))
            .when(t > ELEVATED_ABOVE_C, F.lit("elevated"))
            .otherwise(F.lit("normal")))


def band_message(band: str | Column) -> Column:
    b = _c(band)
    return (F.when(b == "critical", F.lit(MSG_CRITICAL))
            .when(b == "elevated", F.lit(MSG_ELEVATED))
            .when(b == "normal", F.lit(MSG_OK)))
