"""Scalar parsing expressions (F2-F5, F15, F16). All built-in Spark
expressions: they stay inside whole-stage codegen and never raise on bad
input (a bad value becomes null, and the caller routes it to quarantine).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns.
INT_PATTERN = r"^\s*[+-]?\d+\s*$"
DATE_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}$"
ISO_TS_PATTERN = (r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?"
                  r"(Z|[+-]\d{2}:?\d{2})?\s*$")
FLOAT_PATTERN = (r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|nan|inf|infinity)\s*$")
COORD_PATTERN = r"Lat:\s*([^,]*?)\s*,\s*Lon:\s*(.*?)\s*$"
DURATION_PATTERN = r"^\s*(?:(\d+)\s*h)?\s*(?:(\d+)\s*m)?\s*(?:(\d+)\s*)?s\s*$"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_int(c: str | Column) -> Column:
    """whole-number text (optional sign, surrounding blanks) -> bigint,
    else null. '2.7' and '1_000' are rejected."""
    s = _c(c).cast("string")
    return F.when(s.rlike(INT_PATTERN), F.trim(s).try_cast("bigint"))


def parse_float(c: str | Column) -> Column:
    """decimal/scientific text, 'nan', 'inf' -> double, else null."""
    s = F.lower(F.trim(_c(c).cast("string")))
    s = F.regexp_replace(s, r"^([+-]?)infinity$", "$1inf")
    return F.when(s.rlike(FLOAT_PATTERN),
                  F.when(s == "nan", F.lit(float("nan")))
                  .when(s.isin("inf", "+inf"), F.lit(float("inf")))
                  .when(s == "-inf", F.lit(float("-inf")))
                  .otherwise(s.try_cast("double")))


def parse_date(c: str | Column) -> Column:
    """'YYYY-M-D' text -> date; impossible days (Feb 30) -> null."""
    s = _c(c).cast("string")
    return F.when(s.rlike(DATE_PATTERN), F.try_to_date(s, "yyyy-M-d"))


def parse_iso_timestamp(c: str | Column) -> Column:
    """ISO-8601 text with optional offset or 'Z' -> UTC wall-clock
    TIMESTAMP_NTZ. Bare times such as '10:00' are rejected."""
    s = F.trim(_c(c).cast("string"))
    instant = F.regexp_replace(s, "Z$", "+00:00").try_cast("timestamp")
    # render the instant as UTC wall clock whatever the session time zone is
    utc_wall = F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")
    return F.when(s.rlike(ISO_TS_PATTERN), utc_wall)


def coordinates(c: str | Column) -> Column:
    """struct(latitude, longitude) from text like 'Lat: 12.5, Lon: -3.25';
    null when the text does not carry two numbers."""
    s = _c(c)
    lat = parse_float(F.regexp_extract(s, COORD_PATTERN, 1))
    lon = parse_float(F.regexp_extract(s, COORD_PATTERN, 2))
    ok = s.contains("Lat:") & s.contains("Lon:") & lat.isNotNull() & lon.isNotNull()
    return F.when(ok, F.struct(lat.alias("latitude"), lon.alias("longitude")))


def duration_seconds(c: str | Column) -> Column:
    """F16: routing duration text -> seconds.

    '1h2m3s' -> 3723, '1h5s' -> 3605, '90s' -> 90, '2m5s' -> 125; text
    without an 's' (null, '', '1h', '2h', 'x') -> 0; text with an 's' that
    is not of the form [Hh][Mm][S]s, or whose sum exceeds 64 bits -> null.

    One regex checks the form; the parts are then cut with plain string
    functions (a regex per part costs several times more per row).
    """
    s = _c(c).cast("string")
    t = F.translate(s, " \t\n\r", "")
    has_h, h_rest = t.contains("h"), F.substring_index(t, "h", -1)
    rest = F.when(has_h, h_rest).otherwise(t)
    has_m = rest.contains("m")
    secs_txt = F.when(has_m, F.substring_index(rest, "m", -1)).otherwise(rest)

    def num(x: Column) -> Column:
        return F.coalesce(x.try_cast("bigint"), F.lit(0))

    hours = F.when(has_h, num(F.substring_index(t, "h", 1))).otherwise(F.lit(0))
    minutes = F.when(has_m, num(F.substring_index(rest, "m", 1))).otherwise(F.lit(0))
    seconds = num(F.substring_index(secs_txt, "s", 1))
    total = F.try_add(F.try_add(F.try_multiply(hours, F.lit(3600).cast("bigint")),
                                F.try_multiply(minutes, F.lit(60).cast("bigint"))), seconds).cast("bigint")
    return (F.when(s.isNull() | ~s.contains("s"), F.lit(0).cast("bigint"))
            .when(s.rlike(DURATION_PATTERN), total))
