"""Boundary cases of the scalar expressions (FIXTURES.md section 4)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from larder.functions.bands import band_message, temperature_band
from larder.functions.ids import stable_id
from larder.functions.parse import (coordinates, duration_seconds, parse_date, parse_float,
                                    parse_int, parse_iso_timestamp)


def one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_temperature_bands(spark):
    vals = [8.0, 8.01, 15.0, 15.01, float("nan"), None, -3.0]
    got = one_col(spark, vals, temperature_band, "double")
    assert got == ["normal", "elevated", "elevated", "critical", "normal", None, "normal"]


def test_band_messages(spark):
    got = one_col(spark, ["normal", "elevated", "critical"], band_message)
    assert got[0] == "Cold chain reading reported successfully."
    assert got[1].endswith("Warning: Temperature is elevated.")
    assert got[2] == "Critical: High temperature excursion reported."


def test_parse_int(spark):
    got = one_col(spark, ["12", " +7 ", "-3", "2.7", "1_000", "", None, "x"], parse_int)
    assert got == [12, 7, -3, None, None, None, None, None]


def test_parse_float(spark):
    got = one_col(spark, ["1.5", " 2 ", "1e3", "nan", "inf", "-Infinity", "hot", None],
                  parse_float)
    assert got[:3] == [1.5, 2.0, 1000.0]
    assert math.isnan(got[3]) and got[4] == math.inf and got[5] == -math.inf
    assert got[6:] == [None, None]


def test_parse_date(spark):
    got = one_col(spark, ["2024-01-05", "2024-1-5", "2024-02-30", "2024", "2024-01-05T10:00",
                          " 2024-01-05"], parse_date)
    assert got == [dt.date(2024, 1, 5), dt.date(2024, 1, 5), None, None, None, None]


def test_parse_iso_timestamp(spark):
    got = one_col(spark, ["2024-01-01T10:00:00Z", "2024-01-01T10:00:00+05:30",
                          "2024-01-01 10:00:00", "10:00", "garbage"], parse_iso_timestamp)
    assert got == [dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 4, 30),
                   dt.datetime(2024, 1, 1, 10), None, None]


def test_duration_seconds(spark):
    vals = [None, "", "1h", "90s", "2m5s", "1h5s", "1h2m3s", "x", "xs", "2h"]
    got = one_col(spark, vals, duration_seconds)
    assert got == [0, 0, 0, 90, 125, 3605, 3723, 0, None, 0]


def test_coordinates(spark):
    vals = ["Lat: 12.5, Lon: -3.25", "Lat: x, Lon: 1", "Main street 1", None]
    got = one_col(spark, vals, coordinates)
    assert (got[0].latitude, got[0].longitude) == (12.5, -3.25)
    assert got[1:] == [None, None, None]


def test_stable_id_is_deterministic(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", None)], "x string, y string")
    ids = [r[0] for r in df.select(stable_id("x", "y")).collect()]
    assert ids[0] == ids[1] and ids[0] != ids[2] and len(ids[0]) == 64


def test_stable_id_keeps_parts_apart(spark):
    df = spark.createDataFrame([("a~b", "c"), ("a", "b~c"), ("", None), (None, ""), ("1:a", "")],
                               "x string, y string")
    assert len({r[0] for r in df.select(stable_id("x", "y")).collect()}) == 5
