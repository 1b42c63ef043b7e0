"""Plan shape: no cartesian products or nested-loop joins anywhere, top-k
through WindowGroupLimit, filters pushed into the Parquet scan."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

STREAMING = {"alert_stream", "alert_producer_stream", "readings_append_stream",
             "alert_envelope_stream", "alert_sinks"}
NAMES = sorted(set(E.queries()) - STREAMING)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_topk_uses_window_group_limit(spark):
    p = plan(E.queries()["shipment_readings_top10"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


def test_filter_pushed_into_scan(spark):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()["near_expiry_stock"](spark, SF_SMALL).explain("formatted")
    p = buf.getvalue()
    # the date window on the derived expiry date reaches the scan as a range
    assert "GreaterThanOrEqual(l_shipdate,1998-06-15T00:00)" in p
    assert "LessThan(l_shipdate,1998-06-23T00:00)" in p
    # and only the needed columns are read
    assert "l_extendedprice" not in p and "l_discount" not in p
