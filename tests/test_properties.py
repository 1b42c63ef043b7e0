"""Properties from the test strategy: results do not depend on the number of
shuffle partitions, and the streaming jobs give the batch answer."""

import pytest

import __spark_entry__ as E
from check_oracle import digest
from conftest import SF_SMALL
from larder.sources.fixtures import Fixtures
from larder.streaming.alerts import classify_alerts


def run(df):
    return digest(df.columns, [tuple(r) for r in df.collect()])[0]


@pytest.mark.parametrize("name", ["advice_harvests", "pickup_feasibility", "route_stops",
                                  "orders_placed", "farm_search"])
def test_partition_count_does_not_change_results(spark, name):
    fn = E.queries()[name]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        a = run(fn(spark, SF_SMALL))
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = run(fn(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b


def test_alert_stream_equals_batch(spark):
    streamed = E.queries()["alert_stream"](spark, SF_SMALL)
    batch = classify_alerts(Fixtures(spark, SF_SMALL).alert_messages)
    assert run(streamed.select(*batch.columns)) == run(batch)
