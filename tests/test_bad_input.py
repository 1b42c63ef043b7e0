"""Bad values, empty inputs and replays: rows with an error, never a failed job."""

import datetime as dt

from pyspark.sql import functions as F

from larder.functions.parse import duration_seconds
from larder.operators import farm, logistics, market, search
from larder.sources.sinks import place_orders
from larder.streaming import alerts

SF = "/root/testdata/sf0.001"


def test_stream_reads_a_file_a_folder_and_an_empty_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "many" / "events.parquet"))
    events.limit(0).write.parquet(str(tmp_path / "none" / "events.parquet"))
    for stream in (alerts.alert_stream, alerts.alert_envelope_stream, alerts.alert_producer_stream,
                   alerts.readings_append_stream):
        one, many = stream(spark, SF), stream(spark, str(tmp_path / "many"))
        assert one.schema.simpleString() == many.schema.simpleString()
        assert one.exceptAll(many).count() == 0 and one.count() == many.count() > 0
        none = stream(spark, str(tmp_path / "none"))
        assert none.schema.simpleString() == one.schema.simpleString() and none.count() == 0


def test_duration_beyond_64_bits_is_null(spark):
    df = spark.createDataFrame([("9223372036854775807h0s",), ("1h5s",)], "t string")
    assert [r.s for r in df.select(duration_seconds("t").alias("s")).collect()] == [None, 3605]


def _orders(spark):
    d = dt.date(2024, 1, 2)
    items = spark.createDataFrame([
        ("ok", "c", d, 0, "p", "2"), ("empty", "c", d, None, None, None), ("who", None, d, 0, "p", "2"),
        ("huge", "c", d, 0, "p", "9000000000000000000"),
        ("word", "c", d, 0, "p", "2.7")],
        "request_id string, customer_id string, order_date date, pos int, product_id string, quantity_text string")
    cust = spark.createDataFrame([("c", "Street 1")], "customer_id string, shipping_address string")
    prices = spark.createDataFrame([("m", "p", "r", dt.date(2024, 1, 1), 1.5, "s")],
                                   "price_record_id string, product_id string, region string, market_date date, "
                                   "average_market_price_per_kg double, source string")
    return market.purchase_orders(items, cust, prices)


def test_orders_empty_unknown_and_huge_are_rejected(spark):
    orders, items, rejects = _orders(spark)
    assert [(r.request_id, r.total_amount) for r in orders.collect()] == [("ok", 3.0)]
    assert [r.request_id for r in items.collect()] == ["ok"]
    assert {r.request_id: r.error_code for r in rejects.collect()} == {
        "empty": "empty_items", "who": "missing_fields", "huge": "invalid_quantity",
        "word": "invalid_quantity_format"}


def test_placing_a_batch_twice_leaves_each_row_once(spark, tmp_path):
    for _ in range(2):
        place_orders(*_orders(spark), base=str(tmp_path), batch="b1")
    for table, n in (("orders", 1), ("order_items", 1), ("orders_quarantine", 4)):
        assert spark.read.parquet(f"{tmp_path}/{table}").count() == n


def test_pickup_errors(spark):
    req = spark.createDataFrame([
        ("ok", "f", "p", "5", "2024-01-10"), ("word", "f", "p", "2.7", "2024-01-10"),
        ("day", "f", "p", "5", "2024-02-30"), ("none", None, "p", "5", None), ("huge", "f", "p", "9" * 30, "2024-01-10")],
        "request_id string, farm_id string, product_id string, quantity_kg string, requested_date string")
    h = spark.createDataFrame([("f", "p", dt.date(2024, 1, 5), 9)],
                              "farm_id string, product_id string, harvest_date date, harvested_quantity_kg bigint")
    got = {r.request_id: r for r in farm.pickup_feasibility(req, h).collect()}
    assert {k: r.status for k, r in got.items()} == {"ok": "success", "word": "error", "day": "error",
                                                     "none": "error", "huge": "error"}
    assert got["none"].message == "Missing required fields in body: farm_id, requested_date"
    assert got["day"].message.startswith("Invalid requested_date")
    assert got["word"].available_kg is None and got["ok"].available_kg == 9


def test_vehicle_without_attributes_is_found(spark):
    req = spark.createDataFrame([("r", "v", ["c"])],
                                "request_id string, vehicle_id string, destination_locations array<string>")
    cust = spark.createDataFrame([("c", "Street 1")], "customer_id string, shipping_address string")
    veh = spark.createDataFrame([("v", None, None, None, None)],
                                "vehicle_id string, vehicle_type string, capacity_kg int, "
                                "has_temperature_monitoring boolean, carrier_name string")
    assert [r.status for r in logistics.delivery_destinations(req, cust, veh).collect()] == ["success"]


def test_search_rejects_and_no_text_exploded_without_wildcards(spark):
    req = spark.createDataFrame([("a", "x\\y"), ("b", "red"), ("c", None)], "request_id string, query string")
    assert [r.request_id for r in search.search_rejects(req).collect()] == ["a"]
    prods = spark.createDataFrame([("1", "Red apple", "c", "s"), ("2", "Pear", "c", "s")],
                                  "product_id string, product_name string, category string, "
                                  "storage_requirements string")
    got = search.product_search(req.filter(F.col("query") == "red"), prods).collect()
    assert [r.product_id for r in got] == ["1"]
