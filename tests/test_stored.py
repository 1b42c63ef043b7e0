"""Commit marks, sinks per class, broker records, lookups, cards, Python's texts."""

import base64
import datetime as dt
import json

import pytest

from larder.functions.text import float_text, json_text
from larder.operators import cards, farm, search
from larder.sources import sinks
from larder.sources.requests import parse_requests
from larder.sources.tables import lookup
from larder.streaming import alerts
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ORDER = "request_id string, order_id string, customer_id string, total_amount double"
ITEM = "order_id string, order_item_id string, product_id string"


def batch(spark, *ids):
    return (spark.createDataFrame([(i, i, "c", 1.0) for i in ids], ORDER), spark.createDataFrame([(i, i + "1", "p") for i in ids], ITEM),
            spark.createDataFrame([("r", "code")], "request_id string, error_code string"))


def stored(spark, base, table="orders"):
    return sorted(r.order_id for r in sinks.read_committed(spark, base, table).collect())


def test_a_crash_between_the_tables_shows_neither(spark, tmp_path, monkeypatch):
    base, commit = str(tmp_path), sinks._commit
    sinks.place_orders(*batch(spark, "a", "b"), base, "7")
    assert stored(spark, base) == stored(spark, base, "order_items") == ["a", "b"]

    def dies(*args):
        raise RuntimeError("lost")
    monkeypatch.setattr(sinks, "_commit", dies)
    for name, ids in (("8", "cd"), ("7", "xy")):   # a new batch, and a replay of a committed one
        with pytest.raises(RuntimeError):
            sinks.place_orders(*batch(spark, *ids), base, name)
        assert stored(spark, base) == stored(spark, base, "order_items") == ["a", "b"]
    monkeypatch.setattr(sinks, "_commit", commit)
    sinks.place_orders(*batch(spark, "c", "d"), base, "8")
    sinks.place_orders(*batch(spark, "a"), base, "7")
    assert stored(spark, base) == stored(spark, base, "order_items") == ["a", "c", "d"]
    assert sinks.read_committed(spark, base, "orders_quarantine").count() == 2


def test_nothing_committed_yet(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "_commit", lambda *a: None)
    sinks.place_orders(*batch(spark, "a"), str(tmp_path), "7")
    assert stored(spark, str(tmp_path)) == []


def test_a_replayed_batch_replaces_its_rows_in_every_sink(spark, tmp_path):
    base = str(tmp_path)
    rows = lambda *x: spark.createDataFrame(list(x), "id int, k string")
    write = lambda df, n, q="q": sinks.write_classes(df, n, q, base, "k", ("a", "b"), "other")
    write(rows((1, "a"), (2, "b"), (3, None), (4, "z")), 0)
    write(rows((5, "a")), 1)
    write(rows((1, "a"), (2, "b"), (3, None), (4, "z")), 0)
    write(rows((9, "b")), 0, "another")
    got = {n: sorted(r.id for r in spark.read.parquet(f"{base}/{n}").collect()) for n in ("a", "b", "other")}
    assert got == {"a": [1, 5], "b": [2, 9], "other": [3, 4]}


RECORD = ("key binary, value binary, topic string, partition int, offset long, timestamp timestamp, "
          "headers array<struct<key:string,value:binary>>")


def test_messages_from_records(spark):
    body = base64.b64encode(b'{"severity":"Critical"}')
    at = dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc)
    rows = [(None, body, "t", 1, 10, at, [("messageId", b"m1"), ("publishTime", b"2020-01-01T00:00:00")]),
            (None, body, "t", 1, 11, at, None), (None, None, "t", 2, 12, at, []),
            (None, b"\xff", "t", 2, 13, at, [("messageId", b"x"), ("messageId", b"y")])]
    zone = spark.conf.get("spark.sql.session.timeZone")
    for tz in ("UTC", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", tz)
        got = [tuple(r) for r in alerts.messages_from_records(spark.createDataFrame(rows, RECORD)).collect()]
        assert got == [("m1", "2020-01-01T00:00:00", body.decode()), ("t-1-11", "2024-01-02T03:04:05", body.decode()),
                       ("t-2-12", "2024-01-02T03:04:05", None), ("y", "2024-01-02T03:04:05", None)]
    spark.conf.set("spark.sql.session.timeZone", zone)
    classes = [r.alert_class for r in alerts.classify_alerts(alerts.messages_from_records(spark.createDataFrame(rows, RECORD))).collect()]
    assert classes == ["critical", "critical", "no_data", "no_data"]


def test_lookup_binds_values(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.createDataFrame([("1", "O'Hara"), ("2", "x' OR '1'='1"), ("3", "plain")], "customer_id string, customer_name string")
    sinks.append(rows, f"{base}/customers", "customers")
    ask = lambda q, **p: sorted(r.customer_id for r in lookup(spark, base, q, ["customers"], **p).collect())
    assert ask("SELECT * FROM customers WHERE customer_name = :n", n="O'Hara") == ["1"]
    assert ask("SELECT * FROM customers WHERE customer_name = :n", n="x' OR '1'='1") == ["2"]
    assert ask("SELECT * FROM customers WHERE array_contains(:ids, customer_id)", ids=["1", "3", "'"]) == ["1", "3"]


def test_cards_without_sections(spark):
    req = spark.createDataFrame([("a",), ("b",)], "request_id string")
    some = spark.createDataFrame([("a", 2, "y", None), ("a", 1, "x", 1.5)], "request_id string, rank int, t string, v double")
    got = {r.request_id: [tuple(x) for x in r.s] for r in cards.gather(req, {"s": some, "empty": some.limit(0)}).collect()}
    assert got == {"a": [("x", 1.5), ("y", None)], "b": []}
    ts = spark.sql("select timestamp_ntz'2024-01-02 03:04:05' a, timestamp_ntz'2024-01-02 03:04:05.25' b, cast(null as timestamp_ntz) c")
    assert list(ts.select(*[cards.iso_text(c) for c in "abc"]).first()) == ["2024-01-02T03:04:05", "2024-01-02T03:04:05.250000", None]


def test_licence_is_required(spark):
    v = spark.createDataFrame([("v", "c", "t", 1, True, "L1")], "vehicle_id string, carrier_name string, vehicle_type string, "
                              "capacity_kg long, has_temperature_monitoring boolean, vehicle_license_no string")
    req = spark.createDataFrame([("a", "L1"), ("b", ""), ("c", None), ("d", "L2")], "request_id string, vehicle_license_no string")
    got = {r.request_id: (r.status, r.found, r.message) for r in search.vehicle_by_license(req, v).collect()}
    assert got == {"a": ("success", True, None), "b": ("error", False, search.NO_LICENSE), "c": ("error", False, search.NO_LICENSE),
                   "d": ("not_found", False, None)}


def test_null_notes_of_a_json_report_stay_null(spark):
    body = '{"report_id":"%s","farm_id":"f","product_id":"p","harvested_quantity_kg":"5","harvest_date":"2024-01-01"%s}'
    lines = spark.createDataFrame([(body % (k, x),) for k, x in (("absent", ""), ("null", ',"quality_notes":null'),
                                                                ("given", ',"quality_notes":"n"'))], "value string")
    r = parse_requests(lines, StructType.fromDDL("report_id string, farm_id string, product_id string, harvested_quantity_kg string, "
                                                 "harvest_date string, quality_notes string"))
    r = r.withColumns({"quantity_text": F.col("harvested_quantity_kg"), "date_text": F.col("harvest_date")})
    valid, rejects = farm.harvest_log(r)
    assert rejects.count() == 0 and sorted(str(x.quality_notes) for x in valid.collect()) == ["", "None", "n"]
    plain = r.drop("_raw", "_corrupt_record")
    assert sorted(str(x.quality_notes) for x in farm.harvest_log(plain)[0].collect()) == ["", "", "n"]


FLOATS = [0.0, -0.0, 1.0, -2.5, 0.1, 1e-3, 1.5e-4, 1e-4, 9.99e-5, 1e-5, 1e-10, 1234567.0, 1e7, -12345678.5, 123456789012.25, 1e15, 1e16,
          1.5e16, 123456789012345680.0, 1e22, 1e100, 1.7976931348623157e308, 5e-300, float("nan"), float("inf"), -float("inf")]


def test_texts_are_those_of_python(spark):
    df = spark.createDataFrame([(x,) for x in FLOATS], "x double")
    assert [r[0] for r in df.select(float_text(F.col("x"))).collect()] == [str(x) for x in FLOATS]
    texts = ['"t"', "true", "false", "7", "-3", "12345678901234567890", "2.50", "65.0", "7.00", "1e3", "1e20", "0.00001", "100000000.5"]
    df = spark.createDataFrame([(t,) for t in texts], "j string").select(json_text(F.try_parse_json("j")))
    assert [r[0] for r in df.collect()] == [str(json.loads(t)) for t in texts]


def test_bucketed_tables_join_on_their_key_without_a_shuffle(spark, tmp_path):
    from larder.operators import market, routes
    from larder.sources.tables import store_bucketed
    orders = spark.range(400).selectExpr("cast(id as string) order_id", "cast(id % 7 as string) customer_id",
                                         "concat('Lat: ', id, '.5, Lon: 1.0') delivery_address")
    items = spark.range(900).selectExpr("cast(id % 400 as string) order_id", "cast(id % 5 as string) product_id", "id ordered_quantity_kg")
    ships = orders.selectExpr("order_id", "'In Transit' status", "timestamp_ntz'2000-01-01 00:00:00' arrival_timestamp_estimate")
    o, i, s = (store_bucketed(df, f"{tmp_path}/{n}", "order_id", 4) for n, df in (("o", orders), ("i", items), ("s", ships)))

    def by_order(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return [x for x in plan.splitlines() if "Exchange hashpartitioning(order_id" in x]

    total = routes.order_total_kg(i)
    assert total.count() == 400 and not by_order(total) and by_order(routes.order_total_kg(items.repartition(3)))
    req = spark.createDataFrame([("a", "1"), ("b", "9")], "request_id string, product_id string")
    incoming = market.incoming_shipments(req, s, i, "1998-01-01 00:00:00")
    assert {r.request_id: r.total_incoming_shipments_kg for r in incoming.collect()} == {"a": sum(range(1, 900, 5)), "b": 0}
    assert not by_order(incoming)
    customers = spark.range(7).selectExpr("cast(id as string) customer_id")
    dest = spark.range(50).selectExpr("'r' request_id", "id pos", "cast(id as string) order_id")
    got = routes.order_destinations(dest, o, customers, i)
    assert got.count() == 50 and len(by_order(got)) <= 1  # the list itself; neither table
