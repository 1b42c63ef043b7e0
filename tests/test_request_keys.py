"""Request-key filters, posting lists and order bodies on small tables."""

import json

import pytest

from larder.operators import logistics, market, routes, search
from larder.operators.common import FILTER_BITS, requested
from larder.plans.explain import shuffled_rows
from larder.sources.fixtures import Fixtures

from conftest import SF_SMALL


class Stored:
    """Fixture tables as stored files, so that a plan's shuffles are the operator's own."""

    def __init__(self, spark, base):
        self.fx, self.spark, self.base = Fixtures(spark, SF_SMALL), spark, base

    def __getattr__(self, name):
        path = f"{self.base}/{name}"
        getattr(self.fx, name).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def test_no_requested_key_is_cut(spark):
    facts = spark.range(5000).selectExpr("cast(id as string) as k", "date_add(date'1998-01-01', cast(id % 900 as int)) as d",
                                         "id as v")
    for asked in ("id % 7 = 0", "id = 4321", "true", "false"):
        req = spark.range(5000).filter(asked).selectExpr("cast(id as string) as k",
                                                         "cast(date_add(date'1998-01-01', cast(id % 900 as int)) as string) as d")
        got = requested(facts, req, ["k", "d"])
        want = facts.join(req.selectExpr("k", "cast(d as date) as d"), ["k", "d"], "left_semi")
        assert want.exceptAll(got).count() == 0
        assert got.count() <= want.count() + 5000 * want.count() / FILTER_BITS * 3 + 5
    odd = spark.createDataFrame([(None,), ("",), ("0",)], "k string")
    assert requested(facts.withColumn("k", odd.select("k").limit(1).scalar()), odd, ["k"]).count() == 5000


def test_one_request_shuffles_next_to_nothing(spark, tmp_path):
    t = Stored(spark, tmp_path)
    one = lambda df: spark.createDataFrame(df.limit(1).collect(), df.schema)
    day, at = "1998-06-15", "1998-06-15 00:00:00"
    prices, shipments, readings, items = t.market_prices, t.shipments, t.cold_chain_readings, t.order_items
    n = {"prices": prices.count(), "shipments": shipments.count(), "items": items.count()}
    assert shuffled_rows(market.market_price_day(one(t.req_price), prices, day)) < n["prices"] / 100
    tracking = one(t.req_tracking)
    assert shuffled_rows(logistics.shipment_tracking(tracking, shipments)) < n["shipments"] / 100
    assert shuffled_rows(logistics.shipment_readings(tracking, shipments, readings)) < 30
    assert shuffled_rows(market.product_availability(one(t.req_availability), t.inventory_stock, shipments, items,
                                                     t.planting_schedules, day, at)) < n["items"] / 20  # 1 of 200 products
    route = one(t.req_routes)
    legs = t.route_legs
    of_route = legs.join(route, "route_id", "left_semi")
    own = of_route.count() + items.join(of_route, "order_id", "left_semi").count()
    assert shuffled_rows(routes.capacity_check(route, legs, items, t.vehicles)) < 3 * own + 50


def test_posting_lists_are_intersected(spark):
    names = [(f"{i:04d}", ("abcx" if i % 10 == 0 else "noise") + " " + ("qrsy" if i % 15 == 0 else "words")) for i in range(600)]
    t = spark.createDataFrame(names, "product_id string, product_name string")
    idx = t.select("product_id", search.F.explode(search._all_grams(search.F.col("product_name"))).alias("gram"))

    def count(pattern):
        p = spark.createDataFrame([(pattern,)], "pattern string")
        return search.candidates(p.withColumn("fragments", search._fragments(search.F.col("pattern"))), idx, "product_id").count()

    assert count("%abcx%") == 60 and count("%qrsy%") == 40
    assert count("%abcx%qrsy%") == 20 == count("%qrs%abc%")   # both lists; LIKE tells the order apart
    assert count("%abcx%zzz%") == 0 and count("%x%o%") <= 60   # a missing gram; 'o' is too common to read
    req = spark.createDataFrame([("a", "abcx%qrsy"), ("b", "qrsy%abcx"), ("c", "ABC_ q"), ("d", "o%o")], "request_id string, query string")
    full = t.selectExpr("*", "'c' as category", "'s' as storage_requirements")
    got = {}
    for r in search.product_search(req, full).collect():
        got.setdefault(r.request_id, set()).add(r.product_id)
    both = {i for i, n in names if "abcx" in n and "qrsy" in n}
    assert got["a"] == both == got["c"] and "b" not in got
    assert got["d"] == {i for i, n in names if n.count("o") >= 2}


CUSTOMERS = [("C1", "Quay 1"), ("C2", None)]
PRICES = [("r1", "p1", "EU", "1998-01-01", 2.0), ("r2", "p2", "EU", "1998-01-05", 1.25)]


@pytest.fixture(scope="module")
def place(spark):
    customers = spark.createDataFrame([(c, "n", "t", a) for c, a in CUSTOMERS],
                                      "customer_id string, customer_name string, customer_type string, shipping_address string")
    prices = spark.createDataFrame(PRICES, "price_record_id string, product_id string, region string, d string, "
                                           "average_market_price_per_kg double").selectExpr("*", "cast(d as date) as market_date")

    def run(bodies):
        rows = [(k, "1998-02-01", b if isinstance(b, str) else json.dumps(b)) for k, b in bodies.items()]
        df = spark.createDataFrame(rows, "request_id string, d string, body string").selectExpr(
            "request_id", "cast(d as date) as order_date", "body")
        return [{r.request_id: r for r in x.collect()} if i != 1 else x.collect()
                for i, x in enumerate(market.orders_from_json(df, customers, prices))]
    return run


def item(p="p1", q=2):
    return {"product_id": p, "quantity_kg": q}


def test_absent_and_null_fields_of_a_body(place):
    base = {"customer_id": "C1", "items": [item()]}
    orders, items, rejects = place({
        "plain": base, "null": base | {"status": None, "delivery_address": None, "delivery_date_requested": None},
        "given": base | {"status": 5, "delivery_address": "Dock", "delivery_date_requested": "1998-3-1"},
        "unknown": base | {"customer_id": "C9"}, "no customer": base | {"customer_id": None}, "no address": base | {"customer_id": "C2"},
        "soon": base | {"delivery_date_requested": "soon"}})
    row = lambda k: (orders[k].status, orders[k].delivery_address, str(orders[k].delivery_date_requested))
    assert row("plain") == ("Pending", "Quay 1", "1998-02-01")
    assert row("null") == (None, None, "None")
    assert row("given") == ("5", "Dock", "1998-03-01")
    assert row("unknown")[1] == row("no customer")[1] == "Unknown Address" and row("no address")[1] is None
    assert orders["no customer"].customer_id is None and orders["plain"].total_amount == 4.0
    assert rejects.keys() == {"soon"} and rejects["soon"].error_code == "invalid_delivery_date"
    assert len(items) == 6 and len({i.order_item_id for i in items}) == 6


def test_quantities_follow_int(place):
    q = {"1.9": 1.9, "true": True, "' 7 '": " 7 ", "big": 10**12}
    orders, items, rejects = place({k: {"customer_id": "C1", "items": [item("p2", v)]} for k, v in (q | {
        "false": False, "text": "2.7", "none": None, "list": [1], "zero": 0, "huge": 10**40, "over": 9 * 10**18}).items()})
    assert {r.request_id: r.ordered_quantity_kg for r in items} == {"1.9": 1, "true": 1, "' 7 '": 7, "big": 10**12}
    assert {k: r.error_code for k, r in rejects.items()} == {
        "false": "invalid_quantity", "zero": "invalid_quantity", "text": "invalid_quantity_format", "none": "invalid_quantity_format",
        "list": "invalid_quantity_format", "huge": "invalid_quantity_format", "over": "invalid_quantity"}
    assert rejects["over"].error_message == "Quantity too large for product p2."


def test_first_bad_item_and_broken_bodies(place):
    body = lambda *items: {"customer_id": "C1", "items": list(items)}
    _, items, rejects = place({
        "second": body(item(), {"product_id": "p1"}, item(q=0)), "null product": body(item(p=None)), "scalar": body(7), "text": body("x"),
        "empty": body(), "object": {"customer_id": "C1", "items": {"a": 1}}, "null items": {"customer_id": "C1", "items": None},
        "no items": {"customer_id": "C1"}, "nothing": {}, "not an object": "[1]", "no JSON": "{", "early": body(item("p3"))})
    assert not items
    assert {k: (r.error_code, r.pos) for k, r in rejects.items()} == {
        "second": ("missing_item_field", 1), "null product": ("no_price", 0), "scalar": ("missing_item_field", 0),
        "text": ("missing_item_field", 0), "empty": ("empty_items", None), "object": ("empty_items", None),
        "null items": ("empty_items", None), "no items": ("missing_fields", None), "nothing": ("missing_fields", None),
        "not an object": ("missing_fields", None), "no JSON": ("missing_fields", None), "early": ("no_price", 0)}
    assert rejects["nothing"].error_message == "Missing required fields in body: customer_id, items"
    assert rejects["null product"].error_message.startswith("No market price found for product None on")


def test_the_filter_cuts_as_well_for_very_many_requests(spark):
    """A million requests once set most of the filter's bits, so facts that nobody asks for passed."""
    req = spark.range(1_000_000).selectExpr("concat('q', id) as k")
    facts = spark.range(200_000).selectExpr("concat(if(id < 1000, 'q', 'f'), id) as k")
    got = requested(facts, req, ["k"])
    assert got.filter("k like 'q%'").count() == 1000
    assert got.filter("k like 'f%'").count() < 20_000
