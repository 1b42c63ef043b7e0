"""Operators on tiny hand-made tables: the boundary rows of FIXTURES.md
section 4, plus batch/single-request and chunking properties."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.operators import farm, logistics, market, routes, search
from larder.operators.validate import split_requests
from larder.operators.window import running_sum
from larder.streaming.alerts import classify_alerts

D = dt.date
AS_OF = "1998-06-15"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ------------------------------------------------------------------ H4
def test_pickup_feasibility_boundaries(spark):
    h = spark.createDataFrame(
        [("f", "p", D(2024, 1, 10), 30), ("f", "p", D(2024, 1, 3), 20),
         ("f", "p", D(2024, 1, 2), 1000)],
        "farm_id string, product_id string, harvest_date date, harvested_quantity_kg long")
    req = spark.createDataFrame(
        [("lt", "f", "p", 49, D(2024, 1, 10)), ("eq", "f", "p", 50, D(2024, 1, 10)),
         ("gt", "f", "p", 51, D(2024, 1, 10)), ("none", "g", "p", 1, D(2024, 1, 10)),
         ("later", "f", "p", 30, D(2024, 1, 17))],
        "request_id string, farm_id string, product_id string, quantity_kg long, "
        "requested_date date")
    got = {r.request_id: r for r in farm.pickup_feasibility(req, h).collect()}
    assert got["lt"].status == "success" and got["lt"].confirmed_quantity_kg == 49
    assert got["eq"].status == "success" and got["eq"].available_kg == 50
    assert got["gt"].status == "unavailable" and got["gt"].confirmed_quantity_kg is None
    assert "Only found approximately 50 kg" in got["gt"].message
    assert got["none"].available_kg == 0
    assert got["later"].available_kg == 30


# ------------------------------------------------------------------ H11
def test_near_expiry_bounds(spark):
    stock = spark.createDataFrame(
        [(f"s{i}", "p", "L", 1, D(1998, 5, 1), D(1998, 6, 1), d, "x", "Available")
         for i, d in enumerate([D(1998, 6, 14), D(1998, 6, 15), D(1998, 6, 22), D(1998, 6, 23)])],
        "stock_id string, product_id string, location_id string, current_quantity_kg long, "
        "entry_date date, best_before_date date, expiry_date date, storage_conditions string, "
        "status string")
    got = rows(logistics.near_expiry_stock(stock, AS_OF), "stock_id")
    assert got == [("s1",), ("s2",)]
    req = spark.createDataFrame(
        [("near", "L", None, None, True), ("all", "L", None, None, False),
         ("empty_status", "L", None, "", False), ("other", "L", "q", None, False)],
        "request_id string, location_id string, product_id string, status string, "
        "nearing_expiry boolean")
    out = logistics.warehouse_stock(req, stock, AS_OF)
    per = {}
    for r in out.collect():
        per.setdefault(r.request_id, []).append((r.rank, r.stock_id))
    assert sorted(per["near"]) == [(1, "s1"), (2, "s2")]
    assert sorted(per["all"]) == [(1, "s0"), (2, "s1"), (3, "s2"), (4, "s3")]
    assert "empty_status" not in per and "other" not in per


# ------------------------------------------------------------------ H2
def test_advice_optional_filters_and_general_issues(spark):
    issues = spark.createDataFrame(
        [("i1", "f1", "p1", D(1998, 6, 1)), ("i2", "f1", None, D(1998, 6, 2)),
         ("i3", "f1", "p2", D(1998, 6, 3)), ("i4", "f2", None, D(1998, 6, 4))],
        "issue_id string, farm_id string, product_id string, issue_date date"
    ).withColumn("issue_type", F.lit("t")).withColumn("severity", F.lit("s")) \
     .withColumn("notes", F.lit("n"))
    req = spark.createDataFrame(
        [("fp", "f1", "p1", None, None), ("f_only", "f1", "", None, None),
         ("p_only", None, "p1", None, None), ("none", None, None, D(1998, 6, 3), None)],
        "request_id string, farm_id string, product_id string, start_date date, end_date date")
    out = farm.advice_qc_issues(req, issues, AS_OF)
    per = {}
    for r in out.collect():
        per.setdefault(r.request_id, []).append((r.rank, r.issue_date.day))
    assert sorted(per["fp"]) == [(1, 2), (2, 1)]          # p1 or farm-wide, farm f1
    assert sorted(per["f_only"]) == [(1, 3), (2, 2), (3, 1)]  # '' means no product filter
    assert sorted(per["p_only"]) == [(1, 4), (2, 2), (3, 1)]  # farm-wide issues of any farm
    assert sorted(per["none"]) == [(1, 4), (2, 3)]        # start only


def test_advice_batch_equals_single_requests(spark):
    from larder.sources.fixtures import Fixtures
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    req = fx.req_advice.limit(40).cache()
    batch = rows(farm.advice_harvests(req, fx.harvest_records, AS_OF),
                 "request_id", "rank", "harvest_date")
    singles = []
    for rid in [r.request_id for r in req.select("request_id").collect()][:6]:
        one = req.filter(F.col("request_id") == rid)
        singles += rows(farm.advice_harvests(one, fx.harvest_records, AS_OF),
                        "request_id", "rank", "harvest_date")
    ids = {s[0] for s in singles}
    assert sorted(singles) == [b for b in batch if b[0] in ids]


def test_advice_many_windows_without_keys(spark):
    """10,000 windows without keys give at most 5 rows each, equal to a plain
    scan; the plan makes no row per day or year of a window."""
    day0 = D(1998, 1, 1)
    facts = [(f"h{i}", f"f{i % 3}", f"p{i % 5}", day0 + dt.timedelta(days=i * 7 % 200)) for i in range(900)]
    h = spark.createDataFrame(facts, "harvest_id string, farm_id string, product_id string, harvest_date date") \
        .withColumns({"harvested_quantity_kg": F.substring("harvest_id", 2, 9).cast("long"),
                      "quality_score": F.lit(1.0), "quality_notes": F.lit("n")})
    req = spark.range(10_000).select(
        F.col("id").cast("string").alias("request_id"), F.lit(None).cast("string").alias("farm_id"),
        F.lit("").alias("product_id"),
        F.when(F.col("id") % 7 != 0, F.date_add(F.lit(day0), (F.col("id") / 100).cast("int"))).alias("start_date"),
        F.date_add(F.lit(day0), (F.col("id") % 100 * 2).cast("int")).alias("end_date"))
    out = farm.advice_harvests(req, h, AS_OF)
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r.request_id, {})[r.rank] = r.harvested_quantity_kg
    order = sorted(facts, key=lambda f: (-f[3].toordinal(), f[0]))
    for i in range(0, 10_000, 37):
        lo = day0 + dt.timedelta(days=i // 100) if i % 7 else None
        hi = day0 + dt.timedelta(days=i % 100 * 2)
        want = [int(f[0][1:]) for f in order if (lo is None or f[3] >= lo) and f[3] <= hi][:5]
        assert got.get(str(i), {}) == dict(enumerate(want, 1))


# ------------------------------------------------------------------ H8
def test_orders_address_fallback_and_first_error(spark):
    cust = spark.createDataFrame([("c1", "addr 1"), ("c2", None)],
                                 "customer_id string, shipping_address string")
    prices = spark.createDataFrame(
        [("r1", "p", "EU", D(2024, 1, 1), 2.005, "s"), ("r2", "p", "FR", D(2024, 1, 1), 9.0, "s"),
         ("r3", "p", "EU", D(2024, 1, 5), 3.0, "s")],
        "price_record_id string, product_id string, region string, market_date date, "
        "average_market_price_per_kg double, source string")
    items = spark.createDataFrame(
        [("o1", "c1", D(2024, 1, 4), 1, "p", "2"), ("o2", "c2", D(2024, 1, 5), 1, "p", "1"),
         ("o3", "zz", D(2024, 1, 5), 1, "p", "1"), ("o4", "c1", D(2024, 1, 5), 2, "p", "0"),
         ("o4", "c1", D(2024, 1, 5), 1, "p", "2.7"), ("o5", "c1", D(2023, 1, 1), 1, "p", "1")],
        "request_id string, customer_id string, order_date date, pos int, product_id string, "
        "quantity_text string")
    orders, its, rej = market.purchase_orders(items, cust, prices)
    o = {r.request_id: r for r in orders.collect()}
    # 2.005 * 100 is exactly 200.5 in IEEE doubles, so half-up gives 201 cents
    assert o["o1"].delivery_address == "addr 1" and o["o1"].total_amount == 4.02
    assert o["o2"].delivery_address is None            # known customer, null address
    assert o["o3"].delivery_address == "Unknown Address"
    assert o["o2"].total_amount == 3.0                 # as-of picks the same-day price
    r = {x.request_id: x for x in rej.collect()}
    assert r["o4"].error_code == "invalid_quantity_format" and r["o4"].pos == 1
    assert r["o5"].error_code == "no_price"
    assert {x.request_id for x in its.collect()} == {"o1", "o2", "o3"}


# ------------------------------------------------------------------ H12
def test_destinations_duplicates_unknown_and_vehicle(spark):
    cust = spark.createDataFrame([("c1", "a1"), ("c2", "a2")],
                                 "customer_id string, shipping_address string")
    veh = spark.createDataFrame([("V1", "Van", "x", 10, True, "L1")],
                                "vehicle_id string, vehicle_type string, carrier_name string, "
                                "capacity_kg long, has_temperature_monitoring boolean, "
                                "vehicle_license_no string")
    req = spark.createDataFrame(
        [("ok", "V1", ["c2", "c1", "c2", "nope"]), ("nov", "V9", ["c1"]),
         ("nod", "V1", ["x", "y"]), ("empty", "V1", []), ("nolist", "V1", None)],
        "request_id string, vehicle_id string, destination_locations array<string>")
    out = logistics.delivery_destinations(req, cust, veh)
    got = rows(out, "request_id", "destination_id", "position", "status")
    assert got == [("empty", None, None, "error"), ("nod", None, None, "unavailable"),
                   ("nolist", None, None, "error"), ("nov", None, None, "not_found"),
                   ("ok", "c1", 1, "success"), ("ok", "c2", 0, "success")]
    msg = {r.request_id: r.message for r in out.collect()}
    assert msg["empty"] == "Field 'destination_locations' must be a non-empty list."
    assert msg["nolist"] == "Missing required fields in body: destination_locations"


# ------------------------------------------------------------------ H7
def test_incoming_counts_two_shipments_twice(spark):
    ship = spark.createDataFrame(
        [("s1", "o1", "In Transit", dt.datetime(1998, 7, 1)),
         ("s2", "o1", "In Transit", dt.datetime(1998, 7, 2)),
         ("s3", "o2", "Delivered", dt.datetime(1998, 7, 2))],
        "shipment_id string, order_id string, status string, "
        "arrival_timestamp_estimate timestamp_ntz")
    items = spark.createDataFrame([("o1", "p", 5), ("o2", "p", 7)],
                                  "order_id string, product_id string, ordered_quantity_kg long")
    req = spark.createDataFrame([("r", "p"), ("z", "q")], "request_id string, product_id string")
    got = rows(market.incoming_shipments(req, ship, items, "1998-06-15 00:00:00"),
               "request_id", "total_incoming_shipments_kg")
    assert got == [("r", 10), ("z", 0)]


# ------------------------------------------------------------- H15-H17
def test_search_wildcards_case_and_browse(spark):
    prods = spark.createDataFrame(
        [(str(i), n, "c", "s") for i, n in enumerate(
            ["Red Plate", "rose dish", "blue cup", "o-d thing", "50% off", "ab"])],
        "product_id string, product_name string, category string, storage_requirements string")
    req = spark.createDataFrame(
        [("mixed", "RED"), ("under", "o_d"), ("pct", "%"), ("empty", ""), ("nul", None),
         ("bs", "a\\b"), ("short", "b"), ("two_wild", "__"), ("none", "zzz")],
        "request_id string, query string")
    out = search.product_search(req, prods)
    per = {}
    for r in out.collect():
        per.setdefault(r.request_id, set()).add(r.product_name)
    assert per["mixed"] == {"Red Plate"}
    assert per["under"] == {"o-d thing"}
    assert per["pct"] == set(prods.toPandas().product_name)
    assert per["empty"] == per["nul"] == per["pct"]
    assert "bs" not in per and "none" not in per
    assert per["short"] == {"ab", "blue cup"}
    assert per["two_wild"] == per["pct"]


# ------------------------------------------------------------------ W1
def test_running_sum_chunks_equal_plain_window(spark):
    df = spark.range(0, 500).select(
        (F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("seq"),
        (F.col("id") % 7).alias("v"))
    chunked = running_sum(df, ["k"], "seq", "v", "s", chunk=16)
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("s", F.sum("v").over(w))
    assert rows(chunked, "k", "seq", "s") == rows(plain, "k", "seq", "s")


def test_route_stop_arrivals(spark):
    # o3 has no coordinates, o4 no customer, o1 is listed twice: leg i ends at
    # the i-th order that is left, and the last leg has none
    legs = spark.createDataFrame(
        [("r", 1, "90s", 10), ("r", 2, "1h2m3s", 20), ("r", 3, "2h", 5), ("r", 4, "7s", 1)],
        "route_id string, leg_seq long, duration_text string, distance_m long")
    dest = spark.createDataFrame(
        [("q", 0, "o3"), ("q", 1, "o1"), ("q", 2, "o4"), ("q", 3, "o2"), ("q", 4, "o1"),
         ("q", 5, "o5"), ("none left", 0, "o3"), ("no origin", 0, "o1"), ("unknown", 0, "o1"),
         ("no legs", 0, "o1")], "request_id string, pos long, order_id string")
    customers = spark.createDataFrame([("c",)], "customer_id string")
    farms = spark.createDataFrame([("F", "n", "Lat: 1.5, Lon: 2.5", "s", "c")],
                                  "farm_id string, farm_name string, farm_location string, "
                                  "supplier_name string, primary_crops_grown string")
    wh = spark.createDataFrame([], "warehouse_id string, location_address string")
    at = "Lat: 1, Lon: 2"
    orders = spark.createDataFrame(
        [("o1", "c", at), ("o2", "c", at), ("o3", "c", None), ("o4", "x", at), ("o5", "c", "Here")],
        "order_id string, customer_id string, delivery_address string")
    geocodes = spark.createDataFrame([("Here", 5.0, 6.0)],
                                     "address string, latitude double, longitude double")
    items = spark.createDataFrame([("o1", 3), ("o1", 4)],
                                  "order_id string, ordered_quantity_kg long")
    at8, day = dt.datetime(2024, 1, 1, 8), D(2024, 1, 1)
    req = spark.createDataFrame(
        [("q", "r", "F", "V", at8, day), ("none left", "r", "F", "V", at8, day),
         ("no origin", "r", "", "V", at8, day), ("unknown", "r", "G", "V", at8, day),
         ("no legs", "s", "F", "V", at8, day), ("empty", "r", "F", "V", at8, day)],
        "request_id string, route_id string, origin_location_id string, vehicle_id string, "
        "departure_time timestamp_ntz, route_date date")
    args = (req, legs, dest, orders, customers, items, farms, wh, geocodes)
    got = routes.route_stops(*args).collect()
    assert {r.request_id for r in got} == {"q"}
    stops = {r.stop_number: r for r in got}
    assert stops[0].location_id == "F" and sorted(stops) == [0, 1, 2, 3]
    assert [stops[i].destination_id for i in (1, 2, 3)] == ["o1", "o2", "o5"]
    assert stops[1].estimated_arrival_time == dt.datetime(2024, 1, 1, 8, 1, 30)
    assert stops[2].estimated_arrival_time == dt.datetime(2024, 1, 1, 9, 3, 33)
    assert stops[3].estimated_arrival_time == stops[2].estimated_arrival_time  # '2h' -> 0
    assert stops[1].total_kg_for_stop == 7 and stops[2].total_kg_for_stop == 0
    head = {r.request_id: r for r in routes.route_headers(*args).collect()}
    assert {k: r.status for k, r in head.items()} == {
        "q": "success", "none left": "unavailable", "no origin": "error",
        "unknown": "not_found", "no legs": "unavailable", "empty": "error"}
    assert head["q"].num_stops_on_route == 5 and head["q"].estimated_total_duration == "3820s"
    assert head["empty"].message == "Missing required input parameters"


def test_split_requests_keeps_every_request_once(spark):
    req = spark.createDataFrame([("a", "p", D(2024, 1, 1), None), ("b", None, None, None),
                                 ("c", "p", D(2024, 1, 1), D(2024, 1, 2))],
                                "request_id string, product_id string, target_date_start date, "
                                "target_date_end date")
    good, bad = split_requests(req, "demand_forecast")
    assert [r.request_id for r in good.collect()] == ["c"] and good.columns == req.columns
    assert {r.request_id: r.message for r in bad.collect()} == {
        "a": "Missing required fields in body: target_date_end",
        "b": "Missing required fields in body: product_id, target_date_start, target_date_end"}


# ------------------------------------------------------------------ H19
def test_alert_classes(spark):
    import base64

    def b64(s):
        return base64.b64encode(s.encode() if isinstance(s, str) else s).decode()
    msgs = [("m1", b64('{"severity":"Critical","shipment_id":"S","temperature":16.5,'
                       '"message":"hot"}')),
            ("m2", b64('{"severity":"Warning","shipment_id":null,"temperature":9}')),
            ("m3", b64('{"severity":"critical"}')), ("m4", b64("{}")), ("m5", b64("[1]")),
            ("m6", b64("plain words")), ("m7", "aGVsbG8"), ("m8", b64(b"\xff\xfe")),
            ("m9", None), ("m10", "!!!")]
    df = spark.createDataFrame(msgs, "message_id string, data string") \
        .withColumn("publish_time", F.lit(None).cast("timestamp_ntz"))
    got = {r.message_id: r for r in classify_alerts(df).collect()}
    assert got["m1"].alert_class == "critical"
    assert got["m1"].text == "Shipment S: HIGH TEMP 16.5°C - hot"
    assert got["m2"].alert_class == "warning"
    assert got["m2"].text == "Shipment None: Elevated Temp 9°C - No message"
    assert got["m3"].alert_class == "info"
    assert got["m4"].text == "Info Alert: Shipment Unknown Shipment, Temp N/A°C - No message"
    assert got["m5"].alert_class == "error"
    assert got["m6"].alert_class == "plain_text" and got["m6"].text == "plain words"
    assert got["m7"].alert_class == "error"      # bad padding
    assert got["m8"].alert_class == "error"      # bad UTF-8
    assert got["m9"].alert_class == "no_data"
    assert got["m10"].alert_class == "plain_text" and got["m10"].text == ""


def test_row_number_bucketed_equals_plain(spark):
    from larder.operators.window import row_number_bucketed
    df = spark.range(0, 400).select(
        (F.col("id") % 3).alias("k"), (F.col("id") % 11).alias("day"),
        (F.col("id") * 7 % 13).alias("a"), F.col("id").alias("b"))
    got = row_number_bucketed(df, ["k"], "day", ["a", "b"], "rn")
    w = Window.partitionBy("k").orderBy("day", "a", "b")
    want = df.withColumn("rn", F.row_number().over(w))
    assert rows(got, "k", "b", "rn") == rows(want, "k", "b", "rn")


def test_alert_envelope_classes(spark):
    import base64
    import json
    from larder.streaming.alerts import classify_envelopes

    def env(message, attributes=None):
        d = {"message": message}
        if attributes is not None:
            d["attributes"] = attributes
        return json.dumps(d)
    ok = base64.b64encode(b'{"severity":"Warning","shipment_id":"S","temperature":9.5}').decode()
    rows_ = [("e1", "[1, 2]"), ("e2", "not json"), ("e3", env(None)), ("e4", env({})),
             ("e5", env({"messageId": "inner"})),
             ("e6", env({"data": ok, "messageId": "inner"}, {"messageId": "outer"})),
             ("e7", env({"data": 5})), ("e8", json.dumps({"attributes": {"messageId": "a"}}))]
    df = spark.createDataFrame(rows_, "id string, event string")
    got = {r.id: r for r in classify_envelopes(df).collect()}
    assert [got[k].alert_class for k in ["e1", "e2", "e3", "e4", "e5", "e6", "e7", "e8"]] == \
        ["bad_event", "bad_event", "no_message", "no_message", "no_data", "warning", "error",
         "no_message"]
    assert got["e6"].message_id == "outer"           # outer attributes preferred (D12)
    assert got["e5"].message_id == "inner"
    assert got["e6"].text == "Shipment S: Elevated Temp 9.5°C - No message"


def test_prices_are_shuffled_once_for_a_day_and_lines_once_for_their_region(spark):
    """Prices arrive dealt by product and day, nations and regions are broadcast."""
    from conftest import SF_SMALL
    from larder.sources.fixtures import Fixtures
    fx = Fixtures(spark, SF_SMALL)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    prices = plan(fx.market_prices)
    assert prices.count("Exchange hashpartitioning") == 5 and "l_partkey" not in [
        part.split(",")[0].split("#")[0] for part in prices.split("hashpartitioning(")[1:]]
    assert plan(market._one_price_per_day(fx.market_prices)).count("Exchange hashpartitioning") == 5


def test_orders_keep_all_items_of_good_requests_only(spark):
    """Items of one request under two customers; one bad item rejects both heads, a null id none."""
    day = dt.date(1998, 1, 2)
    rows = [("a", "1", day, 1, "p", "2"), ("a", "2", day, 2, "p", "x"), ("b", "1", day, 1, "p", "3"),
            ("b", "1", day, 2, "p", "4"), (None, "1", day, 1, "p", "5"), (None, "1", day, 2, "p", "x")]
    items = spark.createDataFrame(rows, "request_id string, customer_id string, order_date date, pos int, product_id string, quantity_text string")
    prices = spark.createDataFrame([("r", "p", "EU", dt.date(1998, 1, 1), 1.5)],
                                   "price_record_id string, product_id string, region string, market_date date, average_market_price_per_kg double")
    cust = spark.createDataFrame([("1", "here")], "customer_id string, shipping_address string")
    orders = market.purchase_orders(items, cust, prices)[0]
    assert sorted((r.request_id or "", r.total_amount) for r in orders.collect()) == [("", 7.5), ("b", 10.5)]
