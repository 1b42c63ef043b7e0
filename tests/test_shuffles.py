"""What the price, order and route steps shuffle, and that they answer as before, on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from larder.operators import market
from larder.plans.explain import shuffled_rows

D = dt.date
PRICE = ("price_record_id string, product_id string, region string, market_date date, "
         "average_market_price_per_kg double")
ITEM = ("request_id string, customer_id string, order_date date, pos int, product_id string, "
        "quantity_text string")


def _prices(spark, rows):
    return spark.createDataFrame([(str(i), p, "EU", d, x) for i, (p, d, x) in enumerate(rows)], PRICE)


def test_items_are_priced_and_dealt_once(spark, tmp_path):
    n = 4000
    items = [(f"o{i // 4}", "c", D(2024, 1, 1) + dt.timedelta(days=i % 90), i % 4, f"p{i % 50}",
              "x" if i % 40 == 0 else "2") for i in range(n)]
    spark.createDataFrame(items, ITEM).write.parquet(f"{tmp_path}/i")
    prices = _prices(spark, [(f"p{i}", D(2023, 12, 1), 1.5) for i in range(50)])
    prices.write.parquet(f"{tmp_path}/p")
    cust = spark.createDataFrame([("c", "a")], "customer_id string, shipping_address string")
    _, lines, rejects = market.purchase_orders(spark.read.parquet(f"{tmp_path}/i"), cust, spark.read.parquet(f"{tmp_path}/p"))
    # by product and by order; the prices, the errors and the filter of products are small
    assert shuffled_rows(lines) < 2.2 * n
    assert lines.count() == n - 400
    assert shuffled_rows(rejects) < 1.2 * n
    assert rejects.count() == 100


def test_asof_price_of_any_day(spark):
    days = [D(2024, 1, 2) + dt.timedelta(days=3 * i) for i in range(70)]
    prices = _prices(spark, [("p", d, None if i == 5 else float(i)) for i, d in enumerate(days)] + [("one", D(2024, 1, 9), 7.0)])
    asked = [("p", D(2024, 1, 1) + dt.timedelta(days=i)) for i in range(230)] + [
        ("one", D(2024, 1, 8)), ("one", D(2024, 1, 9)), ("none", D(2024, 1, 9)), ("p", None), (None, D(2024, 2, 1))]
    items = spark.createDataFrame(asked + asked[:5], "product_id string, order_date date")
    got = {(r.product_id, r.order_date): (r.price, r.market_date_used) for r in market.price_asof(items, prices).collect()}
    assert len(got) == len(asked) == market.price_asof(items, prices).count()
    for p, day in asked[:230]:
        i = max((i for i, d in enumerate(days) if d <= day), default=None)
        assert got[p, day] == ((None, None) if i is None else (4.0 if i == 5 else float(i), days[i]))
    assert got["one", D(2024, 1, 8)] == got["none", D(2024, 1, 9)] == got[None, D(2024, 2, 1)] == (None, None)
    assert got["one", D(2024, 1, 9)] == (7.0, D(2024, 1, 9))
    every = market.price_asof(items, prices, every_item=True).collect()
    assert len(every) == len(asked) + 5
    assert all(got[r.product_id, r.order_date] == (r.price, r.market_date_used) for r in every)


def test_items_without_request_id_stay_as_they_are(spark):
    items = spark.createDataFrame([(None, "c", D(2024, 1, 1), 1, "p", "2"), (None, "c", D(2024, 1, 1), 2, "p", "x"),
                                   ("o", "c", D(2024, 1, 1), 1, "p", "2"), ("o", "c", D(2024, 1, 1), 2, "p", "x"),
                                   ("q", "c", D(2024, 1, 1), 1, "p", "3")], ITEM)
    cust = spark.createDataFrame([("c", "a")], "customer_id string, shipping_address string")
    lines = market.purchase_orders(items, cust, _prices(spark, [("p", D(2024, 1, 1), 1.0)]))[1]
    assert sorted((r.request_id or "", r.ordered_quantity_kg or 0) for r in lines.collect()) == [("", 0), ("", 2), ("q", 3)]


def test_offsets_are_counted_before_the_shuffle(spark, tmp_path):
    from larder.operators.window import row_number_bucketed, running_sum
    n = 6000
    spark.range(n).selectExpr("case when id % 100 = 99 then null else id % 3 end as k", "id % 60 div 20 as b",
                              "id * 7919 % 6000 as o", "id div 3 as seq").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    numbered = row_number_bucketed(df, ["k"], "b", ["o"], "rn")
    assert shuffled_rows(numbered) < 1.1 * n
    # the numbers that nobody reads cost nothing, and rows without a key still get none
    assert shuffled_rows(numbered.select("k").distinct()) < 10
    rows = sorted((r for r in df.collect() if r.k is not None), key=lambda r: (r.k, r.b, r.o))
    want, last = {}, {}
    for r in rows:
        last[r.k] = last.get(r.k, 0) + 1
        want[r.k, r.o] = last[r.k]
    assert {(r.k, r.o): r.rn for r in numbered.collect()} == want and numbered.count() == len(want)
    none = row_number_bucketed(df.withColumn("b", F.nullif("b", F.lit(0))), ["k"], "b", ["o"], "rn").collect()
    assert {(r.k, r.o): r.rn for r in none} == {(r.k, r.o): want[r.k, r.o] for r in rows if r.b}
    keyed = df.filter("k is not null")
    summed = running_sum(keyed, ["k"], "seq", "o", "s", chunk=400)
    assert shuffled_rows(summed) < 1.1 * n
    plain = keyed.selectExpr("k", "seq", "sum(o) over (partition by k order by seq) as s")
    assert summed.select("k", "seq", "s").exceptAll(plain).count() == 0 and summed.count() == plain.count()


def test_stock_that_no_location_asks_for_is_not_dealt(spark, tmp_path):
    from larder.operators import logistics
    n = 5000
    spark.range(n).selectExpr(
        "concat('s', id) as stock_id", "concat('p', id % 900) as product_id", "concat('l', id % 5) as location_id",
        "id as current_quantity_kg", "date'1998-01-01' as entry_date", "date'1998-01-01' as best_before_date",
        "date_add(date'1998-06-01', cast(id % 30 as int)) as expiry_date", "'F' as storage_conditions",
        "case when id % 10 = 0 then 'Available' else 'Expired' end as status").write.parquet(f"{tmp_path}/s")
    stock = spark.read.parquet(f"{tmp_path}/s")
    req = spark.createDataFrame([("own", "l0", "p10", None, False), ("any", "l0", "", "Expired", False),
                                 ("soon", "l0", None, None, True), ("none", "l0", "p1", "Expired", False)],
                                "request_id string, location_id string, product_id string, status string, nearing_expiry boolean")
    out = logistics.warehouse_stock(req.filter("request_id <> 'none'"), stock, "1998-06-15")
    assert shuffled_rows(out) < n / 5
    rows = {}
    for r in logistics.warehouse_stock(req, stock, "1998-06-15").collect():
        rows.setdefault(r.request_id, []).append(int(r.stock_id[1:]))
    assert "none" not in rows and all(i % 5 == 0 and i % 10 for i in rows["any"]) and len(rows["any"]) == 20
    assert rows["own"] and all(i % 900 == 10 and i % 10 == 0 for i in rows["own"])
    assert rows["soon"] and all(i % 10 == 0 and 14 <= i % 30 <= 21 for i in rows["soon"])


def test_stops_are_found_once_and_dealt_with_their_legs(spark, tmp_path):
    from larder.operators import routes
    n = 6000  # 20 routes of 300 legs; every second request has no located origin, every third order no coordinates
    spark.range(n).selectExpr("concat('r', id % 20) as route_id", "id div 20 + 1 as leg_seq", "concat(id % 50, 's') as duration_text",
                              "id as distance_m").write.parquet(f"{tmp_path}/legs")
    spark.range(n).selectExpr("concat('q', id % 20) as request_id", "id div 20 as pos", "concat('o', id) as order_id").write.parquet(f"{tmp_path}/dest")
    spark.range(n).selectExpr("concat('o', id) as order_id", "'c' as customer_id",
                              "if(id % 3 = 0, null, 'Lat: 1, Lon: 2') as delivery_address").write.parquet(f"{tmp_path}/orders")
    legs, dest, orders = (spark.read.parquet(f"{tmp_path}/{t}") for t in ("legs", "dest", "orders"))
    req = spark.range(20).selectExpr("concat('q', id) as request_id", "concat('r', id) as route_id", "if(id % 2 = 0, 'F', 'G') as origin_location_id",
                                     "timestamp_ntz'2024-01-01 08:00:00' as departure_time")
    farms = spark.createDataFrame([("F", "Lat: 1.5, Lon: 2.5")], "farm_id string, farm_location string")
    wh = spark.createDataFrame([], "warehouse_id string, location_address string")
    cust, items = spark.createDataFrame([("c",)], "customer_id string"), spark.createDataFrame(
        [("o4", 3), ("o4", 4)], "order_id string, ordered_quantity_kg long")
    out = routes.route_stops(req, legs, dest, orders, cust, items, farms, wh)
    # listed orders by (request, order) and by order and, where they have coordinates, by request; stops and half the
    # legs, once; orders on the way to their customers
    assert shuffled_rows(out) < 5.5 * n
    got = {(r.request_id, r.stop_number): r for r in out.collect()}
    for q in range(0, 20, 2):
        left = [i for i in range(q, n, 20) if i % 3]
        assert got[f"q{q}", 0].location_id == "F" and (f"q{q}", len(left) + 1) not in got
        at = dt.datetime(2024, 1, 1, 8)
        for k, order in enumerate(left, 1):
            leg = q + 20 * (k - 1)
            at += dt.timedelta(seconds=leg % 50)
            r = got[f"q{q}", k]
            assert (r.destination_id, r.estimated_arrival_time, r.estimated_distance_from_previous_stop_meters) == (f"o{order}", at, leg)
            assert r.total_kg_for_stop == (7 if order == 4 else 0)
    assert len(got) == out.count() == 10 + sum(1 for i in range(n) if i % 3 and i % 2 == 0)


def test_repeated_legs_and_orders_without_a_position(spark):
    from larder.operators import routes
    legs = spark.createDataFrame([("r", 1, "5s", 1), ("r", 2, "7s", 2), ("r", 2, "7s", 2), ("r", 3, "9s", 3), (None, 1, "1s", 1)],
                                 "route_id string, leg_seq int, duration_text string, distance_m long")
    dest = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("n", None, "a"), ("n", 1, "b"), (None, 1, "b")],
                                 "request_id string, pos long, order_id string")
    orders = spark.createDataFrame([(o, "c", "Lat: 1, Lon: 2") for o in "ab"], "order_id string, customer_id string, delivery_address string")
    req = spark.createDataFrame([("q", "r", "F"), ("n", "r", "F"), (None, "r", "F")], "request_id string, route_id string, origin_location_id string") \
        .selectExpr("*", "timestamp_ntz'2024-01-01 08:00:00' as departure_time")
    farms = spark.createDataFrame([("F", "Lat: 1.5, Lon: 2.5")], "farm_id string, farm_location string")
    wh = spark.createDataFrame([], "warehouse_id string, location_address string")
    cust, items = spark.createDataFrame([("c",)], "customer_id string"), spark.createDataFrame(
        [("a", 3)], "order_id string, ordered_quantity_kg long")
    got = routes.route_stops(req, legs, dest, orders, cust, items, farms, wh).collect()
    # a leg given twice ends two stops, as a join of stops and legs says; an order without a position counts, but is no stop
    assert sorted((r.request_id, r.stop_number, r.destination_id or "") for r in got) == [
        ("n", 2, "b"), ("n", 2, "b"), ("q", 0, ""), ("q", 1, "a"), ("q", 2, "b"), ("q", 2, "b")]
    assert {r.estimated_arrival_time.second for r in got if r.stop_number == 2} == {12, 19}


def test_stored_items_are_dealt_by_order_once(spark, tmp_path):
    from larder.sources import sinks
    n, setting = 4000, spark.conf.get(sinks._DROP_SHUFFLES, None)
    items = [(f"o{i // 4}" if i % 500 else None, "c" if i % 300 else "x", D(2024, 1, 1) + dt.timedelta(days=i % 9), i % 4, f"p{i % 50}",
              "x" if i % 40 == 0 else "2") for i in range(n)]
    spark.createDataFrame(items, ITEM).write.parquet(f"{tmp_path}/i")
    _prices(spark, [(f"p{i}", D(2023, 12, 1), 1.5) for i in range(50)]).write.parquet(f"{tmp_path}/p")
    args = (spark.read.parquet(f"{tmp_path}/i"), spark.createDataFrame([("c", "a")], "customer_id string, shipping_address string"),
            spark.read.parquet(f"{tmp_path}/p"))
    held = market.purchase_orders(*args, store=lambda df: sinks.stored(df, f"{tmp_path}/priced"))
    for got, want in zip(held, market.purchase_orders(*args)):
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    orders, lines, _ = held
    # an order has four lines of four days, and so four heads; a tenth of the orders is rejected
    assert shuffled_rows(lines) == 0 and shuffled_rows(orders) < 2.2 * n
    sinks.place_orders(*held, f"{tmp_path}/t", "b1")
    kept = sinks.read_committed(spark, f"{tmp_path}/t", "order_items")
    # a mark of a batch is all that is sent around, and no batch meets in one task
    assert shuffled_rows(kept) < 10 and kept.count() == lines.count()
    assert spark.conf.get(sinks._DROP_SHUFFLES, None) == setting
