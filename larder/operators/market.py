"""Market domain: availability card, forecasts, prices (H5-H7).

All operators take a requests DataFrame with ``request_id`` and answer every
request in one plan: facts are aggregated/compacted per key first, then
equi-joined to the requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import json_text
from larder.sources.requests import value_or_default
from larder.operators.common import (expand_optional, normalise_optional, pattern_keys,
                                     requested, topk)

# Fixed values taken from the reference's queries.
STOCK_AVAILABLE = "Available"
SHIPMENT_IN_TRANSIT = "In Transit"
GROWING_STATUSES = ("Planned", "Planted", "Growing", "Harvesting")


def _lit_date(d) -> Column:
    return F.lit(d).cast("date") if not isinstance(d, Column) else d


def _lit_ts(t) -> Column:
    return F.lit(t).cast("timestamp_ntz") if not isinstance(t, Column) else t


# --------------------------------------------------------------------- H7
def stock_on_hand(req: DataFrame, stock: DataFrame) -> DataFrame:
    """A1: available kg and number of distinct stock locations per request.

    Stock is summed per (product, location) first (partial aggregation
    before the shuffle). Each of those rows is expanded into its own
    location pattern and the any-location pattern and aggregated again: for
    one location the count is 1, for any location it is the exact number of
    distinct locations (COUNT(DISTINCT) without a distinct stage). Requests
    with and without a location filter meet their pattern in one equi join.
    """
    req = normalise_optional(req, ["location_id"])
    by_loc = (requested(stock.filter(F.col("status") == STOCK_AVAILABLE), req, ["product_id"])
              .filter(F.col("product_id").isNotNull())
              .groupBy("product_id", "location_id")
              .agg(F.sum("current_quantity_kg").alias("kg")))
    facts = (expand_optional(by_loc, ["location_id"])
             .groupBy("product_id", "_p_location_id")
             .agg(F.sum("kg").alias("kg"), F.count("location_id").alias("n_loc")))
    return (pattern_keys(req, ["location_id"])
            .select("request_id", "product_id", "location_id", "_p_location_id")
            .join(facts, ["product_id", "_p_location_id"], "left")
            .select("request_id", "product_id", "location_id",
                    F.coalesce(F.col("kg"), F.lit(0)).cast("bigint").alias("total_on_hand_kg"),
                    F.coalesce(F.col("n_loc"), F.lit(0)).cast("bigint")
                    .alias("num_stock_locations")))


def incoming_by_product(shipments: DataFrame, order_items: DataFrame, as_of_ts, req: DataFrame) -> DataFrame:
    """A2 facts: kg on order lines of requested products whose shipment is in
    transit and not yet due. An order with two shipments counts its items
    twice (as the reference's join does). Shipments are cut to the orders of
    the lines that are left."""
    items = requested(order_items.select("order_id", "product_id", "ordered_quantity_kg"), req, ["product_id"])
    s = (shipments.filter((F.col("status") == SHIPMENT_IN_TRANSIT) &
                          (F.col("arrival_timestamp_estimate") >= _lit_ts(as_of_ts)))
         .select("order_id"))
    return (requested(s, items, ["order_id"]).join(items, "order_id").groupBy("product_id").agg(F.sum("ordered_quantity_kg").alias("kg")))


def upcoming_by_product(schedules: DataFrame, as_of, req: DataFrame) -> DataFrame:
    """A3 facts: expected yield of requested products' schedules still to be
    harvested."""
    return (requested(schedules, req, ["product_id"]).filter((F.col("planned_harvest_date_estimate") >= _lit_date(as_of)) &
                             F.col("status").isin(*GROWING_STATUSES))
            .groupBy("product_id").agg(F.sum("expected_yield_estimate_kg").alias("kg")))


def incoming_shipments(req: DataFrame, shipments: DataFrame, order_items: DataFrame,
                       as_of_ts) -> DataFrame:
    facts = incoming_by_product(shipments, order_items, as_of_ts, req)
    return req.join(facts, "product_id", "left").select(
        "request_id", "product_id",
        F.coalesce(F.col("kg"), F.lit(0)).cast("bigint").alias("total_incoming_shipments_kg"))


def upcoming_harvest(req: DataFrame, schedules: DataFrame, as_of) -> DataFrame:
    facts = upcoming_by_product(schedules, as_of, req)
    return req.join(facts, "product_id", "left").select(
        "request_id", "product_id",
        F.coalesce(F.col("kg"), F.lit(0)).cast("bigint").alias("total_upcoming_harvest_kg"))


def product_availability(req: DataFrame, stock: DataFrame, shipments: DataFrame,
                         order_items: DataFrame, schedules: DataFrame, as_of,
                         as_of_ts) -> DataFrame:
    """H7: on-hand stock (location filter applies to stock only), incoming
    shipments and upcoming harvests side by side, zeros when nothing."""
    on_hand = stock_on_hand(req, stock)
    inc = incoming_by_product(shipments, order_items, as_of_ts, req) \
        .withColumnRenamed("kg", "inc_kg")
    upc = upcoming_by_product(schedules, as_of, req).withColumnRenamed("kg", "upc_kg")
    return (on_hand.join(inc, "product_id", "left").join(upc, "product_id", "left")
            .select("request_id", "product_id", "location_id", "total_on_hand_kg",
                    "num_stock_locations",
                    F.coalesce(F.col("inc_kg"), F.lit(0)).cast("bigint")
                     .alias("total_incoming_shipments_kg"),
                    F.coalesce(F.col("upc_kg"), F.lit(0)).cast("bigint")
                     .alias("total_upcoming_harvest_kg")))


# --------------------------------------------------------------------- H5
FORECAST_COLS = ["forecast_id", "region", "forecast_date", "target_date_start",
                 "target_date_end", "forecasted_demand_kg", "confidence_level"]


def demand_forecast(req: DataFrame, forecasts: DataFrame, k: int = 5) -> DataFrame:
    """H5: latest ``k`` forecasts whose target window equals the requested
    one exactly, optionally in one region. Forecasts are cut to the top k
    per key before meeting the requests."""
    base = ["product_id", "target_date_start", "target_date_end"]
    order = [F.col("forecast_date").desc(), F.col("forecast_id").asc()]
    f = expand_optional(requested(forecasts.select("product_id", *FORECAST_COLS), req, base), ["region"])
    keys = base + ["_p_region"]
    top = topk(f, keys, order, k)
    r = pattern_keys(req, ["region"]).select("request_id", *keys)
    return r.join(top, keys).select("request_id", *FORECAST_COLS, "rank")


# --------------------------------------------------------------------- H6
PRICE_COLS = ["price_record_id", "region", "market_date", "average_market_price_per_kg",
              "source"]


def market_price_day(req: DataFrame, prices: DataFrame, as_of) -> DataFrame:
    """H6: one price of the requested day (default ``as_of``), optionally in
    one region. The reference takes any row; we take the lowest region,
    then the lowest record id. A request without a price keeps one row with
    a message and ``status='success'``."""
    req = normalise_optional(req, ["region"])
    req = req.withColumn("market_date",
                         value_or_default(req, "date", _lit_date(as_of)).cast("date"))
    keys = ["product_id", "market_date"]
    p = requested(prices.select("product_id", *PRICE_COLS), req, keys)
    # one price per region, and those of a product's day side by side, lowest region first:
    # prices are dealt by product and day only, and not once per filter pattern
    first = topk(p, [*keys, "region"], [F.col("price_record_id").asc()], 1)
    fields = ["region", *[c for c in PRICE_COLS if c not in (*keys, "region")]]
    days = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_regions"))
    asked = req.select("request_id", *keys, F.col("region").alias("_asked"))
    found = (asked.join(days, keys)
             .withColumn("_price", F.get(F.when(F.col("_asked").isNull(), F.col("_regions")).otherwise(
                 F.filter("_regions", lambda x: x["region"] == F.col("_asked"))), F.lit(0)))
             .filter(F.col("_price").isNotNull())
             .select("request_id", "market_date", *[F.col("_price")[c].alias(c) for c in fields])
             .select("request_id", *PRICE_COLS))
    msg = F.concat(F.lit("No market price found for "), F.col("product_id"), F.lit(" on "),
                   F.date_format(F.col("req_date"), "yyyy-MM-dd"),
                   F.when(F.col("req_region").isNotNull(),
                          F.concat(F.lit(" in "), F.col("req_region"))).otherwise(F.lit("")),
                   F.lit("."))
    return (req.select("request_id", "product_id", F.col("market_date").alias("req_date"),
                       F.col("region").alias("req_region"))
            .join(found, "request_id", "left")
            .select("request_id", *PRICE_COLS, F.lit("success").alias("status"),
                    F.when(F.col("price_record_id").isNull(), msg).alias("message")))



# --------------------------------------------------------------------- R1
def _one_price_per_day(prices: DataFrame) -> DataFrame:
    """Regional prices reduced to one per (product, day): lowest region,
    then lowest record id (D5)."""
    return topk(prices.select("product_id", "market_date", "region", "price_record_id",
                              "average_market_price_per_kg"),
                ["product_id", "market_date"],
                [F.col("region").asc_nulls_first(), F.col("price_record_id").asc()], 1) \
        .select("product_id", "market_date",
                F.col("average_market_price_per_kg").alias("price"))


def price_asof(items: DataFrame, prices: DataFrame, date_col: str = "order_date",
               every_item: bool = False) -> DataFrame:
    """For each distinct (product, date) of ``items``, the latest price
    on or before that date: ``price`` and ``market_date_used`` (null when the
    product has no earlier price). With ``every_item``, every row of ``items``
    with those two columns; there a null product or date has no price.

    A product's prices, one per day, are folded into one array in the order of
    days, at most the calendar long; items meet it by product and find their
    day by halving. Items are shuffled once, and a hot product's items may be
    split over tasks, as any skewed join.
    """
    up_to_day = (Window.partitionBy("product_id").orderBy(F.col("market_date").asc_nulls_first())
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    history = (_one_price_per_day(requested(prices, items, ["product_id"]))
               .withColumn("price", F.last("price", ignorenulls=True).over(up_to_day))
               .groupBy(F.col("product_id").alias("_product"))
               .agg(F.sort_array(F.collect_list(F.struct("market_date", "price"))).alias("_days")))
    same, day = F.col("product_id") == F.col("_product"), F.col(date_col)
    if not every_item:
        items = items.select("product_id", date_col).distinct()
        same = F.col("product_id").eqNullSafe(F.col("_product"))
    found = F.get("_days", _days_up_to("_days", "market_date", day) - 1)
    if every_item:
        found = F.when(day.isNotNull(), found)
    return (items.join(history, same, "left").withColumn("_found", found)
            .select(*items.columns, F.col("_found.price").alias("price"),
                    F.col("_found.market_date").alias("market_date_used")))


def _days_up_to(days: str, field: str, day: Column) -> Column:
    """How many entries of the array ``days``, sorted by the date ``field``
    (null first), are not after ``day``: steps of falling powers of two."""
    def step(n: Column, bit: Column) -> Column:
        to = n + F.call_function("shiftleft", F.lit(1), bit)
        at = F.get(days, to - 1)[field]
        return F.when((to <= F.size(days)) & (at.isNull() | (at <= day)), to).otherwise(n)
    bits = F.sequence(F.ceil(F.log2(F.size(days))).cast("int"), F.lit(0), F.lit(-1))
    return F.aggregate(bits, F.lit(0), step)


def price_cents(price: Column) -> Column:
    """Round a per-kg price to whole cents, half up, on integers: IEEE
    multiply/add/floor give the same cents on every engine (rounding a
    DOUBLE to 2 decimals does not, D6)."""
    return F.floor(price * 100 + F.lit(0.5)).cast("bigint")


# --------------------------------------------------------------------- H8
UNKNOWN_ADDRESS = "Unknown Address"
DEFAULT_ORDER_STATUS = "Pending"


#: Fields of an order body that must be there, and of each of its items (fixed values).
ORDER_FIELDS, ITEM_FIELDS = ("customer_id", "items"), ("product_id", "quantity_kg")


def _whole_number(v: Column) -> Column:
    """``int(x)`` of a JSON value: numbers are cut to whole ones, booleans are
    1 and 0, texts are parsed (F2); anything else is null."""
    from larder.functions.parse import parse_int
    kind = F.schema_of_variant(v)
    return (F.when(kind == "STRING", parse_int(F.try_variant_get(v, "$", "string")))
            .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint"))
            .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "bigint")))


def order_rows(bodies: DataFrame) -> DataFrame:
    """Order bodies (``request_id, order_date, body``: JSON text) as the
    item rows that ``purchase_orders`` takes, one per element of ``items`` or
    one with a null ``pos``.

    Presence is kept per key: ``missing`` lists the absent required fields of
    the body, ``item_missing`` tells that an item lacks one, and
    ``<field>_given`` whether an optional field stands in the body, null or
    not. Text that isn't a JSON object lacks every field.
    """
    v = F.try_parse_json("body")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    raw = bodies.select("request_id", "order_date", F.when(is_object, v).alias("_raw"))
    get = lambda name, of="_raw": F.try_variant_get(F.col(of), f"$.{name}", "variant")
    absent = [F.when(get(n).isNull(), F.lit(n)) for n in ORDER_FIELDS]
    optional = ("delivery_date_requested", "delivery_address", "status")
    body = raw.select(
        "request_id", "order_date", _plain(get("customer_id")).alias("customer_id"),
        F.filter(F.array(*absent), lambda x: x.isNotNull()).alias("missing"),
        *[_plain(get(n)).alias(n) for n in optional], *[get(n).isNotNull().alias(f"{n}_given") for n in optional],
        F.when(F.schema_of_variant(get("items")).startswith("ARRAY"), get("items")).alias("_items"))
    spark = bodies.sparkSession
    item = body.lateralJoin(spark.tvf.variant_explode_outer(F.col("_items").outer()))
    return (item.withColumn("_product", get("product_id", "value")).withColumn("_quantity", get("quantity_kg", "value"))
            .select(*[c for c in body.columns if c != "_items"], "pos",
                    _plain(F.col("_product")).alias("product_id"), F.coalesce(json_text(F.col("_product")), F.lit("None")).alias("product_text"),
                    json_text(F.col("_quantity")).alias("quantity_text"), _whole_number(F.col("_quantity")).alias("q"),
                    (F.col("_product").isNull() | F.col("_quantity").isNull()).alias("item_missing")))


def _plain(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def orders_from_json(bodies: DataFrame, customers: DataFrame, prices: DataFrame):
    """H8 on order bodies as they come in: ``(orders, order_items, rejects)``,
    see ``order_rows`` and ``purchase_orders``."""
    return purchase_orders(order_rows(bodies), customers, prices)


def purchase_orders(items: DataFrame, customers: DataFrame, prices: DataFrame, store=None):
    """H8: validate, price and total purchase orders given in exploded form
    (``request_id, customer_id, order_date, pos, product_id, quantity_text``
    and optional ``delivery_date_requested, delivery_address, status``; an
    order without items is one row with a null ``pos``, as ``posexplode_outer``
    gives). A null stands for an absent field, but in rows of ``order_rows``,
    which tell the two apart: there a null customer or product is given, and a
    null optional field stays null.

    Returns ``(orders, order_items, rejects)``. One bad item rejects its
    whole order; the error is that of the first bad item by position (A8).
    Prices come from R1 (as-of market price, in whole cents); an item
    without any earlier price is an error ``no_price``, and a delivery date that
    is no date an error ``invalid_delivery_date``. Ids are hashes of
    the request, so re-running after a failure rewrites the same ids.

    ``store`` (a function of a frame that gives back its rows) is handed the
    priced and checked items: who writes all three results stores them, so
    they are priced once. They are dealt by order first, so the rows of an
    order are stored side by side and no result deals all of them again.
    """
    from larder.functions.ids import stable_id
    from larder.functions.parse import parse_date, parse_int

    from_json = "missing" in items.columns
    it = items
    if from_json:
        # a product's text is dealt with the items only where it isn't the product itself
        it = it.withColumn("product_text", F.nullif("product_text", "product_id")) \
            .withColumn("_bad_date", F.col("delivery_date_requested").isNotNull() &
                        parse_date("delivery_date_requested").isNull()) \
            .withColumn("delivery_date_requested", parse_date("delivery_date_requested"))
    it = price_asof(it, prices, every_item=True)
    it = it.withColumn("cents", price_cents(F.col("price"))).drop("price")
    # items without a request id belong to no order, are kept and spread over the tasks
    spread = F.when(F.col("request_id").isNull(), F.xxhash64("pos", "product_id", "quantity_text"))
    of_order = Window.partitionBy("request_id", spread)
    if store:
        it = it.repartition("request_id", spread)
    if not from_json:
        # read from the items after they are dealt, which needs no room in the shuffle
        it = it.withColumns({
            "q": parse_int("quantity_text"), "product_text": F.col("product_id"),
            "missing": F.filter(F.array(F.when(F.col("customer_id").isNull(), F.lit("customer_id"))), lambda x: x.isNotNull()),
            "item_missing": F.col("product_id").isNull() | F.col("quantity_text").isNull(), "_bad_date": F.lit(False)})
    it = it.withColumn("line_cents", F.try_multiply("q", "cents"))
    pid = F.coalesce(F.col("product_text"), F.col("product_id"), F.lit("None"))
    checks = [
        (F.size("missing") > 0, "missing_fields",
         F.concat(F.lit("Missing required fields in body: "), F.array_join("missing", ", "))),
        (F.col("pos").isNull(), "empty_items", F.lit("Field 'items' must be a non-empty list.")),
        (F.col("item_missing"), "missing_item_field",
         F.lit("Each item in 'items' must have 'product_id' and 'quantity_kg'.")),
        (F.col("q").isNull(), "invalid_quantity_format",
         F.concat(F.lit("Invalid quantity_kg format for product "), pid, F.lit(". Expected integer."))),
        (F.col("q") <= 0, "invalid_quantity",
         F.concat(F.lit("Invalid quantity for product "), pid, F.lit(". Must be positive integer."))),
        (F.col("cents").isNull(), "no_price",
         F.concat(F.lit("No market price found for product "), pid, F.lit(" on or before "),
                  F.date_format("order_date", "yyyy-MM-dd"), F.lit("."))),
        (F.col("line_cents").isNull(), "invalid_quantity",
         F.concat(F.lit("Quantity too large for product "), pid, F.lit("."))),
        (F.col("_bad_date"), "invalid_delivery_date", F.lit("Failed to place purchase order."))]
    code = msg = F
    for bad, name, text in checks:
        code, msg = code.when(bad, F.lit(name)), msg.when(bad, text)
    it = it.withColumn("error_code", code).withColumn("error_message", msg)

    if store:
        it = store(it.withColumn("_bad", F.max(F.col("error_code").isNotNull()).over(of_order))
                   .drop("missing", "item_missing", "product_text", "line_cents", "_bad_date")) \
            .withColumn("line_cents", F.try_multiply("q", "cents"))

    first_err = (it.filter(F.col("error_code").isNotNull())
                 .groupBy("request_id")
                 .agg(F.min(F.struct("pos", "product_id", "quantity_text", "error_code",
                                     "error_message")).alias("e"))
                 .select("request_id", F.col("e.error_code").alias("error_code"),
                         F.col("e.error_message").alias("error_message"),
                         F.col("e.pos").alias("pos")))
    kept = ~F.col("_bad") | F.col("request_id").isNull()
    if store:
        ok_items = it.filter(kept)
    else:
        # an order's items stand side by side, so that they are priced and shuffled once and not once more for the rejects
        ok_items = (it.select("request_id", "pos", "product_id", "quantity_text", "q", "cents", "market_date_used",
                              F.col("error_code").isNotNull().alias("_bad"))
                    .withColumn("_bad", F.max("_bad").over(of_order)).filter(kept)
                    .withColumn("line_cents", F.try_multiply("q", "cents")))
    order_id = stable_id("request_id")
    line_cents = F.col("line_cents")
    out_items = ok_items.select(
        "request_id", stable_id("request_id", "pos", "product_id", "quantity_text")
        .alias("order_item_id"), order_id.alias("order_id"), "product_id",
        F.col("q").alias("ordered_quantity_kg"),
        (F.col("cents") / F.lit(100.0)).alias("price_per_kg_at_order"),
        (line_cents / F.lit(100.0)).alias("line_item_total"), "market_date_used")

    head_cols = [c for c in ("delivery_date_requested", "delivery_address", "status")
                 if c in items.columns]
    given = [f"{c}_given" for c in head_cols if from_json]
    head = ["request_id", "customer_id", "order_date", *head_cols, *given]
    total = F.sum(line_cents.cast("decimal(19,0)")).alias("total_cents")
    if store:
        totals = ok_items.groupBy(*head).agg(total)
    else:
        # heads are summed from all items and dropped with their order: items are priced and shuffled once
        heads = it.groupBy(*head).agg(total, F.max(F.col("error_code").isNotNull()).alias("_bad"))
        totals = heads.withColumn("_bad", F.max("_bad").over(Window.partitionBy("request_id"))).filter(kept).drop("_bad")
    cust = topk(customers.select("customer_id", "shipping_address"), ["customer_id"],
                [F.col("shipping_address").asc_nulls_last()], 1) \
        .select("customer_id", "shipping_address", F.lit(True).alias("_known"))
    o = totals.join(cust, "customer_id", "left")

    def opt(c, default):
        if c not in head_cols:
            return default
        return F.when(F.col(f"{c}_given") if from_json else F.col(c).isNotNull(), F.col(c)).otherwise(default)

    addr = F.when(F.col("_known"), F.col("shipping_address")).otherwise(F.lit(UNKNOWN_ADDRESS))
    orders = o.select(
        "request_id", order_id.alias("order_id"), "customer_id", "order_date",
        opt("delivery_date_requested", F.col("order_date")).alias("delivery_date_requested"),
        opt("delivery_address", addr).alias("delivery_address"),
        opt("status", F.lit(DEFAULT_ORDER_STATUS)).alias("status"),
        (F.col("total_cents").cast("double") / F.lit(100.0)).alias("total_amount"))
    return orders, out_items, first_err
