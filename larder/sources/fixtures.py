"""Domain tables and request tables derived from the input tables.

The test environment ships TPC-H-like tables; these views map them onto the
perishables domain (farms, harvests, stock, shipments, readings, ...). They
are plain projections/joins/aggregates, so Catalyst prunes columns and
pushes filters through them into the Parquet scans.

Request tables cover *every* row of their source table (no sampling), so
the work of each query grows with the data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources.tables import DriverTables


def _str(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def line_id() -> Column:
    """Row id of a lineitem: order-line-part-supplier-shipdate (unique)."""
    return F.concat_ws("-", _str("l_orderkey"), _str("l_linenumber"), _str("l_partkey"),
                       _str("l_suppkey"), _str(F.col("l_shipdate").cast("date")))


def _ship_date() -> Column:
    return F.col("l_shipdate").cast("date")


class Fixtures:
    """Lazy domain views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = DriverTables(spark, sf_dir)

    # ---------------------------------------------------------------- farm
    @cached_property
    def farm_profiles(self) -> DataFrame:
        s, n = self.t.supplier, self.t.nation
        loc = F.when(F.col("s_suppkey") % 2 == 0,
                     F.concat(F.lit("Lat: "), _str("s_nationkey"), F.lit(".5, Lon: "),
                              _str(F.col("s_suppkey") % 90), F.lit(".75"))
                     ).otherwise(F.col("n_name"))
        return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
                .select(_str("s_suppkey").alias("farm_id"), F.col("s_name").alias("farm_name"),
                        loc.alias("farm_location"), F.col("s_name").alias("supplier_name"),
                        F.col("n_name").alias("primary_crops_grown")))

    @cached_property
    def harvest_records(self) -> DataFrame:
        nul = F.lit(None)
        return self.t.lineitem.select(
            line_id().alias("harvest_id"), _str("l_suppkey").alias("farm_id"),
            _str("l_partkey").alias("product_id"), nul.cast("string").alias("product_name"),
            nul.cast("string").alias("category"), _ship_date().alias("harvest_date"),
            F.col("l_quantity").cast("bigint").alias("harvested_quantity_kg"),
            nul.cast("bigint").alias("estimated_yield_kg"),
            (F.lit(1) - F.col("l_discount")).alias("quality_score"),
            F.col("l_returnflag").alias("quality_notes"),
            nul.cast("string").alias("photos_gcs_path"), nul.cast("date").alias("planting_date"),
            nul.cast("string").alias("field_id"))

    @cached_property
    def farm_qc_issues(self) -> DataFrame:
        nul = F.lit(None)
        flag = F.col("l_returnflag")
        return self.t.lineitem.select(
            line_id().alias("issue_id"), _str("l_suppkey").alias("farm_id"),
            F.when(F.col("l_linenumber") == 1, nul).otherwise(_str("l_partkey"))
             .cast("string").alias("product_id"),
            _ship_date().alias("issue_date"),
            F.concat(F.lit("T"), _str("l_linenumber")).alias("issue_type"),
            nul.cast("bigint").alias("affected_quantity_kg"),
            F.when(flag == "R", "High").when(flag == "A", "Medium").otherwise("Low")
             .alias("severity"),
            nul.cast("string").alias("reported_by"), F.col("l_linestatus").alias("notes"),
            nul.cast("string").alias("photos_gcs_path"))

    @cached_property
    def planting_schedules(self) -> DataFrame:
        ln = F.col("l_linenumber")
        status = (F.when(ln == 1, "Planned").when(ln == 2, "Planted").when(ln == 3, "Growing")
                  .when(ln == 4, "Harvesting").otherwise("Completed"))
        return self.t.lineitem.select(
            _str("l_suppkey").alias("farm_id"), _str("l_partkey").alias("product_id"),
            F.date_sub(_ship_date(), 90).alias("planned_planting_date"),
            _ship_date().alias("planned_harvest_date_estimate"),
            F.col("l_quantity").cast("bigint").alias("expected_yield_estimate_kg"),
            status.alias("status"))

    # -------------------------------------------------------------- market
    @cached_property
    def product_catalog(self) -> DataFrame:
        return self.t.part.select(_str("p_partkey").alias("product_id"),
                                  F.col("p_name").alias("product_name"),
                                  F.col("p_type").alias("category"),
                                  F.col("p_brand").alias("storage_requirements"))

    @cached_property
    def customers(self) -> DataFrame:
        c, n = self.t.customer, self.t.nation
        addr = (F.when(F.col("c_custkey") % 10 == 9, F.lit(None).cast("string"))
                .when(F.col("c_custkey") % 2 == 0,
                      F.concat(F.lit("Lat: "), _str("c_nationkey"), F.lit(".5, Lon: -"),
                               _str(F.col("c_custkey") % 180), F.lit(".25")))
                .otherwise(F.concat(F.col("c_name"), F.lit(", "), F.col("n_name"))))
        return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
                .select(_str("c_custkey").alias("customer_id"),
                        F.col("c_name").alias("customer_name"),
                        F.col("c_mktsegment").alias("customer_type"),
                        addr.alias("shipping_address")))

    @cached_property
    def orders(self) -> DataFrame:
        o = self.t.orders
        cust = self.customers.select("customer_id", "shipping_address")
        return (o.join(cust, _str(o.o_custkey) == cust.customer_id)
                .select(_str("o_orderkey").alias("order_id"), "customer_id",
                        F.col("o_orderdate").cast("date").alias("order_date"),
                        F.date_add(F.col("o_orderdate").cast("date"), 3)
                         .alias("delivery_date_requested"),
                        F.col("shipping_address").alias("delivery_address"),
                        F.col("o_orderstatus").alias("status"),
                        F.col("o_totalprice").alias("total_amount")))

    @cached_property
    def order_items(self) -> DataFrame:
        return self.t.lineitem.select(
            line_id().alias("order_item_id"), _str("l_orderkey").alias("order_id"),
            _str("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("bigint").alias("ordered_quantity_kg"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_per_kg_at_order"),
            F.col("l_extendedprice").alias("line_item_total"))

    def _lines_with_region(self) -> DataFrame:
        """Lines with their order's day and region. Orders find their region
        first, in few narrow rows, so lines are shuffled once, by order; nations
        and regions are fixed dimensions and broadcast."""
        t = self.t
        home = (t.customer.select("c_custkey", "c_nationkey")
                .join(F.broadcast(t.nation.select("n_nationkey", "n_regionkey")),
                      F.col("c_nationkey") == F.col("n_nationkey"))
                .join(F.broadcast(t.region.select("r_regionkey", "r_name")),
                      F.col("n_regionkey") == F.col("r_regionkey"))
                .select("c_custkey", "r_name"))
        orders = (t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
                  .join(home, F.col("o_custkey") == F.col("c_custkey"))
                  .select("o_orderkey", "o_orderdate", "r_name"))
        return (t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                                  "l_extendedprice")
                .join(orders, F.col("l_orderkey") == F.col("o_orderkey")))

    @cached_property
    def demand_forecasts(self) -> DataFrame:
        month = F.date_trunc("month", F.col("o_orderdate")).cast("date")
        g = (self._lines_with_region()
             .groupBy(F.col("l_partkey"), F.col("r_name"), month.alias("m"),
                      F.last_day(F.col("o_orderdate").cast("date")).alias("m_end"),
                      F.col("l_linenumber"))
             .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty")))
        return g.select(
            F.concat_ws("|", _str("l_partkey"), F.col("r_name"), _str("m"), _str("l_linenumber"))
             .alias("forecast_id"),
            _str("l_partkey").alias("product_id"), F.col("r_name").alias("region"),
            F.date_sub(F.col("m"), F.col("l_linenumber")).alias("forecast_date"),
            F.col("m").alias("target_date_start"), F.col("m_end").alias("target_date_end"),
            F.col("qty").cast("bigint").alias("forecasted_demand_kg"),
            F.when(F.col("l_linenumber") <= 2, "High").otherwise("Low").alias("confidence_level"))

    @cached_property
    def market_prices(self) -> DataFrame:
        # dealt by product and day, as what reads prices groups them: no second shuffle
        lines = self._lines_with_region().select(
            _str("l_partkey").alias("product_id"), F.col("r_name").alias("region"),
            F.col("o_orderdate").cast("date").alias("market_date"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("money"), F.col("l_quantity").cast("bigint").alias("qty"))
        g = (lines.repartition("product_id", "market_date").groupBy("product_id", "region", "market_date")
             .agg(F.sum("money").alias("money"), F.sum("qty").alias("qty")))
        return g.select(
            F.concat_ws("|", "product_id", "region", _str("market_date")).alias("price_record_id"),
            "product_id", "region", "market_date",
            (F.col("money").cast("double") / F.col("qty").cast("double"))
             .alias("average_market_price_per_kg"),
            F.lit("derived").alias("source"))

    # ----------------------------------------------------------- logistics
    @cached_property
    def vehicles(self) -> DataFrame:
        return self.t.supplier.select(
            F.concat(F.lit("V"), _str("s_suppkey")).alias("vehicle_id"),
            F.when(F.col("s_nationkey") % 2 == 0, "Reefer").otherwise("Van").alias("vehicle_type"),
            F.col("s_name").alias("carrier_name"),
            F.floor(F.abs(F.col("s_acctbal"))).cast("bigint").alias("capacity_kg"),
            (F.col("s_suppkey") % 2 == 0).alias("has_temperature_monitoring"),
            F.concat(F.lit("LIC-"), _str("s_suppkey")).alias("vehicle_license_no"))

    @cached_property
    def warehouses(self) -> DataFrame:
        return self.t.nation.select(_str(F.col("n_nationkey") + 5).alias("warehouse_id"),
                                    F.col("n_name").alias("location_address"))

    @cached_property
    def shipments(self) -> DataFrame:
        st = F.col("o_orderstatus")
        status = (F.when(st == "O", "In Transit").when(st == "F", "Delivered")
                  .otherwise("Planned"))
        return self.t.orders.select(
            _str("o_orderkey").alias("shipment_id"), _str("o_orderkey").alias("order_id"),
            _str(F.col("o_custkey") % 25 + 5).alias("origin_location_id"),
            _str("o_custkey").alias("destination_location_id"),
            F.col("o_orderdate").alias("departure_timestamp"),
            (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("arrival_timestamp_estimate"),
            F.lit(None).cast("timestamp_ntz").alias("arrival_timestamp_actual"),
            F.lit(None).cast("string").alias("carrier_name"),
            F.concat(F.lit("V"), _str(F.col("o_custkey") % 10)).alias("vehicle_id"),
            status.alias("status"),
            F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("total_quantity_kg"),
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("requires_cold_chain"))

    @cached_property
    def inventory_stock(self) -> DataFrame:
        rf = F.col("l_returnflag")
        status = F.when(rf == "N", "Available").when(rf == "R", "Reserved").otherwise("Expired")
        return self.t.lineitem.select(
            line_id().alias("stock_id"), _str("l_partkey").alias("product_id"),
            _str("l_suppkey").alias("location_id"),
            F.col("l_quantity").cast("bigint").alias("current_quantity_kg"),
            F.date_sub(_ship_date(), 30).alias("entry_date"),
            F.date_sub(_ship_date(), 3).alias("best_before_date"),
            _ship_date().alias("expiry_date"), F.col("l_linestatus").alias("storage_conditions"),
            status.alias("status"))

    @cached_property
    def cold_chain_readings(self) -> DataFrame:
        return self.t.events.select(
            _str("event_id").alias("reading_id"), _str("user_id").alias("shipment_id"),
            F.lit(None).cast("string").alias("vehicle_id"), F.col("ts").alias("timestamp"),
            F.col("value").alias("temperature_celsius"), F.col("props").alias("location"),
            F.col("event_type").alias("sensor_id"))

    @cached_property
    def alert_messages(self) -> DataFrame:
        """Raw broker messages: base64 JSON (or plain text) per event."""
        return alert_messages_from_events(self.t.events)

    @cached_property
    def alert_envelopes(self) -> DataFrame:
        """Raw broker events (JSON text) around the alert messages."""
        return envelopes_from_messages(alert_messages_from_events(self.t.events))

    @cached_property
    def alert_records(self) -> DataFrame:
        """Broker records around the alert messages: a third without an id
        header, some without a value, some with a header twice."""
        k = F.col("message_id").cast("bigint")
        header = lambda name, text: F.struct(F.lit(name).alias("key"), text.cast("binary").alias("value"))
        named = F.when(k % 3 == 0, F.array(header("source", F.lit("s")))).when(
            k % 3 == 1, F.array(header("messageId", F.concat(F.lit("h"), F.col("message_id"))))).otherwise(
            F.array(header("messageId", F.lit("old")), header("publishTime", F.lit("1998-01-01T00:00:00")),
                    header("messageId", F.concat(F.lit("h"), F.col("message_id")))))
        return self.alert_messages.select(
            F.lit(None).cast("binary").alias("key"), F.when(k % 7 != 0, F.col("data")).cast("binary").alias("value"),
            F.lit("alerts").alias("topic"), (k % 4).cast("int").alias("partition"), k.alias("offset"),
            F.col("publish_time").cast("timestamp").alias("timestamp"), named.alias("headers"))

    @cached_property
    def route_legs(self) -> DataFrame:
        """Legs a routing service would return: one route per supplier, its
        deliveries in ship order (``leg_seq`` 1..n), one leg per delivery.
        Numbered per (supplier, ship month) plus month offsets, so a supplier
        with a huge share of the rows is never numbered in one task; months
        keep the table of offsets far smaller than the rows."""
        from larder.operators.window import row_number_bucketed
        q = F.col("_q")
        ln4 = F.col("l_linenumber") % 4
        dur = (F.when(ln4 == 0, F.concat(_str(q * 60), F.lit("s")))
               .when(ln4 == 1, F.concat(F.lit("1h"), _str(q), F.lit("m5s")))
               .when(ln4 == 2, F.concat(_str(q), F.lit("m7s")))
               .otherwise(F.lit("2h")))
        # a time as month, day and time of the day takes less room in the shuffle, and so does the quantity that
        # texts are made of later; it settles ties last, so whatever columns are read, the same rows are dealt
        at, day = F.col("l_shipdate"), _ship_date()
        li = self.t.lineitem.select("l_suppkey", F.trunc(day, "month").alias("_month"), F.dayofmonth(day).alias("_day"),
                                    (at - day.cast("timestamp_ntz")).alias("_time"), "l_orderkey", "l_linenumber",
                                    "l_partkey", F.col("l_quantity").cast("bigint").alias("_q"))
        li = row_number_bucketed(li, ["l_suppkey"], "_month",
                                 ["_day", "_time", "l_orderkey", "l_linenumber", "l_partkey", "_q"], "leg_seq")
        return li.select(_str("l_suppkey").alias("route_id"), "leg_seq",
                         _str("l_orderkey").alias("order_id"), dur.alias("duration_text"),
                         (q * 1000).alias("distance_m"))

    # ------------------------------------------------------------ requests
    @cached_property
    def req_availability(self) -> DataFrame:
        p = F.col("p_partkey")
        reqs = self.t.part.select(
            F.concat(F.lit("A"), _str(p)).alias("request_id"), _str(p).alias("product_id"),
            F.when(p % 3 == 0, F.lit(None)).otherwise(_str(p % 10)).cast("string")
             .alias("location_id"))
        none = self.spark.range(1).select(F.lit("A-none").alias("request_id"),
                                          F.lit("NOPE").alias("product_id"),
                                          F.lit(None).cast("string").alias("location_id"))
        return reqs.unionByName(none)

    @cached_property
    def req_advice(self) -> DataFrame:
        p = F.col("p_partkey")
        m20 = p % 20
        return self.t.part.select(
            F.concat(F.lit("H"), _str(p)).alias("request_id"),
            F.when(m20.isin(0, 5), _str(p % 10)).alias("farm_id"),
            F.when(m20.isin(0, 10), _str(p)).alias("product_id"),
            F.when(p % 3 == 0, F.lit("1998-01-01").cast("date")).alias("start_date"),
            F.when(p % 2 == 0, F.lit("1998-06-30").cast("date")).alias("end_date"))

    @cached_property
    def req_pickup(self) -> DataFrame:
        return self.t.lineitem.select(
            line_id().alias("request_id"), _str("l_suppkey").alias("farm_id"),
            _str("l_partkey").alias("product_id"),
            (F.col("l_linenumber") * 10).cast("bigint").alias("quantity_kg"),
            F.date_add(_ship_date(), 3).alias("requested_date"))

    @cached_property
    def req_search(self) -> DataFrame:
        n = F.col("n_nationkey")
        m5 = n % 5
        q = (F.when(m5 == 0, F.lit("")).when(m5 == 1, F.lit("RED")).when(m5 == 2, F.lit("o_d"))
             .when(m5 == 3, F.concat(F.lit("%"), _str(n)))
             .when(n % 10 == 9, F.lit("a\\b")).otherwise(F.lit("zzz")))
        return self.t.nation.select(F.concat(F.lit("S"), _str(n)).alias("request_id"),
                                    q.alias("query"))

    @cached_property
    def req_order_items(self) -> DataFrame:
        """Exploded purchase-order requests: one order request per orderkey,
        one item per line; unknown customers and bad quantities built in."""
        li = self.t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
        ck, ln, pk = F.col("o_custkey"), F.col("l_linenumber"), F.col("l_partkey")
        qty = (F.when((ln == 7) & (pk % 3 == 0), F.lit("2.7"))
               .when((ln == 6) & (pk % 5 == 0), F.lit("0"))
               .otherwise(_str(F.col("l_quantity").cast("bigint"))))
        return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            _str("l_orderkey").alias("request_id"),
            F.when(ck % 11 == 0, F.concat(F.lit("X"), _str(ck))).otherwise(_str(ck))
             .alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("order_date"), ln.alias("pos"),
            _str(pk).alias("product_id"), qty.alias("quantity_text")))

    @cached_property
    def reading_reports(self) -> DataFrame:
        e = F.col("event_id")
        temp = (F.when(e % 17 == 0, F.lit("hot")).when(e % 19 == 0, F.lit("nan"))
                .otherwise(_str("value")))
        ts = (F.when(e % 23 == 0, F.lit("10:00")).when(e % 2 == 0, F.lit("2024-01-01T10:00:00Z"))
              .otherwise(F.lit("2024-01-01T10:00:00+05:30")))
        return self.t.events.select(_str("event_id").alias("report_id"),
                                    _str("user_id").alias("shipment_id"),
                                    temp.alias("temperature_text"), ts.alias("timestamp_text"))

    @cached_property
    def harvest_reports(self) -> DataFrame:
        ln = F.col("l_linenumber")
        return self.t.lineitem.select(
            line_id().alias("report_id"), _str("l_suppkey").alias("farm_id"),
            F.when(ln == 6, F.lit(None)).otherwise(_str("l_partkey")).cast("string")
             .alias("product_id"),
            F.when(ln == 7, F.lit("2.7")).otherwise(_str(F.col("l_quantity").cast("bigint")))
             .alias("quantity_text"),
            F.when(ln == 5, F.lit("2024-02-30")).otherwise(_str(_ship_date())).alias("date_text"))

    @cached_property
    def qc_reports(self) -> DataFrame:
        ln = F.col("l_linenumber")
        return self.t.lineitem.select(
            line_id().alias("report_id"), _str("l_suppkey").alias("farm_id"),
            F.when(ln == 3, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("T"), _str(ln))).alias("issue_type"),
            F.when(ln == 1, F.lit(None).cast("string")).otherwise(_str("l_partkey"))
             .alias("product_id"),
            F.when(ln == 2, F.lit(None).cast("string")).when(ln == 5, F.lit("2024-13-01"))
             .otherwise(_str(_ship_date())).alias("issue_date_text"),
            F.when(ln == 4, F.lit("lots")).otherwise(_str(F.col("l_quantity").cast("bigint")))
             .alias("affected_text"),
            F.when(F.col("l_linestatus") == "O", F.lit("High")).alias("severity"),
            F.col("l_returnflag").alias("notes"))

    @cached_property
    def req_license(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.t.supplier.select(
            F.concat(F.lit("L"), _str(k)).alias("request_id"),
            F.when(k % 13 == 0, F.lit("")).when(k % 17 == 0, F.lit(None).cast("string"))
             .when(k % 4 == 0, F.concat(F.lit("LIC-X"), _str(k)))
             .otherwise(F.concat(F.lit("LIC-"), _str(k))).alias("vehicle_license_no"))

    @cached_property
    def geocodes(self) -> DataFrame:
        """Address book standing in for a geocoding service: nation names."""
        return self.t.nation.select(
            F.col("n_name").alias("address"),
            (F.col("n_nationkey").cast("double") * 2.5).alias("latitude"),
            (F.col("n_regionkey").cast("double") * 10.0).alias("longitude"))

    @cached_property
    def req_routes(self) -> DataFrame:
        """Three requests per supplier: R lists all orders of its legs, U an
        unknown order, E none."""
        s, kind = F.col("s_suppkey"), F.col("kind")
        return self.t.supplier.select("s_suppkey", F.explode(F.array(
            F.lit("R"), F.lit("U"), F.lit("E"))).alias("kind")).select(
            F.concat(kind, _str(s)).alias("request_id"), _str(s).alias("route_id"),
            F.when(s % 7 == 0, F.concat(F.lit("Z"), _str(s))).otherwise(_str(s))
             .alias("origin_location_id"),
            F.when(s % 5 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("V"), _str(s))).alias("vehicle_id"),
            F.lit("1998-06-15 08:00:00").cast("timestamp_ntz").alias("departure_time"),
            F.lit("1998-06-15").cast("date").alias("route_date"))

    @cached_property
    def route_orders(self) -> DataFrame:
        """Exploded order lists of the route requests."""
        listed = self.route_legs.select(F.concat(F.lit("R"), F.col("route_id")).alias("request_id"),
                                        F.col("leg_seq").alias("pos"), "order_id")
        unknown = self.t.supplier.select(
            F.concat(F.lit("U"), _str("s_suppkey")).alias("request_id"),
            F.lit(1).cast("bigint").alias("pos"), F.lit("NOPE").alias("order_id"))
        return listed.unionByName(unknown)

    @cached_property
    def req_origins(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.t.orders.select(
            F.concat(F.lit("O"), _str(k)).alias("request_id"),
            F.when(k % 7 == 0, F.lit("999999"))
             .otherwise(_str(F.col("o_custkey") % 25 + 5)).alias("location_id"))

    @cached_property
    def req_forecast(self) -> DataFrame:
        p = F.col("p_partkey")
        start = F.make_date(F.lit(1996), (p % 12 + 1).cast("int"), F.lit(1))
        region = (F.when(p % 3 == 0, F.lit(None).cast("string")).when(p % 3 == 1, F.lit(""))
                  .otherwise(F.col("r_name")))
        r = self.t.region.select("r_regionkey", "r_name")
        return (self.t.part.select("p_partkey").join(r, p % 5 == F.col("r_regionkey"))
                .select(F.concat(F.lit("F"), _str(p)).alias("request_id"),
                        _str(p).alias("product_id"), start.alias("target_date_start"),
                        F.last_day(start).alias("target_date_end"), region.alias("region")))

    @cached_property
    def req_price(self) -> DataFrame:
        ln = F.col("l_linenumber")
        li = self.t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                    "l_shipdate")
        o = self.t.orders.select("o_orderkey", "o_orderdate")
        return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            line_id().alias("request_id"), _str("l_partkey").alias("product_id"),
            F.when(ln % 3 == 0, F.lit(None).cast("string")).when(ln % 3 == 1, F.lit("ASIA"))
             .otherwise(F.lit("")).alias("region"),
            F.when(ln == 4, F.lit(None).cast("date"))
             .otherwise(F.col("o_orderdate").cast("date")).alias("date")))

    @cached_property
    def req_tracking(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.t.orders.select(
            F.concat(F.lit("T"), _str(k)).alias("request_id"),
            F.when(k % 13 == 0, F.concat(F.lit("X"), _str(k))).otherwise(_str(k))
             .alias("shipment_id"))

    @cached_property
    def req_stock(self) -> DataFrame:
        s = F.col("s_suppkey")
        v = F.col("v")
        sup = self.t.supplier.select("s_suppkey", F.explode(F.array(
            F.lit("a"), F.lit("r"), F.lit("n"))).alias("v")).select(
            F.concat(F.lit("W"), _str(s), F.lit("-"), v).alias("request_id"),
            _str(s).alias("location_id"), F.lit(None).cast("string").alias("product_id"),
            F.when(v == "r", F.lit("Reserved")).alias("status"),
            (v == "n").alias("nearing_expiry"))
        ln = F.col("l_linenumber")
        lines = self.t.lineitem.select(
            F.concat(F.lit("W"), line_id()).alias("request_id"),
            _str("l_suppkey").alias("location_id"), _str("l_partkey").alias("product_id"),
            F.when(ln % 3 == 0, F.lit(None).cast("string")).when(ln % 3 == 1, F.lit("Available"))
             .otherwise(F.lit("")).alias("status"),
            (ln % 2 == 0).alias("nearing_expiry"))
        return sup.unionByName(lines)

    @cached_property
    def request_lines(self) -> DataFrame:
        """Stock requests as JSON text: status given, null or absent, and
        lines that are no object."""
        k = F.col("o_orderkey")
        status = (F.when(k % 3 == 0, F.lit(',"status":null')).when(k % 3 == 1, F.lit(',"status":"Reserved"'))
                  .otherwise(F.lit("")))
        line = F.concat(F.lit('{"request_id":"J'), _str(k), F.lit('","location_id":"'),
                        _str(F.col("o_custkey") % 25), F.lit('"'), status, F.lit("}"))
        return self.t.orders.select(F.when(k % 7 == 0, F.concat(F.lit("["), _str(k), F.lit("]")))
                                    .when(k % 11 == 0, F.concat(F.lit("{bad "), _str(k)))
                                    .otherwise(line).alias("value"))

    @cached_property
    def order_bodies(self) -> DataFrame:
        """Order bodies as JSON text, one per orderkey: fields given, null or
        absent, empty and broken item lists, quantities of several kinds."""
        k, ln, pk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
        product = F.when((ln == 2) & (pk % 19 == 0), F.lit("null")).otherwise(F.concat(F.lit('"'), _str(pk), F.lit('"')))
        quantity = (F.when((ln == 7) & (pk % 3 == 0), F.lit('"2.7"')).when((ln == 6) & (pk % 5 == 0), F.lit("0"))
                    .when((ln == 5) & (pk % 7 == 0), F.lit("12.9")).when((ln == 4) & (pk % 11 == 0), F.lit("true"))
                    .when((ln == 2) & (pk % 17 == 0), F.lit("null")).when((ln == 1) & (pk % 23 == 0), F.lit('" 7 "'))
                    .otherwise(_str(F.col("l_quantity").cast("bigint"))))
        item = F.concat(F.lit('{"product_id":'), product, F.when((ln == 3) & (pk % 13 == 0), F.lit("}")).otherwise(
            F.concat(F.lit(',"quantity_kg":'), quantity, F.lit("}"))))
        lists = (self.t.lineitem.select(k.alias("o_orderkey"), F.struct(ln.alias("n"), item.alias("item")).alias("i"))
                 .groupBy("o_orderkey").agg(F.array_sort(F.collect_list("i")).alias("i"))
                 .select("o_orderkey", F.concat(F.lit("["), F.array_join("i.item", ","), F.lit("]")).alias("items")))
        k, ck = F.col("o_orderkey"), F.col("o_custkey")
        customer = (F.when(k % 47 == 0, F.lit('"x":1')).when(k % 53 == 0, F.lit('"customer_id":null'))
                    .otherwise(F.concat(F.lit('"customer_id":"'), F.when(ck % 11 == 0, F.lit("X")).otherwise(F.lit("")),
                                        _str(ck), F.lit('"'))))
        items = (F.when(k % 37 == 0, F.lit(',"items":[]')).when(k % 41 == 0, F.lit(""))
                 .when(k % 43 == 0, F.lit(',"items":"none"')).otherwise(F.concat(F.lit(',"items":'), F.col("items"))))
        status = (F.when(k % 3 == 0, F.lit(',"status":null')).when(k % 3 == 1, F.lit(',"status":"Confirmed"'))
                  .otherwise(F.lit("")))
        day = (F.when(k % 5 == 0, F.lit(',"delivery_date_requested":null'))
               .when(k % 61 == 0, F.lit(',"delivery_date_requested":"soon"'))
               .when(k % 5 == 1, F.lit(',"delivery_date_requested":"1999-01-31"')).otherwise(F.lit("")))
        address = (F.when(k % 7 == 0, F.lit(',"delivery_address":null'))
                   .when(k % 7 == 1, F.lit(',"delivery_address":"Dock 5"')).otherwise(F.lit("")))
        body = F.when(k % 59 == 0, F.lit("[1]")).otherwise(
            F.concat(F.lit("{"), customer, items, status, day, address, F.lit("}")))
        return (self.t.orders.select("o_orderkey", "o_custkey", "o_orderdate").join(lists, "o_orderkey")
                .select(_str(k).alias("request_id"), F.col("o_orderdate").cast("date").alias("order_date"),
                        body.alias("body")))

    @cached_property
    def req_partial(self) -> DataFrame:
        """Requests of one to four fields; any of them may be missing."""
        k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
        day = F.col("o_orderdate").cast("date")
        return self.t.orders.select(
            F.concat(F.lit("P"), _str(k)).alias("request_id"),
            F.when(c % 3 != 0, _str(c)).alias("product_id"),
            F.when(c % 4 != 0, _str(c % 25)).alias("location_id"),
            F.when(p != "5-LOW", _str(k)).alias("shipment_id"),
            F.when(c % 5 != 0, day).alias("target_date_start"),
            F.when(p != "1-URGENT", F.date_add(day, 30)).alias("target_date_end"))

    @cached_property
    def req_destinations(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        ids = F.when(k % 9 == 0, F.array(F.lit("NOPE"), F.lit("NOPE2"))).otherwise(
            F.array(_str(c), _str(c + 1), _str(c), F.lit("NOPE")))
        return self.t.orders.select(
            F.concat(F.lit("D"), _str(k)).alias("request_id"),
            F.concat(F.lit("V"), _str(c % 120)).alias("vehicle_id"),
            ids.alias("destination_locations"))


def alert_messages_from_events(events: DataFrame) -> DataFrame:
    """Encode one broker message per event (works on batch and streaming
    DataFrames): ``signup`` -> plain text, ``view`` -> a JSON array, ``click``
    -> JSON without severity, ``error`` -> Critical, others -> Warning."""
    et, uid, val = F.col("event_type"), _str("user_id"), _str("value")
    body = (F.when(et == "signup", F.lit("ping"))
            .when(et == "view", F.lit("[1]"))
            .when(et == "click", F.concat(F.lit('{"shipment_id":"'), uid,
                                          F.lit('","temperature":'), val, F.lit("}")))
            .when(et == "error", F.concat(F.lit('{"severity":"Critical","shipment_id":"'), uid,
                                          F.lit('","temperature":'), val,
                                          F.lit(',"message":"m"}')))
            .otherwise(F.concat(F.lit('{"severity":"Warning","shipment_id":null,"temperature":'),
                                val, F.lit("}"))))
    data = F.translate(F.base64(body.cast("binary")), "\r\n", "")
    return events.select(_str("event_id").alias("message_id"), F.col("ts").alias("publish_time"),
                         data.alias("data"))


def envelopes_from_messages(m: DataFrame) -> DataFrame:
    """Wrap broker messages into raw event JSON (batch or streaming): by
    message id, not an object, attributes without a message, a message
    without data, or a full envelope (data + ids + publish time)."""
    k = F.col("message_id").cast("bigint") % 5
    pt = F.date_format("publish_time", "yyyy-MM-dd'T'HH:mm:ss")
    ev = (F.when(k == 0, F.lit('"just text"'))
          .when(k == 1, F.concat(F.lit('{"attributes":{"messageId":"'), F.col("message_id"),
                                 F.lit('"}}')))
          .when(k == 2, F.concat(F.lit('{"message":{"messageId":"'), F.col("message_id"),
                                 F.lit('"}}')))
          .otherwise(F.concat(F.lit('{"message":{"data":"'), F.col("data"),
                              F.lit('","messageId":"m'), F.col("message_id"),
                              F.lit('"},"attributes":{"messageId":"'), F.col("message_id"),
                              F.lit('","publishTime":"'), pt, F.lit('"}}'))))
    return m.select(F.col("message_id").alias("event_id"), ev.alias("event"))
