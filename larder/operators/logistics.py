"""Logistics domain: shipment tracking, cold-chain readings, warehouse stock,
delivery destinations, pickup intake (H9-H13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.bands import band_message, temperature_band
from larder.functions.ids import stable_id
from larder.functions.parse import parse_float, parse_iso_timestamp
from larder.operators.common import (ANY_KEY, expand_optional, normalise_optional, pattern_keys,
                                     requested, topk)
from larder.operators.validate import missing_fields, required_message
from larder.sources.requests import value_or_default

SHIPMENT_COLS = ["shipment_id", "order_id", "origin_location_id", "destination_location_id",
                 "departure_timestamp", "arrival_timestamp_estimate", "arrival_timestamp_actual",
                 "carrier_name", "vehicle_id", "status", "total_quantity_kg",
                 "requires_cold_chain"]
READING_COLS = ["timestamp", "temperature_celsius", "location", "sensor_id"]
STOCK_COLS = ["stock_id", "product_id", "current_quantity_kg", "entry_date", "best_before_date",
              "expiry_date", "storage_conditions", "status"]
DEFAULT_STOCK_STATUS = "Available"
NEAR_EXPIRY_DAYS = 7


def _date(d) -> Column:
    return d if isinstance(d, Column) else F.lit(d).cast("date")


# --------------------------------------------------------------------- H9
def _first_shipment(shipments: DataFrame, req: DataFrame) -> DataFrame:
    """One row per requested shipment id, with a defined order for duplicates."""
    return topk(requested(shipments.select(*SHIPMENT_COLS), req, ["shipment_id"]), ["shipment_id"],
                [F.col("departure_timestamp").asc_nulls_last(), F.col("order_id").asc()], 1) \
        .drop("rank")


def shipment_tracking(req: DataFrame, shipments: DataFrame) -> DataFrame:
    """H9 header: shipment details per request, ``found`` and a status of
    'success' or 'not_found' (with the reference's message)."""
    s = _first_shipment(shipments, req).withColumnRenamed("status", "shipment_status")
    cols = [c if c != "status" else "shipment_status" for c in SHIPMENT_COLS]
    out = req.select("request_id", F.col("shipment_id").alias("req_shipment_id")).join(
        s, F.col("req_shipment_id") == F.col("shipment_id"), "left")
    found = F.col("shipment_id").isNotNull()
    return out.select(
        "request_id", F.when(found, "success").otherwise("not_found").alias("status"),
        F.when(~found, F.concat(F.lit("Shipment ID "), F.col("req_shipment_id"),
                                F.lit(" not found."))).alias("message"),
        found.alias("found"), F.coalesce("shipment_id", "req_shipment_id").alias("shipment_id"),
        *[c for c in cols if c != "shipment_id"])


def shipment_readings(req: DataFrame, shipments: DataFrame, readings: DataFrame,
                      k: int = 10) -> DataFrame:
    """H9 readings: latest ``k`` readings of each requested shipment, read
    only for shipments that require the cold chain. Readings are cut to the
    top k per shipment before the join (a hot shipment ships <= k rows per
    map task)."""
    cold = (_first_shipment(shipments, req).filter(F.col("requires_cold_chain"))
            .select("shipment_id"))
    top = topk(requested(readings.select("shipment_id", "reading_id", *READING_COLS), req, ["shipment_id"]), ["shipment_id"],
               [F.col("timestamp").desc_nulls_last(), F.col("reading_id").asc()], k)
    return (req.select("request_id", "shipment_id").join(cold, "shipment_id")
            .join(top, "shipment_id").select("request_id", *READING_COLS, "rank"))


# -------------------------------------------------------------------- H10
def coldchain_reading_log(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validate raw reading reports, type them, band them.

    Returns ``(valid, rejects)``. ``valid`` has the cold_chain_readings
    columns plus ``band`` and ``message``; ``rejects`` has ``error_code``
    and ``error_message`` (first failing check, as the reference answers).
    The row id is a hash of the report, so a retried task writes the same id.
    """
    r = reports
    for opt in ("vehicle_id", "location", "sensor_id"):
        if opt not in r.columns:
            r = r.withColumn(opt, F.lit(None).cast("string"))
    miss = missing_fields(["shipment_id", "temperature_celsius", "timestamp"],
                          {"shipment_id": F.col("shipment_id"),
                           "temperature_celsius": F.col("temperature_text"),
                           "timestamp": F.col("timestamp_text")}, r)
    temp = parse_float("temperature_text")
    ts = parse_iso_timestamp("timestamp_text")
    r = r.withColumn("_missing", miss).withColumn("_t", temp).withColumn("_ts", ts) \
        .withColumn("_sensor", value_or_default(r, "sensor_id", "Unknown"))
    err_code = (F.when(F.size("_missing") > 0, F.lit("missing_fields"))
                .when(F.col("_t").isNull(), F.lit("invalid_temperature"))
                .when(F.col("_ts").isNull(), F.lit("invalid_timestamp")))
    err_msg = (F.when(F.size("_missing") > 0, required_message("_missing"))
               .when(F.col("_t").isNull(),
                     F.lit("Invalid format for temperature_celsius. Expected number."))
               .when(F.col("_ts").isNull(),
                     F.lit("Invalid timestamp format. Expected ISO 8601 format.")))
    r = r.withColumn("error_code", err_code).withColumn("error_message", err_msg)
    valid = r.filter(F.col("error_code").isNull()).select(
        stable_id("report_id", "shipment_id", "temperature_text", "timestamp_text")
        .alias("reading_id"),
        "shipment_id", "vehicle_id", F.col("_ts").alias("timestamp"),
        F.col("_t").alias("temperature_celsius"), "location",
        F.col("_sensor").alias("sensor_id"),
        temperature_band("_t").alias("band"))
    valid = valid.withColumn("message", band_message("band"))
    rejects = r.filter(F.col("error_code").isNotNull()).select(
        "report_id", "shipment_id", "temperature_text", "timestamp_text", "error_code",
        "error_message")
    return valid, rejects


# -------------------------------------------------------------------- H11
def warehouse_stock(req: DataFrame, stock: DataFrame, as_of, k: int = 20) -> DataFrame:
    """``k`` stock rows of a location in freshness order (earliest
    expiry, then best-before, then id; nulls first), optionally one product,
    one status (default 'Available', '' matches nothing) and only rows
    expiring within 7 days of ``as_of``.

    Requests are split by which optional filters are present; per group the
    stock is cut to the top k per join key (WindowGroupLimit) and then
    equi-joined to the requests."""
    req = normalise_optional(req, ["product_id"])
    req = req.select(
        "request_id", "location_id", "product_id",
        value_or_default(req, "status", DEFAULT_STOCK_STATUS).alias("status"),
        F.coalesce(F.col("nearing_expiry").cast("boolean"), F.lit(False)).alias("near"))
    order = [F.col("expiry_date").asc_nulls_first(), F.col("best_before_date").asc_nulls_first(),
             F.col("stock_id").asc()]
    in_window = F.col("expiry_date").between(_date(as_of),
                                             F.date_add(_date(as_of), NEAR_EXPIRY_DAYS))
    # every stock row answers "all rows" requests; rows expiring soon also
    # answer nearing-expiry requests; each of those with and without product
    s = stock.select("location_id", *STOCK_COLS).withColumn(
        "near", F.explode(F.when(in_window, F.array(F.lit(False), F.lit(True)))
                          .otherwise(F.array(F.lit(False)))))
    # cut to the kinds of request a location gets: far fewer keys than products, so the filter holds at any size
    kind = ["location_id", "status", "near", "_given"]
    s = requested(expand_optional(s, ["product_id"]).withColumn("_given", F.col("_p_product_id") != ANY_KEY),
                  req.withColumn("_given", F.col("product_id").isNotNull()), kind).drop("_given")
    keys = ["location_id", "status", "near", "_p_product_id"]
    top = topk(s, keys, order, k)
    r = pattern_keys(req, ["product_id"]).select("request_id", *keys)
    return r.join(top, keys).select("request_id", *STOCK_COLS, "rank")


def near_expiry_stock(stock: DataFrame, as_of, days: int = NEAR_EXPIRY_DAYS,
                      status: str = DEFAULT_STOCK_STATUS) -> DataFrame:
    """Available stock expiring between ``as_of`` and ``as_of + days``
    (both inclusive). A pure filter: pushed into the scan."""
    return stock.filter((F.col("status") == status) &
                        F.col("expiry_date").between(_date(as_of),
                                                     F.date_add(_date(as_of), days))) \
        .select("stock_id", "product_id", "location_id", "current_quantity_kg",
                "best_before_date", "expiry_date")


# -------------------------------------------------------------------- H12
def delivery_destinations(req: DataFrame, customers: DataFrame, vehicles: DataFrame) -> DataFrame:
    """H12 (data part): the vehicle's details and the shipping address of
    each distinct listed customer, at its first list position.

    Status per request: 'error' (a required field missing or an empty
    list, one row), 'not_found' (unknown vehicle, one row), 'unavailable'
    (no listed customer exists, one row) or 'success' (one row per found
    customer), each with the reference's message. The random route
    simulation is not built.
    """
    veh = topk(vehicles.select("vehicle_id", "vehicle_type", "capacity_kg",
                               "has_temperature_monitoring", "carrier_name"),
               ["vehicle_id"], [F.col("capacity_kg").asc()], 1).drop("rank") \
        .withColumn("_hit", F.lit(True))
    dest = (req.select("request_id", F.posexplode("destination_locations")
                       .alias("pos", "destination_id"))
            .groupBy("request_id", "destination_id").agg(F.min("pos").alias("position")))
    cust = customers.select(F.col("customer_id").alias("destination_id"),
                            F.col("shipping_address").alias("destination_address"))
    found = dest.join(cust, "destination_id")
    head = req.select("request_id", "vehicle_id").join(veh, "vehicle_id", "left") \
        .withColumn("v_found", F.coalesce(F.col("_hit"), F.lit(False)))
    n_found = found.groupBy("request_id").agg(F.count("*").alias("n"))
    head = head.join(n_found, "request_id", "left")
    checks = req.select("request_id", missing_fields(
        ["destination_locations", "vehicle_id"],
        {"destination_locations": F.col("destination_locations"),
         "vehicle_id": F.col("vehicle_id")}, req).alias("_miss"),
        F.coalesce(F.size("destination_locations"), F.lit(0)).alias("_n_listed"))
    head = head.join(checks, "request_id")
    status = (F.when(F.size("_miss") > 0, "error")
              .when(F.col("_n_listed") <= 0, "error")   # F27: the list must not be empty
              .when(~F.col("v_found"), "not_found")
              .when(F.coalesce(F.col("n"), F.lit(0)) == 0, "unavailable").otherwise("success"))
    message = (F.when(F.size("_miss") > 0, required_message("_miss"))
               .when(F.col("_n_listed") <= 0,
                     F.lit("Field 'destination_locations' must be a non-empty list."))
               .when(~F.col("v_found"),
                     F.concat(F.lit("Vehicle ID "), F.col("vehicle_id"), F.lit(" not found.")))
               .when(F.coalesce(F.col("n"), F.lit(0)) == 0,
                     F.lit("Could not find valid destinations based on provided IDs.")))
    head = head.withColumn("status", status).withColumn("message", message)
    vcols = ["vehicle_type", "capacity_kg", "has_temperature_monitoring", "carrier_name"]
    ok = head.filter(F.col("status") == "success").join(found, "request_id").select(
        "request_id", "destination_id", "destination_address", "position", *vcols, "status",
        "message")
    other = head.filter(F.col("status") != "success").select(
        "request_id", F.lit(None).cast("string").alias("destination_id"),
        F.lit(None).cast("string").alias("destination_address"),
        F.lit(None).cast("int").alias("position"),
        *[F.when(F.col("v_found"), F.col(c)).alias(c) for c in vcols], "status", "message")
    return ok.unionByName(other)


# -------------------------------------------------------------------- H13
def pickup_intake(req: DataFrame) -> DataFrame:
    """Logistics acknowledges a pickup request when all four fields are
    present; otherwise an error row listing the missing fields."""
    req_fields = ["farm_id", "product_id", "quantity_kg", "requested_date"]
    miss = missing_fields(req_fields, {f: F.col(f) for f in req_fields}, req)
    return req.withColumn("_m", miss).select(
        "request_id",
        F.when(F.size("_m") > 0, "error").otherwise("acknowledged").alias("status"),
        F.when(F.size("_m") > 0,
               F.concat(F.lit("Logistics Pickup Request Error: Missing required fields: "),
                        F.array_join("_m", ", ")))
        .otherwise(F.lit("Pickup request received by Logistics.")).alias("message"))
