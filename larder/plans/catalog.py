"""Registered queries: one Spark plan per operator, each with a DuckDB twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs an operator over the
fixture tables of one scale-factor folder; ``ORACLE[name]`` is the same
question written directly in SQL (per-request correlated subqueries, the way
the reference asks it) for the correctness gate.

Fixed test parameters: ``as_of = 1998-06-15`` and its midnight timestamp.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.functions.ids import stable_id
from larder.operators import cards, farm, logistics, market, routes, search
from larder.operators.validate import REQUIRED, split_requests
from larder.plans.oracle_fixtures import with_views
from larder.sources.fixtures import Fixtures
from larder.sources.requests import CORRUPT, parse_requests, value_or_default
from larder.session import scratch_dir
from larder.sources.sinks import append, discard, place_orders, read_committed, stored, to_json_rows
from larder.sources.tables import lookup, store_bucketed
from larder.streaming import alerts

AS_OF = "1998-06-15"
AS_OF_TS = "1998-06-15 00:00:00"
SQL_AS_OF = "DATE '1998-06-15'"
SQL_AS_OF_TS = "TIMESTAMP '1998-06-15 00:00:00'"

_INT_OK = r"^\s*[+-]?\d+\s*$"
_DATE_OK = r"^\d{4}-\d{1,2}-\d{1,2}$"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _sql_id(*parts: str) -> str:
    """Row id over ``parts``: each as length, ':' and text; null as '-'."""
    return "sha256(" + " || ".join(
        f"CASE WHEN {p} IS NULL THEN '-' ELSE CAST(length({p}) AS VARCHAR) || ':' || {p} END"
        for p in parts) + ")"


def register(name: str, sql: str | None, *views: str):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return deco


# ------------------------------------------------------------------ market
_STOCK_SQL = """
COALESCE((SELECT SUM(s.current_quantity_kg) FROM inventory_stock s
           WHERE s.product_id = r.product_id AND s.status = 'Available'
             AND (NULLIF(r.location_id, '') IS NULL OR s.location_id = r.location_id)), 0)"""
_LOCS_SQL = """
(SELECT COUNT(DISTINCT s.location_id) FROM inventory_stock s
  WHERE s.product_id = r.product_id AND s.status = 'Available'
    AND (NULLIF(r.location_id, '') IS NULL OR s.location_id = r.location_id))"""
_INC_SQL = f"""
COALESCE((SELECT SUM(i.ordered_quantity_kg) FROM shipments t JOIN order_items i ON t.order_id = i.order_id
           WHERE i.product_id = r.product_id AND t.status = 'In Transit'
             AND t.arrival_timestamp_estimate >= {SQL_AS_OF_TS}), 0)"""
_UPC_SQL = f"""
COALESCE((SELECT SUM(p.expected_yield_estimate_kg) FROM planting_schedules p
           WHERE p.product_id = r.product_id AND p.planned_harvest_date_estimate >= {SQL_AS_OF}
             AND p.status IN ('Planned', 'Planted', 'Growing', 'Harvesting')), 0)"""


@register("product_availability", f"""
SELECT r.request_id, r.product_id, r.location_id,
       CAST({_STOCK_SQL} AS BIGINT) AS total_on_hand_kg,
       CAST({_LOCS_SQL} AS BIGINT) AS num_stock_locations,
       CAST({_INC_SQL} AS BIGINT) AS total_incoming_shipments_kg,
       CAST({_UPC_SQL} AS BIGINT) AS total_upcoming_harvest_kg
  FROM req_availability r""", "req_availability", "inventory_stock", "shipments", "order_items",
          "planting_schedules")
def q_product_availability(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return market.product_availability(fx.req_availability, fx.inventory_stock, fx.shipments,
                                       fx.order_items, fx.planting_schedules, AS_OF, AS_OF_TS)


@register("stock_on_hand", f"""
SELECT r.request_id, r.product_id, r.location_id,
       CAST({_STOCK_SQL} AS BIGINT) AS total_on_hand_kg,
       CAST({_LOCS_SQL} AS BIGINT) AS num_stock_locations
  FROM req_availability r""", "req_availability", "inventory_stock")
def q_stock_on_hand(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return market.stock_on_hand(fx.req_availability, fx.inventory_stock)


@register("incoming_shipments", f"""
SELECT r.request_id, r.product_id, CAST({_INC_SQL} AS BIGINT) AS total_incoming_shipments_kg
  FROM req_availability r""", "req_availability", "shipments", "order_items")
def q_incoming_shipments(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return market.incoming_shipments(fx.req_availability, fx.shipments, fx.order_items, AS_OF_TS)


@register("upcoming_harvest", f"""
SELECT r.request_id, r.product_id, CAST({_UPC_SQL} AS BIGINT) AS total_upcoming_harvest_kg
  FROM req_availability r""", "req_availability", "planting_schedules")
def q_upcoming_harvest(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return market.upcoming_harvest(fx.req_availability, fx.planting_schedules, AS_OF)


@register("demand_forecast_latest", """
SELECT * FROM (
  SELECT r.request_id, f.forecast_id, f.region, f.forecast_date, f.target_date_start, f.target_date_end,
         f.forecasted_demand_kg, f.confidence_level,
         row_number() OVER (PARTITION BY r.request_id ORDER BY f.forecast_date DESC, f.forecast_id) AS rank
    FROM req_forecast r JOIN demand_forecasts f
      ON f.product_id = r.product_id AND f.target_date_start = r.target_date_start
     AND f.target_date_end = r.target_date_end
     AND (NULLIF(r.region, '') IS NULL OR f.region = r.region)) x
 WHERE rank <= 5""", "req_forecast", "demand_forecasts")
def q_demand_forecast_latest(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return market.demand_forecast(fx.req_forecast, fx.demand_forecasts)


@register("market_price_day", f"""
WITH m AS (
  SELECT r.request_id, p.price_record_id, p.region, p.market_date, p.average_market_price_per_kg, p.source,
         row_number() OVER (PARTITION BY r.request_id ORDER BY p.region, p.price_record_id) AS rn
    FROM req_price r JOIN market_prices p
      ON p.product_id = r.product_id AND p.market_date = coalesce(r.date, {SQL_AS_OF})
     AND (NULLIF(r.region, '') IS NULL OR p.region = r.region))
SELECT r.request_id, m.price_record_id, m.region, m.market_date, m.average_market_price_per_kg, m.source,
       'success' AS status,
       CASE WHEN m.price_record_id IS NULL THEN
         'No market price found for ' || r.product_id || ' on ' || strftime(coalesce(r.date, {SQL_AS_OF}), '%Y-%m-%d')
         || CASE WHEN NULLIF(r.region, '') IS NOT NULL THEN ' in ' || r.region ELSE '' END || '.' END AS message
  FROM req_price r LEFT JOIN m ON m.request_id = r.request_id AND m.rn = 1""", "req_price",
          "market_prices")
def q_market_price_day(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return market.market_price_day(fx.req_price, fx.market_prices, AS_OF)


_P1 = """
p1 AS (SELECT product_id, market_date, average_market_price_per_kg AS price
         FROM (SELECT *, row_number() OVER (PARTITION BY product_id, market_date ORDER BY region, price_record_id) AS rn
                 FROM market_prices) x
        WHERE rn = 1)"""


@register("price_asof", f"""
WITH {_P1},
k AS (SELECT DISTINCT product_id, order_date FROM req_order_items)
SELECT k.product_id, k.order_date, p1.price, p1.market_date AS market_date_used
  FROM k ASOF LEFT JOIN p1 ON k.product_id = p1.product_id AND k.order_date >= p1.market_date""",
          "req_order_items", "market_prices")
def q_price_asof(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return market.price_asof(fx.req_order_items, fx.market_prices)


_ORDER_CTES = f"""
WITH {_P1},
i AS (SELECT r.*, CASE WHEN regexp_matches(quantity_text, '{_INT_OK}') THEN TRY_CAST(trim(quantity_text) AS BIGINT) END AS q
        FROM req_order_items r),
ip AS (SELECT i.*, p1.price, p1.market_date AS market_date_used
         FROM i ASOF LEFT JOIN p1 ON i.product_id = p1.product_id AND i.order_date >= p1.market_date),
ic AS (SELECT *, CAST(FLOOR(price * 100 + 0.5) AS BIGINT) AS cents FROM ip),
e AS MATERIALIZED (SELECT *,
        CASE WHEN product_id IS NULL OR quantity_text IS NULL THEN 'missing_item_field'
             WHEN q IS NULL THEN 'invalid_quantity_format' WHEN q <= 0 THEN 'invalid_quantity'
             WHEN cents IS NULL THEN 'no_price' END AS error_code,
        CASE WHEN product_id IS NULL OR quantity_text IS NULL THEN 'Each item in ''items'' must have ''product_id'' and ''quantity_kg''.'
             WHEN q IS NULL THEN 'Invalid quantity_kg format for product ' || coalesce(product_id, 'None') || '. Expected integer.'
             WHEN q <= 0 THEN 'Invalid quantity for product ' || coalesce(product_id, 'None') || '. Must be positive integer.'
             WHEN cents IS NULL THEN 'No market price found for product ' || coalesce(product_id, 'None') || ' on or before '
                  || strftime(order_date, '%Y-%m-%d') || '.' END AS error_message
        FROM ic),
bad AS MATERIALIZED (SELECT request_id, error_code, error_message, pos
          FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pos NULLS FIRST, product_id NULLS FIRST,
                       quantity_text NULLS FIRST, error_code, error_message) AS rn
                  FROM e WHERE error_code IS NOT NULL) x
         WHERE rn = 1),
ok AS (SELECT e.*, n.order_id FROM e JOIN (
         SELECT request_id, {_sql_id("request_id")} AS order_id FROM (SELECT DISTINCT request_id FROM e) ANTI JOIN bad USING (request_id)) n
         USING (request_id))"""


@register("orders_placed", _ORDER_CTES + f"""
SELECT ok.request_id, ok.order_id, ok.customer_id, ok.order_date,
       ok.order_date AS delivery_date_requested,
       CASE WHEN c.customer_id IS NOT NULL THEN c.shipping_address ELSE 'Unknown Address' END AS delivery_address,
       'Pending' AS status, CAST(SUM(ok.q * ok.cents) AS BIGINT) / 100.0 AS total_amount
  FROM ok LEFT JOIN customers c ON c.customer_id = ok.customer_id
 GROUP BY ok.request_id, ok.order_id, ok.customer_id, ok.order_date, c.customer_id, c.shipping_address""",
          "req_order_items", "market_prices", "customers")
def q_orders_placed(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return market.purchase_orders(fx.req_order_items, fx.customers, fx.market_prices)[0]


@register("order_items_placed", _ORDER_CTES + f"""
SELECT request_id, {_sql_id("request_id", "CAST(pos AS VARCHAR)", "product_id", "quantity_text")} AS order_item_id,
       order_id, product_id, q AS ordered_quantity_kg, cents / 100.0 AS price_per_kg_at_order,
       (q * cents) / 100.0 AS line_item_total, market_date_used
  FROM ok""", "req_order_items", "market_prices")
def q_order_items_placed(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return market.purchase_orders(fx.req_order_items, fx.customers, fx.market_prices)[1]


@register("order_rejects", _ORDER_CTES + """
SELECT request_id, error_code, error_message, pos FROM bad""", "req_order_items", "market_prices")
def q_order_rejects(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return market.purchase_orders(fx.req_order_items, fx.customers, fx.market_prices)[2]


_BODY_CTES = f"""
WITH {_P1},
b AS (SELECT request_id, order_date, CASE WHEN json_type(body) = 'OBJECT' THEN CAST(body AS JSON) END AS v FROM order_bodies),
i AS (SELECT request_id, unnest(l) AS item, unnest(range(len(l))) AS pos FROM (
        SELECT request_id, json_extract(v, '$.items[*]') AS l FROM b WHERE json_type(v, '$.items') = 'ARRAY')),
r AS (SELECT b.*, pos, item ->> '$.product_id' AS product_id, coalesce(item ->> '$.product_id', 'None') AS p,
             pos IS NOT NULL AND NOT (json_exists(item, '$.product_id') AND json_exists(item, '$.quantity_kg')) AS item_missing,
             CASE json_type(item, '$.quantity_kg') WHEN 'BOOLEAN' THEN CAST(CAST(item ->> '$.quantity_kg' AS BOOLEAN) AS BIGINT)
                  WHEN 'VARCHAR' THEN CASE WHEN regexp_matches(item ->> '$.quantity_kg', '{_INT_OK}')
                                           THEN TRY_CAST(trim(item ->> '$.quantity_kg') AS BIGINT) END
                  WHEN 'NULL' THEN NULL ELSE CAST(trunc(CAST(item ->> '$.quantity_kg' AS DOUBLE)) AS BIGINT) END AS q
        FROM b LEFT JOIN i USING (request_id)),
ip AS (SELECT r.*, CAST(FLOOR(p1.price * 100 + 0.5) AS BIGINT) AS cents, p1.market_date AS market_date_used
         FROM r ASOF LEFT JOIN p1 ON r.product_id = p1.product_id AND r.order_date >= p1.market_date),
e AS MATERIALIZED (SELECT *,
        CASE WHEN NOT coalesce(json_exists(v, '$.customer_id') AND json_exists(v, '$.items'), false) THEN 'missing_fields'
             WHEN pos IS NULL THEN 'empty_items' WHEN item_missing THEN 'missing_item_field'
             WHEN q IS NULL THEN 'invalid_quantity_format' WHEN q <= 0 THEN 'invalid_quantity' WHEN cents IS NULL THEN 'no_price'
             WHEN v ->> '$.delivery_date_requested' = 'soon' THEN 'invalid_delivery_date' END AS error_code,
        CASE WHEN NOT coalesce(json_exists(v, '$.customer_id') AND json_exists(v, '$.items'), false)
             THEN 'Missing required fields in body: ' || array_to_string(list_filter([
                    CASE WHEN NOT coalesce(json_exists(v, '$.customer_id'), false) THEN 'customer_id' END,
                    CASE WHEN NOT coalesce(json_exists(v, '$.items'), false) THEN 'items' END], lambda x: x IS NOT NULL), ', ')
             WHEN pos IS NULL THEN 'Field ''items'' must be a non-empty list.'
             WHEN item_missing THEN 'Each item in ''items'' must have ''product_id'' and ''quantity_kg''.'
             WHEN q IS NULL THEN 'Invalid quantity_kg format for product ' || p || '. Expected integer.'
             WHEN q <= 0 THEN 'Invalid quantity for product ' || p || '. Must be positive integer.'
             WHEN cents IS NULL THEN 'No market price found for product ' || p || ' on or before ' || strftime(order_date, '%Y-%m-%d') || '.'
             WHEN v ->> '$.delivery_date_requested' = 'soon' THEN 'Failed to place purchase order.' END AS error_message
        FROM ip),
bad AS MATERIALIZED (SELECT request_id, error_code, error_message, pos FROM e WHERE error_code IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY pos NULLS FIRST) = 1)"""


@register("orders_from_json", _BODY_CTES + f"""
SELECT request_id, {_sql_id("request_id")} AS order_id, v ->> '$.customer_id' AS customer_id, order_date,
       CASE WHEN json_exists(v, '$.delivery_date_requested') THEN CAST(v ->> '$.delivery_date_requested' AS DATE)
            ELSE order_date END AS delivery_date_requested,
       CASE WHEN json_exists(v, '$.delivery_address') THEN v ->> '$.delivery_address'
            WHEN c.customer_id IS NOT NULL THEN c.shipping_address ELSE 'Unknown Address' END AS delivery_address,
       CASE WHEN json_exists(v, '$.status') THEN v ->> '$.status' ELSE 'Pending' END AS status,
       CAST(kg AS BIGINT) / 100.0 AS total_amount
  FROM b JOIN (SELECT request_id, sum(q * cents) AS kg FROM e ANTI JOIN bad USING (request_id) GROUP BY 1) USING (request_id)
  LEFT JOIN customers c ON c.customer_id = v ->> '$.customer_id'""", "order_bodies", "market_prices", "customers")
def q_orders_from_json(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return market.orders_from_json(fx.order_bodies, fx.customers, fx.market_prices)[0]


@register("order_json_rejects", _BODY_CTES + """
SELECT request_id, error_code, error_message, CAST(pos AS INT) AS pos FROM bad""", "order_bodies", "market_prices")
def q_order_json_rejects(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return market.orders_from_json(fx.order_bodies, fx.customers, fx.market_prices)[2]


# --------------------------------------------------------------- logistics
@register("shipment_tracking", """
SELECT r.request_id, CASE WHEN s.shipment_id IS NULL THEN 'not_found' ELSE 'success' END AS status,
       CASE WHEN s.shipment_id IS NULL THEN 'Shipment ID ' || r.shipment_id || ' not found.' END AS message,
       s.shipment_id IS NOT NULL AS found, coalesce(s.shipment_id, r.shipment_id) AS shipment_id,
       s.order_id, s.origin_location_id, s.destination_location_id, s.departure_timestamp,
       s.arrival_timestamp_estimate, s.arrival_timestamp_actual, s.carrier_name, s.vehicle_id,
       s.status AS shipment_status, s.total_quantity_kg, s.requires_cold_chain
  FROM req_tracking r LEFT JOIN shipments s ON s.shipment_id = r.shipment_id""", "req_tracking",
          "shipments")
def q_shipment_tracking(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return logistics.shipment_tracking(fx.req_tracking, fx.shipments)


@register("shipment_readings_top10", """
SELECT * FROM (
  SELECT r.request_id, c."timestamp", c.temperature_celsius, c.location, c.sensor_id,
         row_number() OVER (PARTITION BY r.request_id ORDER BY c."timestamp" DESC, c.reading_id) AS rank
    FROM req_tracking r JOIN shipments s ON s.shipment_id = r.shipment_id AND s.requires_cold_chain
    JOIN cold_chain_readings c ON c.shipment_id = r.shipment_id) x
 WHERE rank <= 10""", "req_tracking", "shipments", "cold_chain_readings")
def q_shipment_readings_top10(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return logistics.shipment_readings(fx.req_tracking, fx.shipments, fx.cold_chain_readings)


_FLOAT_OK = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|nan|inf|infinity)\s*$"
_TS_OK = (r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?"
          r"(Z|[+-]\d{2}:?\d{2})?\s*$")
_READING_PARSED = f"""
SELECT report_id, shipment_id, temperature_text, timestamp_text,
       CASE WHEN regexp_matches(lower(trim(temperature_text)), '{_FLOAT_OK}')
            THEN TRY_CAST(trim(temperature_text) AS DOUBLE) END AS t,
       CASE WHEN regexp_matches(timestamp_text, '{_TS_OK}')
            THEN TRY_CAST(trim(timestamp_text) AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS ts
  FROM reading_reports"""


@register("coldchain_reading_log", f"""
WITH p AS ({_READING_PARSED})
SELECT {_sql_id("report_id", "shipment_id", "temperature_text", "timestamp_text")} AS reading_id,
       shipment_id, CAST(NULL AS VARCHAR) AS vehicle_id, ts AS "timestamp", t AS temperature_celsius,
       CAST(NULL AS VARCHAR) AS location, 'Unknown' AS sensor_id,
       CASE WHEN isnan(t) THEN 'normal' WHEN t > 15.0 THEN 'critical' WHEN t > 8.0 THEN 'elevated' ELSE 'normal' END AS band,
       CASE WHEN isnan(t) THEN 'Cold chain reading reported successfully.'
            WHEN t > 15.0 THEN 'Critical: High temperature excursion reported.'
            WHEN t > 8.0 THEN 'Cold chain reading reported successfully. Warning: Temperature is elevated.'
            ELSE 'Cold chain reading reported successfully.' END AS message
  FROM p WHERE shipment_id IS NOT NULL AND temperature_text IS NOT NULL AND timestamp_text IS NOT NULL
   AND t IS NOT NULL AND ts IS NOT NULL""", "reading_reports")
def q_coldchain_reading_log(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return logistics.coldchain_reading_log(fx.reading_reports)[0]


@register("coldchain_reading_rejects", f"""
WITH p AS ({_READING_PARSED})
SELECT report_id, shipment_id, temperature_text, timestamp_text,
       CASE WHEN t IS NULL THEN 'invalid_temperature' ELSE 'invalid_timestamp' END AS error_code,
       CASE WHEN t IS NULL THEN 'Invalid format for temperature_celsius. Expected number.'
            ELSE 'Invalid timestamp format. Expected ISO 8601 format.' END AS error_message
  FROM p WHERE t IS NULL OR ts IS NULL""", "reading_reports")
def q_coldchain_reading_rejects(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return logistics.coldchain_reading_log(fx.reading_reports)[1]


@register("warehouse_stock_fresh", f"""
SELECT * FROM (
  SELECT r.request_id, s.stock_id, s.product_id, s.current_quantity_kg, s.entry_date, s.best_before_date,
         s.expiry_date, s.storage_conditions, s.status,
         row_number() OVER (PARTITION BY r.request_id ORDER BY s.expiry_date ASC NULLS FIRST,
                            s.best_before_date ASC NULLS FIRST, s.stock_id) AS rank
    FROM req_stock r JOIN inventory_stock s
      ON s.location_id = r.location_id AND s.status = coalesce(r.status, 'Available')
     AND (NULLIF(r.product_id, '') IS NULL OR s.product_id = r.product_id)
     AND (NOT coalesce(r.nearing_expiry, false) OR s.expiry_date BETWEEN {SQL_AS_OF} AND {SQL_AS_OF} + 7)) x
 WHERE rank <= 20""", "req_stock", "inventory_stock")
def q_warehouse_stock_fresh(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return logistics.warehouse_stock(fx.req_stock, fx.inventory_stock, AS_OF)


@register("near_expiry_stock", f"""
SELECT stock_id, product_id, location_id, current_quantity_kg, best_before_date, expiry_date
  FROM inventory_stock
 WHERE status = 'Available' AND expiry_date BETWEEN {SQL_AS_OF} AND {SQL_AS_OF} + 7""", "inventory_stock")
def q_near_expiry_stock(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return logistics.near_expiry_stock(fx.inventory_stock, AS_OF)


@register("delivery_destinations", """
WITH d AS (SELECT request_id, unnest(destination_locations) AS destination_id,
                  generate_subscripts(destination_locations, 1) - 1 AS pos
             FROM req_destinations_x),
dd AS (SELECT request_id, destination_id, min(pos) AS position FROM d GROUP BY request_id, destination_id),
f AS (SELECT dd.*, c.shipping_address AS destination_address FROM dd JOIN customers c ON c.customer_id = dd.destination_id),
n AS (SELECT request_id, count(*) AS n FROM f GROUP BY request_id),
h AS (SELECT r.request_id, r.vehicle_id, v.vehicle_type, v.capacity_kg, v.has_temperature_monitoring, v.carrier_name,
             v.vehicle_id IS NOT NULL AS vf, coalesce(n.n, 0) AS n
        FROM req_destinations_x r LEFT JOIN vehicles v ON v.vehicle_id = r.vehicle_id
        LEFT JOIN n ON n.request_id = r.request_id)
SELECT h.request_id, f.destination_id, f.destination_address, CAST(f.position AS INTEGER) AS position,
       h.vehicle_type, h.capacity_kg, h.has_temperature_monitoring, h.carrier_name, 'success' AS status,
       CAST(NULL AS VARCHAR) AS message
  FROM h JOIN f ON f.request_id = h.request_id WHERE h.vf AND h.n > 0
UNION ALL
SELECT h.request_id, NULL, NULL, NULL, h.vehicle_type, h.capacity_kg, h.has_temperature_monitoring,
       h.carrier_name, CASE WHEN NOT h.vf THEN 'not_found' ELSE 'unavailable' END,
       CASE WHEN NOT h.vf THEN 'Vehicle ID ' || h.vehicle_id || ' not found.'
            ELSE 'Could not find valid destinations based on provided IDs.' END
  FROM h WHERE NOT h.vf OR h.n = 0""", "req_destinations_x", "customers", "vehicles")
def q_delivery_destinations(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return logistics.delivery_destinations(fx.req_destinations, fx.customers, fx.vehicles)


@register("pickup_intake", """
SELECT report_id AS request_id,
       CASE WHEN farm_id IS NULL OR product_id IS NULL OR quantity_text IS NULL OR date_text IS NULL
            THEN 'error' ELSE 'acknowledged' END AS status,
       CASE WHEN farm_id IS NULL OR product_id IS NULL OR quantity_text IS NULL OR date_text IS NULL
            THEN 'Logistics Pickup Request Error: Missing required fields: ' ||
                 concat_ws(', ', CASE WHEN farm_id IS NULL THEN 'farm_id' END,
                           CASE WHEN product_id IS NULL THEN 'product_id' END,
                           CASE WHEN quantity_text IS NULL THEN 'quantity_kg' END,
                           CASE WHEN date_text IS NULL THEN 'requested_date' END)
            ELSE 'Pickup request received by Logistics.' END AS message
  FROM harvest_reports""", "harvest_reports")
def q_pickup_intake(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    r = fx.harvest_reports.select(F.col("report_id").alias("request_id"), "farm_id", "product_id",
                                  F.col("quantity_text").alias("quantity_kg"),
                                  F.col("date_text").alias("requested_date"))
    return logistics.pickup_intake(r)


# -------------------------------------------------------------------- farm
_HARVEST_PARSED = f"""
SELECT *, CASE WHEN regexp_matches(date_text, '{_DATE_OK}') THEN CAST(TRY_STRPTIME(date_text, '%Y-%m-%d') AS DATE) END AS d,
          CASE WHEN regexp_matches(quantity_text, '{_INT_OK}') THEN TRY_CAST(trim(quantity_text) AS BIGINT) END AS q,
          farm_id IS NULL OR product_id IS NULL OR quantity_text IS NULL OR date_text IS NULL AS miss,
          concat_ws(', ', CASE WHEN farm_id IS NULL THEN 'farm_id' END, CASE WHEN product_id IS NULL THEN 'product_id' END,
                    CASE WHEN quantity_text IS NULL THEN 'harvested_quantity_kg' END,
                    CASE WHEN date_text IS NULL THEN 'harvest_date' END) AS missing
  FROM harvest_reports"""


@register("harvest_log_valid", f"""
WITH p AS ({_HARVEST_PARSED})
SELECT {_sql_id("report_id", "farm_id", "product_id", "quantity_text", "date_text")} AS harvest_id,
       farm_id, product_id, CAST(NULL AS VARCHAR) AS product_name, CAST(NULL AS VARCHAR) AS category,
       d AS harvest_date, q AS harvested_quantity_kg, CAST(NULL AS BIGINT) AS estimated_yield_kg,
       CAST(NULL AS DOUBLE) AS quality_score, '' AS quality_notes, CAST(NULL AS VARCHAR) AS photos_gcs_path,
       CAST(NULL AS DATE) AS planting_date, CAST(NULL AS VARCHAR) AS field_id
  FROM p WHERE NOT miss AND d IS NOT NULL AND q IS NOT NULL""", "harvest_reports")
def q_harvest_log_valid(spark, sf_dir):
    return farm.harvest_log(Fixtures(spark, sf_dir).harvest_reports)[0]


@register("harvest_log_rejects", f"""
WITH p AS ({_HARVEST_PARSED})
SELECT report_id,
       CASE WHEN miss THEN 'missing_fields' WHEN d IS NULL THEN 'invalid_harvest_date'
            ELSE 'invalid_harvested_quantity_kg' END AS error_code,
       CASE WHEN miss THEN 'Missing required fields in body: ' || missing
            WHEN d IS NULL THEN 'Invalid harvest_date format. Expected YYYY-MM-DD.'
            ELSE 'Invalid format for harvested_quantity_kg. Expected integer.' END AS error_message,
       missing
  FROM p WHERE miss OR d IS NULL OR q IS NULL""", "harvest_reports")
def q_harvest_log_rejects(spark, sf_dir):
    return farm.harvest_log(Fixtures(spark, sf_dir).harvest_reports)[1]


@register("qc_issue_log", f"""
WITH p AS (
  SELECT *, CASE WHEN issue_date_text IS NULL THEN {SQL_AS_OF}
                 WHEN regexp_matches(issue_date_text, '{_DATE_OK}') THEN CAST(TRY_STRPTIME(issue_date_text, '%Y-%m-%d') AS DATE) END AS d,
            CASE WHEN regexp_matches(affected_text, '{_INT_OK}') THEN TRY_CAST(trim(affected_text) AS BIGINT) END AS a
    FROM qc_reports)
SELECT {_sql_id("report_id", "farm_id", "issue_type", "issue_date_text")} AS issue_id,
       farm_id, product_id, d AS issue_date, issue_type, a AS affected_quantity_kg,
       coalesce(severity, 'Medium') AS severity, 'AI Agent' AS reported_by, coalesce(notes, '') AS notes,
       CAST(NULL AS VARCHAR) AS photos_gcs_path
  FROM p WHERE farm_id IS NOT NULL AND issue_type IS NOT NULL AND d IS NOT NULL
   AND (affected_text IS NULL OR a IS NOT NULL)""", "qc_reports")
def q_qc_issue_log(spark, sf_dir):
    return farm.qc_issue_log(Fixtures(spark, sf_dir).qc_reports, AS_OF)[0]


@register("qc_issue_rejects", f"""
WITH p AS (
  SELECT *, CASE WHEN issue_date_text IS NULL THEN {SQL_AS_OF}
                 WHEN regexp_matches(issue_date_text, '{_DATE_OK}') THEN CAST(TRY_STRPTIME(issue_date_text, '%Y-%m-%d') AS DATE) END AS d,
            CASE WHEN regexp_matches(affected_text, '{_INT_OK}') THEN TRY_CAST(trim(affected_text) AS BIGINT) END AS a,
            farm_id IS NULL OR issue_type IS NULL AS miss,
            concat_ws(', ', CASE WHEN farm_id IS NULL THEN 'farm_id' END,
                      CASE WHEN issue_type IS NULL THEN 'issue_type' END) AS missing
    FROM qc_reports)
SELECT report_id,
       CASE WHEN miss THEN 'missing_fields' WHEN d IS NULL THEN 'invalid_issue_date'
            ELSE 'invalid_affected_quantity_kg' END AS error_code,
       CASE WHEN miss THEN 'Missing required fields in body: ' || missing
            WHEN d IS NULL THEN 'Invalid issue_date format. Expected YYYY-MM-DD.'
            ELSE 'Invalid format for affected_quantity_kg. Expected integer.' END AS error_message,
       missing
  FROM p WHERE miss OR d IS NULL OR (affected_text IS NOT NULL AND a IS NULL)""", "qc_reports")
def q_qc_issue_rejects(spark, sf_dir):
    return farm.qc_issue_log(Fixtures(spark, sf_dir).qc_reports, AS_OF)[1]


_ADVICE_REQ = f"""
r AS (SELECT request_id, NULLIF(farm_id, '') AS farm_id, NULLIF(product_id, '') AS product_id,
             CASE WHEN start_date IS NULL AND end_date IS NULL THEN {SQL_AS_OF} - 90 ELSE start_date END AS lo,
             end_date AS hi
        FROM req_advice)"""


def _advice_topk_sql(facts: str, date_col: str, id_col: str, cols: str, general: bool) -> str:
    """Latest 5 facts per advice request: the keyed groups equi-join on their
    keys, the no-key group ranks once per distinct date window.
    ``general``: facts with a null product match any product filter."""
    win = f"(r.lo IS NULL OR f.{date_col} >= r.lo) AND (r.hi IS NULL OR f.{date_col} <= r.hi)"
    both = "r.farm_id IS NOT NULL AND r.product_id IS NOT NULL"
    farm_only = "r.farm_id IS NOT NULL AND r.product_id IS NULL"
    prod_only = "r.farm_id IS NULL AND r.product_id IS NOT NULL"
    sel = f"SELECT r.request_id, f.* FROM r JOIN {facts} f"
    keyed = [f"{sel} ON f.farm_id = r.farm_id AND f.product_id = r.product_id WHERE {both} AND {win}",
             f"{sel} ON f.farm_id = r.farm_id WHERE {farm_only} AND {win}",
             f"{sel} ON f.product_id = r.product_id WHERE {prod_only} AND {win}"]
    if general:
        keyed += [f"{sel} ON f.farm_id = r.farm_id WHERE {both} AND f.product_id IS NULL AND {win}",
                  f"{sel} ON f.product_id IS NULL WHERE {prod_only} AND {win}"]
    union = "\n  UNION ALL ".join(keyed)
    return f"""
keyed AS ({union}),
keyed_top AS (SELECT request_id, {cols}, row_number() OVER (PARTITION BY request_id
                     ORDER BY {date_col} DESC, {id_col}) AS rank FROM keyed),
t AS (SELECT DISTINCT lo, hi FROM r WHERE farm_id IS NULL AND product_id IS NULL),
t_top AS (SELECT * FROM (SELECT r.lo, r.hi, f.*, row_number() OVER (PARTITION BY r.lo, r.hi
                     ORDER BY f.{date_col} DESC, f.{id_col}) AS rank
                     FROM t r JOIN {facts} f ON {win}) x WHERE rank <= 5)
SELECT request_id, {cols}, rank FROM keyed_top WHERE rank <= 5
UNION ALL
SELECT r.request_id, {", ".join("x." + c.strip() for c in cols.split(","))}, x.rank
  FROM r JOIN t_top x ON x.lo IS NOT DISTINCT FROM r.lo AND x.hi IS NOT DISTINCT FROM r.hi
 WHERE r.farm_id IS NULL AND r.product_id IS NULL"""


@register("advice_harvests", f"""
WITH {_ADVICE_REQ},
{_advice_topk_sql("harvest_records", "harvest_date", "harvest_id",
                  "harvest_date, harvested_quantity_kg, quality_score, quality_notes", False)}""",
          "req_advice", "harvest_records")
def q_advice_harvests(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return farm.advice_harvests(fx.req_advice, fx.harvest_records, AS_OF)


@register("advice_qc_issues", f"""
WITH {_ADVICE_REQ},
{_advice_topk_sql("farm_qc_issues", "issue_date", "issue_id",
                  "issue_date, issue_type, severity, notes", True)}""",
          "req_advice", "farm_qc_issues")
def q_advice_qc_issues(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return farm.advice_qc_issues(fx.req_advice, fx.farm_qc_issues, AS_OF)


_SCHED_COLS = ("planned_planting_date, planned_harvest_date_estimate, expected_yield_estimate_kg, "
               "status")


@register("advice_schedules", f"""
WITH r AS (SELECT request_id, NULLIF(farm_id, '') AS farm_id, NULLIF(product_id, '') AS product_id FROM req_advice),
s AS (SELECT * FROM planting_schedules WHERE planned_harvest_date_estimate >= {SQL_AS_OF}),
keyed AS (
  SELECT r.request_id, s.* FROM r JOIN s ON s.farm_id = r.farm_id AND s.product_id = r.product_id
   WHERE r.farm_id IS NOT NULL AND r.product_id IS NOT NULL
  UNION ALL
  SELECT r.request_id, s.* FROM r JOIN s ON s.farm_id = r.farm_id WHERE r.farm_id IS NOT NULL AND r.product_id IS NULL
  UNION ALL
  SELECT r.request_id, s.* FROM r JOIN s ON s.product_id = r.product_id WHERE r.farm_id IS NULL AND r.product_id IS NOT NULL),
ranked AS (SELECT request_id, {_SCHED_COLS}, row_number() OVER (PARTITION BY request_id ORDER BY {_SCHED_COLS}) AS rank
             FROM keyed),
g AS (SELECT {_SCHED_COLS}, row_number() OVER (ORDER BY {_SCHED_COLS}) AS rank FROM s)
SELECT * FROM ranked WHERE rank <= 5
UNION ALL
SELECT r.request_id, g.* FROM r, g WHERE r.farm_id IS NULL AND r.product_id IS NULL AND g.rank <= 5""",
          "req_advice", "planting_schedules")
def q_advice_schedules(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return farm.advice_schedules(fx.req_advice, fx.planting_schedules, AS_OF)


@register("advice_farm_profile", """
SELECT r.request_id, f.farm_name, f.farm_location, f.primary_crops_grown
  FROM req_advice r JOIN farm_profiles f ON f.farm_id = NULLIF(r.farm_id, '')""", "req_advice",
          "farm_profiles")
def q_advice_farm_profile(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return farm.advice_farm_profile(fx.req_advice, fx.farm_profiles)


@register("pickup_feasibility", """
WITH a AS (
  SELECT r.request_id, r.quantity_kg AS q,
         CAST(COALESCE((SELECT SUM(h.harvested_quantity_kg) FROM harvest_records h
                         WHERE h.farm_id = r.farm_id AND h.product_id = r.product_id
                           AND h.harvest_date >= r.requested_date - 7), 0) AS BIGINT) AS av
    FROM req_pickup r)
SELECT request_id, CASE WHEN av >= q THEN 'success' ELSE 'unavailable' END AS status, av AS available_kg,
       CASE WHEN av >= q THEN q END AS confirmed_quantity_kg,
       CASE WHEN av >= q THEN 'Pickup request received and appears feasible. Logistics is being notified and will confirm exact details.'
            ELSE 'Unable to schedule pickup for ' || CAST(q AS VARCHAR) || ' kg. Only found approximately ' || CAST(av AS VARCHAR)
                 || ' kg recently harvested or on hand for this product at this farm. Please adjust quantity or date.' END AS message
  FROM a""", "req_pickup", "harvest_records")
def q_pickup_feasibility(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return farm.pickup_feasibility(fx.req_pickup, fx.harvest_records)


# ------------------------------------------------------------------ search
def _search_sql(table: str, id_col: str, cols: str, cond: str, limit: int | None) -> str:
    """Search twin: every text matching the request's pattern (or every text
    when the query is empty), numbered by id; at most 100 per request when
    ``limit``, else all matches and the first 100 when browsing. Queries
    with a backslash are rejected (as in the Spark operator)."""
    names = ", ".join(c.split(".")[-1] for c in cols.split(", "))
    keep = "rank <= 100" if limit else "(NOT browse OR rank <= 100)"
    rank_out = ", rank" if limit else ""
    return f"""
SELECT request_id, {names}{rank_out} FROM (
  SELECT r.request_id, {cols},
         row_number() OVER (PARTITION BY r.request_id ORDER BY t.{id_col}) AS rank,
         NULLIF(r.query, '') IS NULL AS browse
    FROM req_search r JOIN {table} t ON NULLIF(r.query, '') IS NULL OR {cond}
   WHERE coalesce(position('\\' IN r.query), 0) = 0) x
 WHERE {keep}"""


_LIKE = "lower({c}) LIKE lower('%' || r.query || '%')"


@register("farm_search", _search_sql(
    "farm_profiles", "farm_id", "t.farm_id, t.farm_name, t.farm_location, t.supplier_name",
    f"{_LIKE.format(c='t.farm_name')} OR {_LIKE.format(c='t.farm_location')}", 100),
    "req_search", "farm_profiles")
def q_farm_search(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return search.farm_search(fx.req_search, fx.farm_profiles)


@register("product_search", _search_sql(
    "product_catalog", "product_id", "t.product_id, t.product_name, t.category, t.storage_requirements",
    _LIKE.format(c="t.product_name"), None), "req_search", "product_catalog")
def q_product_search(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return search.product_search(fx.req_search, fx.product_catalog)


@register("customer_search", _search_sql(
    "customers", "customer_id", "t.customer_id, t.customer_name, t.customer_type, t.shipping_address",
    _LIKE.format(c="t.customer_name"), 100), "req_search", "customers")
def q_customer_search(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return search.customer_search(fx.req_search, fx.customers)


@register("search_rejects", """
SELECT request_id, query, 'invalid_query' AS error_code,
       'A search query must not contain a backslash.' AS error_message
  FROM req_search WHERE position('\\' IN query) > 0""", "req_search")
def q_search_rejects(spark, sf_dir):
    return search.search_rejects(Fixtures(spark, sf_dir).req_search)


@register("browse_first_100", """
SELECT * FROM (
  SELECT product_id, product_name, category, storage_requirements,
         row_number() OVER (ORDER BY product_id) AS rank
    FROM product_catalog) x
 WHERE rank <= 100""", "product_catalog")
def q_browse_first_100(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return search.browse_first(fx.product_catalog, "product_id",
                               ["product_id", "product_name", "category", "storage_requirements"])


@register("vehicle_by_license", """
SELECT r.request_id, v.vehicle_id, v.carrier_name, v.vehicle_type, v.capacity_kg,
       v.has_temperature_monitoring, r.vehicle_license_no, v.vehicle_id IS NOT NULL AS found,
       CASE WHEN NULLIF(r.vehicle_license_no, '') IS NULL THEN 'error'
            WHEN v.vehicle_id IS NULL THEN 'not_found' ELSE 'success' END AS status,
       CASE WHEN NULLIF(r.vehicle_license_no, '') IS NULL THEN 'Missing or empty vehicle_license_no in request body' END AS message
  FROM req_license r LEFT JOIN vehicles v ON v.vehicle_license_no = r.vehicle_license_no""",
          "req_license", "vehicles")
def q_vehicle_by_license(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return search.vehicle_by_license(fx.req_license, fx.vehicles)


@register("vehicle_details", """
SELECT r.request_id, r.vehicle_id, v.vehicle_type, v.capacity_kg, v.has_temperature_monitoring,
       v.carrier_name, v.vehicle_id IS NOT NULL AS found
  FROM req_routes r LEFT JOIN vehicles v ON v.vehicle_id = r.vehicle_id""", "req_routes", "vehicles")
def q_vehicle_details(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return search.vehicle_details(fx.req_routes, fx.vehicles)


# ------------------------------------------------------------------ routes
_FLOAT_SQL = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|nan|inf|infinity)\s*$"
_COORD_SQL = r"Lat:\s*([^,]*?)\s*,\s*Lon:\s*(.*?)\s*$"
_DUR_SQL = r"^\s*(?:(\d+)\s*h)?\s*(?:(\d+)\s*m)?\s*(?:(\d+)\s*)?s\s*$"


def _sql_float(e: str) -> str:
    return (f"CASE WHEN regexp_matches(lower(trim({e})), '{_FLOAT_SQL}') "
            f"THEN TRY_CAST(trim({e}) AS DOUBLE) END")


def _sql_geo(src: str, text: str) -> str:
    """Coordinates of ``text`` in relation ``src``: embedded, else geocodes."""
    lat = _sql_float(f"regexp_extract({text}, '{_COORD_SQL}', 1)")
    lon = _sql_float(f"regexp_extract({text}, '{_COORD_SQL}', 2)")
    return f"""
SELECT s.*, CASE WHEN p.plat IS NOT NULL THEN p.plat ELSE g.latitude END AS latitude,
       CASE WHEN p.plat IS NOT NULL THEN p.plon ELSE g.longitude END AS longitude,
       CASE WHEN p.plat IS NOT NULL THEN 'parsed' WHEN g.latitude IS NOT NULL THEN 'geocoded' END AS source
  FROM {src} s
  LEFT JOIN LATERAL (SELECT CASE WHEN contains(s.{text}, 'Lat:') AND contains(s.{text}, 'Lon:')
                                  AND ({lat.replace(text, 's.' + text)}) IS NOT NULL
                                  AND ({lon.replace(text, 's.' + text)}) IS NOT NULL
                             THEN {lat.replace(text, 's.' + text)} END AS plat,
                            {lon.replace(text, 's.' + text)} AS plon) p ON TRUE
  LEFT JOIN geocodes g ON g.address = s.{text}"""


_DUR_SECS = (f"CASE WHEN duration_text IS NULL OR NOT contains(duration_text, 's') THEN 0 "
             f"WHEN regexp_matches(duration_text, '{_DUR_SQL}') THEN "
             f"coalesce(TRY_CAST(regexp_extract(duration_text, '{_DUR_SQL}', 1) AS BIGINT), 0) * 3600 + "
             f"coalesce(TRY_CAST(regexp_extract(duration_text, '{_DUR_SQL}', 2) AS BIGINT), 0) * 60 + "
             f"coalesce(TRY_CAST(regexp_extract(duration_text, '{_DUR_SQL}', 3) AS BIGINT), 0) END")

_LOC = """
loc AS (SELECT location_id, location_text
          FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY prio, location_text) AS rn
                  FROM (SELECT farm_id AS location_id, farm_location AS location_text, 0 AS prio FROM farm_profiles
                        UNION ALL
                        SELECT warehouse_id, location_address, 1 FROM warehouses) u) x
         WHERE rn = 1)"""


@register("origin_coordinates", f"""
WITH {_LOC},
o AS (SELECT r.request_id, r.location_id, loc.location_text FROM req_origins r LEFT JOIN loc USING (location_id)),
g AS ({_sql_geo("o", "location_text")})
SELECT request_id, location_id, location_text, latitude, longitude, source,
       CASE WHEN latitude IS NOT NULL THEN 'success' ELSE 'not_found' END AS status
  FROM g""", "req_origins", "farm_profiles", "warehouses", "geocodes")
def q_origin_coordinates(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return routes.origin_coordinates(fx.req_origins, fx.farm_profiles, fx.warehouses, fx.geocodes)


@register("order_total_kg", """
SELECT order_id, CAST(SUM(ordered_quantity_kg) AS BIGINT) AS total_kg FROM order_items GROUP BY order_id""",
          "order_items")
def q_order_total_kg(spark, sf_dir):
    return routes.order_total_kg(Fixtures(spark, sf_dir).order_items)


@register("order_destinations", f"""
WITH d AS (SELECT route_id AS request_id, order_id, min(leg_seq) AS position FROM legs GROUP BY route_id, order_id),
a AS (SELECT DISTINCT order_id, delivery_address FROM orders_v WHERE customer_id IN (SELECT customer_id FROM customers)),
ag AS ({_sql_geo("a", "delivery_address")}),
kg AS (SELECT order_id, CAST(SUM(ordered_quantity_kg) AS BIGINT) AS total_kg FROM order_items GROUP BY order_id)
SELECT d.request_id, d.order_id, ag.delivery_address AS address, ag.latitude, ag.longitude,
       coalesce(kg.total_kg, 0) AS total_kg, d.position
  FROM d JOIN ag ON ag.order_id = d.order_id LEFT JOIN kg ON kg.order_id = d.order_id
 WHERE ag.latitude IS NOT NULL""", "legs", "orders_v", "customers", "order_items", "geocodes")
def q_order_destinations(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    dest = fx.route_legs.select(F.col("route_id").alias("request_id"),
                                F.col("leg_seq").alias("pos"), "order_id")
    return routes.order_destinations(dest, fx.orders, fx.customers, fx.order_items, fx.geocodes)


@register("duration_seconds", f"""
SELECT route_id, leg_seq, duration_text, {_DUR_SECS} AS duration_seconds FROM legs""", "legs")
def q_duration_seconds(spark, sf_dir):
    return routes.leg_durations(Fixtures(spark, sf_dir).route_legs)


_ROUTE_STATUS = f"""
{_LOC},
o AS (SELECT r.request_id, r.origin_location_id AS location_id, loc.location_text
        FROM req_routes r LEFT JOIN loc ON loc.location_id = r.origin_location_id),
og AS ({_sql_geo("o", "location_text")}),
oa AS (SELECT DISTINCT order_id, delivery_address FROM orders_v WHERE customer_id IN (SELECT customer_id FROM customers)),
oag AS ({_sql_geo("oa", "delivery_address")}),
kg AS (SELECT order_id, CAST(SUM(ordered_quantity_kg) AS BIGINT) AS total_kg FROM order_items GROUP BY order_id),
li AS (SELECT request_id, order_id, min(pos) AS position FROM route_orders GROUP BY request_id, order_id),
de AS (SELECT li.request_id, li.order_id, oag.delivery_address, coalesce(kg.total_kg, 0) AS total_kg,
              row_number() OVER (PARTITION BY li.request_id ORDER BY li.position) AS i
         FROM li JOIN oag ON oag.order_id = li.order_id LEFT JOIN kg ON kg.order_id = li.order_id
        WHERE oag.latitude IS NOT NULL),
nl AS (SELECT request_id, count(*) AS n FROM route_orders GROUP BY request_id),
nd AS (SELECT request_id, count(*) AS n FROM de GROUP BY request_id),
pr AS (SELECT route_id, count(*) AS n_legs, SUM({_DUR_SECS}) AS total_sec, SUM(distance_m) AS total_m
         FROM legs GROUP BY route_id),
st AS (SELECT r.*, pr.n_legs, pr.total_sec, pr.total_m,
              CASE WHEN coalesce(r.origin_location_id, '') = '' OR nl.n IS NULL THEN 'error'
                   WHEN og.latitude IS NULL THEN 'not_found'
                   WHEN nd.n IS NULL OR pr.n_legs IS NULL THEN 'unavailable'
                   ELSE 'success' END AS status,
              CASE WHEN coalesce(r.origin_location_id, '') = '' OR nl.n IS NULL THEN 'Missing required input parameters'
                   WHEN og.latitude IS NULL THEN 'Origin location ID ' || r.origin_location_id || ' not found or coordinates unavailable.'
                   WHEN nd.n IS NULL THEN 'Could not find valid destinations or coordinates for provided order IDs.'
                   WHEN pr.n_legs IS NULL THEN 'Could not compute a route with the provided locations.' END AS message
         FROM req_routes r JOIN og ON og.request_id = r.request_id LEFT JOIN pr ON pr.route_id = r.route_id
         LEFT JOIN nl ON nl.request_id = r.request_id LEFT JOIN nd ON nd.request_id = r.request_id)"""

_ROUTE_VIEWS = ("req_routes", "legs", "route_orders", "farm_profiles", "warehouses", "geocodes",
                "order_items", "orders_v")


def _route_tables(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return (fx.req_routes, fx.route_legs, fx.route_orders, fx.orders, fx.customers,
            fx.order_items, fx.farm_profiles, fx.warehouses, fx.geocodes)


@register("route_headers", f"""
WITH {_ROUTE_STATUS}
SELECT request_id, route_id, status, message, vehicle_id,
       CASE WHEN status = 'success' THEN n_legs + 1 END AS num_stops_on_route,
       CASE WHEN status = 'success' THEN CAST(total_sec AS VARCHAR) || 's' END AS estimated_total_duration,
       CASE WHEN status = 'success' THEN CAST(total_m AS BIGINT) END AS estimated_total_distance_meters,
       route_date
  FROM st""", *_ROUTE_VIEWS)
def q_route_headers(spark, sf_dir):
    return routes.route_headers(*_route_tables(spark, sf_dir))


@register("route_stops", f"""
WITH {_ROUTE_STATUS},
ok AS (SELECT * FROM st WHERE status = 'success'),
lg AS (SELECT ok.request_id, ok.departure_time, l.leg_seq, l.duration_text, l.distance_m,
              {_DUR_SECS} AS sec
         FROM ok JOIN legs l ON l.route_id = ok.route_id),
cum AS (SELECT *, SUM(sec) OVER (PARTITION BY request_id ORDER BY leg_seq ROWS UNBOUNDED PRECEDING) AS cs FROM lg)
SELECT c.request_id, c.leg_seq AS stop_number, CAST(NULL AS VARCHAR) AS location_id, de.order_id AS destination_id,
       de.delivery_address AS destination_address, c.departure_time + to_seconds(CAST(c.cs AS BIGINT)) AS estimated_arrival_time,
       c.duration_text AS estimated_duration_from_previous_stop,
       c.distance_m AS estimated_distance_from_previous_stop_meters, de.total_kg AS total_kg_for_stop
  FROM cum c JOIN de ON de.request_id = c.request_id AND de.i = c.leg_seq
UNION ALL
SELECT request_id, 0, origin_location_id, NULL, NULL, departure_time, '0s', 0, NULL FROM ok""",
          *_ROUTE_VIEWS)
def q_route_stops(spark, sf_dir):
    return routes.route_stops(*_route_tables(spark, sf_dir))


@register("capacity_check", """
WITH kg AS (SELECT order_id, CAST(SUM(ordered_quantity_kg) AS BIGINT) AS total_kg FROM order_items GROUP BY order_id),
ld AS (SELECT l.route_id, CAST(SUM(coalesce(kg.total_kg, 0)) AS BIGINT) AS total_kg
         FROM legs l LEFT JOIN kg ON kg.order_id = l.order_id GROUP BY l.route_id)
SELECT r.request_id, r.vehicle_id, coalesce(ld.total_kg, 0) AS total_kg, v.capacity_kg,
       coalesce(ld.total_kg, 0) > v.capacity_kg AS over_capacity
  FROM req_routes r LEFT JOIN ld ON ld.route_id = r.route_id LEFT JOIN vehicles v ON v.vehicle_id = r.vehicle_id""",
          "req_routes", "legs", "order_items", "vehicles")
def q_capacity_check(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return routes.capacity_check(fx.req_routes, fx.route_legs, fx.order_items, fx.vehicles)


# -------------------------------------------------------------- validation
def _reject_sql(operator: str) -> str:
    missing = ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in REQUIRED[operator])
    some = " OR ".join(f"{n} IS NULL" for n in REQUIRED[operator])
    return f"""SELECT '{operator}' AS operator, request_id, 'error' AS status,
       'Missing required fields in body: ' || concat_ws(', ', {missing}) AS message
  FROM req_partial WHERE {some}"""


@register("request_rejects", "\nUNION ALL\n".join(_reject_sql(o) for o in REQUIRED), "req_partial")
def q_request_rejects(spark, sf_dir):
    req = Fixtures(spark, sf_dir).req_partial
    return reduce(DataFrame.unionByName, [split_requests(req, o)[1] for o in REQUIRED])


# ------------------------------------------------------------ JSON in and out
@register("requests_from_json", """
WITH j AS (SELECT value, CASE WHEN json_valid(value) THEN value END AS v FROM request_lines),
o AS (SELECT value, CASE WHEN json_type(v) = 'OBJECT' THEN v END AS v FROM j)
SELECT v ->> '$.request_id' AS request_id, v ->> '$.location_id' AS location_id,
       CASE WHEN v IS NULL THEN NULL WHEN json_exists(v, '$.status') THEN v ->> '$.status' ELSE 'Available' END AS status,
       CASE WHEN v IS NULL THEN value END AS not_an_object
  FROM o""", "request_lines")
def q_requests_from_json(spark, sf_dir):
    req = parse_requests(Fixtures(spark, sf_dir).request_lines, StructType.fromDDL(
        "request_id string, location_id string, status string"))
    bad = F.col(CORRUPT).isNotNull()
    return req.select("request_id", "location_id",
                      F.when(~bad, value_or_default(req, "status", logistics.DEFAULT_STOCK_STATUS)).alias("status"),
                      F.col(CORRUPT).alias("not_an_object"))


@register("vehicle_details_json", """
SELECT r.request_id, CAST(to_json({'vehicle_id': r.vehicle_id, 'vehicle_type': v.vehicle_type, 'capacity_kg': v.capacity_kg,
       'has_temperature_monitoring': v.has_temperature_monitoring, 'carrier_name': v.carrier_name,
       'found': v.vehicle_id IS NOT NULL}) AS VARCHAR) AS json
  FROM req_routes r LEFT JOIN vehicles v ON v.vehicle_id = r.vehicle_id""", "req_routes", "vehicles")
def q_vehicle_details_json(spark, sf_dir):
    return to_json_rows(q_vehicle_details(spark, sf_dir).select(
        "request_id", "vehicle_id", "vehicle_type", "capacity_kg", "has_temperature_monitoring", "carrier_name", "found"))


# ------------------------------------------------- one answer per request
def _section(query: str, fields: dict[str, str]) -> str:
    pack = ", ".join(f"{k} := {v}" for k, v in fields.items())
    return (f"(SELECT request_id, CAST(to_json(list(struct_pack({pack}) ORDER BY rank)) AS VARCHAR) AS j "
            f"FROM ({ORACLE[query]}) GROUP BY request_id)")


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_DAY = "CAST({0} AS VARCHAR)"
_ISO = ("CASE WHEN {0} IS NULL THEN NULL WHEN extract(microsecond FROM {0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%dT%H:%M:%S') "
        "ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') END")


@register("advice_card_json", f"""
SELECT r.request_id, '{{"status":"success","farm_details":' || coalesce(f.j, '{{}}') || ',"recent_harvests":' || coalesce(h.j, '[]')
       || ',"recent_qc_issues":' || coalesce(q.j, '[]') || ',"upcoming_schedules":' || coalesce(s.j, '[]') || '}}' AS json
  FROM req_advice r
  LEFT JOIN (SELECT request_id, CAST(to_json(struct_pack(farm_name := farm_name, farm_location := farm_location,
                    primary_crops_grown := primary_crops_grown)) AS VARCHAR) AS j FROM ({ORACLE["advice_farm_profile"]})) f USING (request_id)
  LEFT JOIN {_section("advice_harvests", {"harvest_date": _DAY.format("harvest_date"),
                                          **_same("harvested_quantity_kg", "quality_score", "quality_notes")})} h USING (request_id)
  LEFT JOIN {_section("advice_qc_issues", {"issue_date": _DAY.format("issue_date"), **_same("issue_type", "severity", "notes")})} q
            USING (request_id)
  LEFT JOIN {_section("advice_schedules", {n: _DAY.format(n) for n in ("planned_planting_date", "planned_harvest_date_estimate")}
                      | _same("expected_yield_estimate_kg", "status"))} s USING (request_id)""", "req_advice")
def q_advice_card_json(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return cards.advice_card_json(cards.advice_card(fx.req_advice, fx.harvest_records, fx.farm_qc_issues,
                                                    fx.planting_schedules, fx.farm_profiles, AS_OF))


_TIMES = ("departure_timestamp", "arrival_timestamp_estimate", "arrival_timestamp_actual")


@register("shipment_card_json", f"""
SELECT r.request_id, CASE WHEN s.shipment_id IS NULL
         THEN CAST(to_json(struct_pack(status := 'not_found', message := 'Shipment ID ' || r.shipment_id || ' not found.')) AS VARCHAR)
         ELSE '{{"status":"success","shipment_details":' || CAST(to_json(struct_pack({", ".join(
             f"{c} := {_ISO.format('s.' + c) if c in _TIMES else 's.' + c}" for c in logistics.SHIPMENT_COLS)})) AS VARCHAR)
              || ',"recent_cold_chain_readings":' || coalesce(c.j, '[]') || '}}' END AS json
  FROM req_tracking r LEFT JOIN shipments s ON s.shipment_id = r.shipment_id
  LEFT JOIN {_section("shipment_readings_top10", {"timestamp": _ISO.format('"timestamp"'),
                                                  **_same("temperature_celsius", "location", "sensor_id")})} c
            ON c.request_id = r.request_id""", "req_tracking", "shipments")
def q_shipment_card_json(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return cards.shipment_card_json(cards.shipment_card(fx.req_tracking, fx.shipments, fx.cold_chain_readings))


# ------------------------------------------------------- stored tables
def _stored(spark, name: str) -> str:
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")


@register("orders_stored", ORACLE["orders_placed"])
def q_orders_stored(spark, sf_dir):
    """Orders as the committed tables hold them, read back."""
    fx = Fixtures(spark, sf_dir)
    base = _stored(spark, "orders")
    orders, items, rejects = market.purchase_orders(fx.req_order_items, fx.customers, fx.market_prices,
                                                    store=lambda df: stored(df, f"{base}/_priced"))
    place_orders(orders, items, rejects, base, "day-1")
    discard(spark, f"{base}/_priced")
    kept = read_committed(spark, base, "orders")
    # dealt by an order id that is made again afterwards: no digest goes through the shuffle
    asked = (fx.req_order_items.select("request_id").distinct().repartition(stable_id("request_id"))
             .withColumn("order_id", stable_id("request_id")))
    return kept.join(asked, "order_id").select(*orders.columns)


ORDER_BUCKETS = 16


def _by_order(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders and their items stored in the same buckets by order."""
    fx, base = Fixtures(spark, sf_dir), _stored(spark, "by-order")
    return (store_bucketed(fx.orders, f"{base}/orders", "order_id", ORDER_BUCKETS),
            store_bucketed(fx.order_items, f"{base}/order_items", "order_id", ORDER_BUCKETS))


@register("order_destinations_bucketed", ORACLE["order_destinations"])
def q_order_destinations_bucketed(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    orders, items = _by_order(spark, sf_dir)
    dest = fx.route_legs.select(F.col("route_id").alias("request_id"), F.col("leg_seq").alias("pos"), "order_id")
    return routes.order_destinations(dest, orders, fx.customers, items, fx.geocodes)


@register("customer_lookup", """
SELECT customer_id, customer_name, shipping_address, shipping_address = 'O''Hara Dock' AS quoted
  FROM customers WHERE customer_type = 'BUILDING' AND customer_id NOT IN ('1', '2', 'O''Hara')""", "customers")
def q_customer_lookup(spark, sf_dir):
    """A one-off question on a stored domain table; a value, a quote and a
    list are bound by name."""
    base = _stored(spark, "domain")
    append(Fixtures(spark, sf_dir).customers, f"{base}/customers", "customers")
    return lookup(spark, base, "SELECT customer_id, customer_name, shipping_address, shipping_address = :dock AS quoted FROM customers "
                  "WHERE customer_type = :kind AND NOT array_contains(:others, customer_id)", ["customers"],
                  kind="BUILDING", dock="O'Hara Dock", others=["1", "2", "O'Hara"])


# --------------------------------------------------------------- streaming
def _sql_json_field(name: str, default: str) -> str:
    p = f"'$.{name}'"
    return f"""CASE WHEN json_extract(txt, {p}) IS NULL THEN '{default}'
            WHEN json_type(txt, {p}) = 'NULL' THEN NULL
            WHEN json_type(txt, {p}) = 'VARCHAR' THEN json_extract_string(txt, {p})
            WHEN json_type(txt, {p}) IN ('BIGINT', 'UBIGINT') THEN CAST(CAST(json_extract_string(txt, {p}) AS BIGINT) AS VARCHAR)
            WHEN json_type(txt, {p}) = 'DOUBLE' THEN CAST(CAST(json_extract_string(txt, {p}) AS DOUBLE) AS VARCHAR)
            ELSE CAST(json_extract(txt, {p}) AS VARCHAR) END"""


def _alert_sql(src: str, keep: str = "") -> str:
    """Classification of ``src`` (message_id, publish_time, data[, keep]):
    returns CTE text ending in relation ``c`` plus the final SELECT list."""
    return f"""
a AS (SELECT *, regexp_replace(data, '[^A-Za-z0-9+/=]', '', 'g') AS clean FROM {src}),
b AS (SELECT *, CASE WHEN data IS NULL OR length(clean) % 4 <> 0 THEN NULL ELSE TRY(from_base64(clean)) END AS bin FROM a),
t AS (SELECT *, TRY(decode(bin)) AS txt FROM b),
j AS (SELECT *, coalesce(json_valid(txt), false) AS isjson FROM t),
o AS (SELECT *, CASE WHEN isjson THEN json_type(CASE WHEN isjson THEN txt END) = 'OBJECT' ELSE false END AS obj FROM j),
f AS (SELECT *,
        CASE WHEN obj THEN {_sql_json_field("severity", "Unknown")} END AS severity,
        CASE WHEN obj THEN {_sql_json_field("shipment_id", "Unknown Shipment")} END AS shipment_id,
        CASE WHEN obj THEN {_sql_json_field("temperature", "N/A")} END AS temperature,
        CASE WHEN obj THEN {_sql_json_field("message", "No message")} END AS message
        FROM o),
c AS (SELECT *, CASE WHEN data IS NULL THEN 'no_data' WHEN txt IS NULL THEN 'error' WHEN NOT isjson THEN 'plain_text'
                     WHEN NOT obj THEN 'error' WHEN severity = 'Critical' THEN 'critical'
                     WHEN severity = 'Warning' THEN 'warning' ELSE 'info' END AS alert_class
        FROM f)"""


_ALERT_TEXT = """
       CASE alert_class
         WHEN 'critical' THEN 'Shipment ' || coalesce(shipment_id, 'None') || ': HIGH TEMP ' || coalesce(temperature, 'None') || '°C - ' || coalesce(message, 'None')
         WHEN 'warning' THEN 'Shipment ' || coalesce(shipment_id, 'None') || ': Elevated Temp ' || coalesce(temperature, 'None') || '°C - ' || coalesce(message, 'None')
         WHEN 'info' THEN 'Info Alert: Shipment ' || coalesce(shipment_id, 'None') || ', Temp ' || coalesce(temperature, 'None') || '°C - ' || coalesce(message, 'None')
         WHEN 'plain_text' THEN txt END"""


@register("alert_stream", f"""
WITH {_alert_sql("alerts")}
SELECT message_id, publish_time, alert_class, severity, shipment_id, temperature, message,
       {_ALERT_TEXT} AS text
  FROM c""", "alerts")
def q_alert_stream(spark, sf_dir):
    return alerts.alert_stream(spark, sf_dir)


_ENVELOPE = """
e0 AS (SELECT event_id, event, coalesce(json_valid(event), false) AS ok FROM alert_envelopes),
e1 AS (SELECT *, CASE WHEN ok THEN json_type(CASE WHEN ok THEN event END) = 'OBJECT' ELSE false END AS obj FROM e0),
e2 AS (SELECT *, CASE WHEN obj THEN json_extract(CASE WHEN obj THEN event END, '$.message') END AS msg FROM e1),
e3 AS (SELECT *,
         CASE WHEN NOT obj THEN 'bad_event'
              WHEN msg IS NULL OR CAST(msg AS VARCHAR) IN ('null', '{}', '""', '[]', 'false', '0', '0.0') THEN 'no_message'
              WHEN json_type(msg) <> 'OBJECT' OR json_extract(msg, '$.data') IS NULL THEN 'no_data'
              WHEN json_type(msg, '$.data') <> 'VARCHAR' THEN 'error' END AS env_class
         FROM e2),
env AS (SELECT event_id, env_class,
               CASE WHEN obj THEN coalesce(json_extract_string(event, '$.attributes.messageId'),
                                           json_extract_string(event, '$.message.messageId')) END AS message_id,
               CASE WHEN obj THEN coalesce(json_extract_string(event, '$.attributes.publishTime'),
                                           json_extract_string(event, '$.message.publishTime')) END AS publish_time,
               CASE WHEN env_class IS NULL THEN json_extract_string(msg, '$.data') END AS data
          FROM e3),"""


@register("alert_envelopes", f"""
WITH {_ENVELOPE}{_alert_sql("env")}
SELECT event_id, message_id, publish_time, coalesce(env_class, alert_class) AS alert_class,
       CASE WHEN env_class IS NULL THEN severity END AS severity,
       CASE WHEN env_class IS NULL THEN shipment_id END AS shipment_id,
       CASE WHEN env_class IS NULL THEN temperature END AS temperature,
       CASE WHEN env_class IS NULL THEN message END AS message,
       CASE WHEN env_class IS NULL THEN {_ALERT_TEXT} END AS text
  FROM c""", "alert_envelopes")
def q_alert_envelopes(spark, sf_dir):
    env = Fixtures(spark, sf_dir).alert_envelopes
    return alerts.classify_envelopes(env).select(
        "event_id", "message_id", "publish_time", "alert_class", "severity", "shipment_id",
        "temperature", "message", "text")


@register("alert_envelope_stream", ORACLE["alert_envelopes"])
def q_alert_envelope_stream(spark, sf_dir):
    return alerts.alert_envelope_stream(spark, sf_dir)


@register("alert_records", f"""
WITH {_alert_sql("alert_records")}
SELECT message_id, publish_time, alert_class, severity, shipment_id, temperature, message,
       {_ALERT_TEXT} AS text
  FROM c""", "alert_records")
def q_alert_records(spark, sf_dir):
    records = Fixtures(spark, sf_dir).alert_records
    return alerts.classify_alerts(alerts.messages_from_records(records)).select(
        "message_id", "publish_time", "alert_class", "severity", "shipment_id", "temperature", "message", "text")


@register("alert_sinks", f"""
SELECT CASE WHEN alert_class IN ('critical', 'warning', 'info', 'plain_text') THEN alert_class ELSE 'quarantine' END AS sink, *
  FROM ({ORACLE["alert_envelopes"]})""")
def q_alert_sinks(spark, sf_dir):
    return alerts.alert_sinks(spark, sf_dir)


@register("alert_producer_stream", """
SELECT CAST(event_id AS VARCHAR) AS message_id,
       CASE WHEN value > 15.0 THEN 'critical' ELSE 'warning' END AS alert_class,
       CASE WHEN value > 15.0 THEN 'Critical' ELSE 'Warning' END AS severity,
       CAST(user_id AS VARCHAR) AS shipment_id, CAST(value AS VARCHAR) AS temperature,
       CASE WHEN value > 15.0 THEN 'Critical: High temperature excursion reported.'
            ELSE 'Cold chain reading reported successfully. Warning: Temperature is elevated.' END AS message
  FROM events WHERE NOT isnan(value) AND value > 8.0""")
def q_alert_producer_stream(spark, sf_dir):
    return alerts.alert_producer_stream(spark, sf_dir)


@register("readings_append_stream", ORACLE["coldchain_reading_log"])
def q_readings_append_stream(spark, sf_dir):
    return alerts.readings_append_stream(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
