"""Explicit StructTypes: no schema inference anywhere.

``DRIVER`` are the raw input tables of the test environment; ``DOMAIN`` are
the perishables tables the operators read and append to.
"""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DateType, DoubleType,
                               FloatType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampNTZType)


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


S, L, I, D, DT, B = StringType(), LongType(), IntegerType(), DoubleType(), DateType(), BooleanType()
TS = TimestampNTZType()

DRIVER: dict[str, StructType] = {
    "region": _s(("r_regionkey", I), ("r_name", S)),
    "nation": _s(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _s(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D),
                   ("c_mktsegment", S)),
    "supplier": _s(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _s(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I),
               ("p_retailprice", D)),
    "orders": _s(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S), ("o_totalprice", D),
                 ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _s(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I),
                   ("l_quantity", D), ("l_extendedprice", D), ("l_discount", D), ("l_tax", D),
                   ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _s(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", D),
                 ("props", S)),
    "documents": _s(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "embeddings": _s(("vec_id", L), ("embedding", ArrayType(FloatType())), ("label", I)),
    "pages": _s(("page_id", L), ("url", S), ("html", S)),
    "benchmark": _s(("item_id", L), ("text", S)),
    "labels": _s(("doc_id", L), ("quality", I), ("toxic", I)),
    "conversations": _s(("conv_id", L), ("turn", L), ("role", S), ("text", S)),
}

DOMAIN: dict[str, StructType] = {
    "farm_profiles": _s(("farm_id", S), ("farm_name", S), ("farm_location", S),
                        ("supplier_name", S), ("primary_crops_grown", S)),
    "harvest_records": _s(("harvest_id", S), ("farm_id", S), ("product_id", S), ("product_name", S),
                          ("category", S), ("harvest_date", DT), ("harvested_quantity_kg", L),
                          ("estimated_yield_kg", L), ("quality_score", D), ("quality_notes", S),
                          ("photos_gcs_path", S), ("planting_date", DT), ("field_id", S)),
    "farm_qc_issues": _s(("issue_id", S), ("farm_id", S), ("product_id", S), ("issue_date", DT),
                         ("issue_type", S), ("affected_quantity_kg", L), ("severity", S),
                         ("reported_by", S), ("notes", S), ("photos_gcs_path", S)),
    "planting_schedules": _s(("farm_id", S), ("product_id", S), ("planned_planting_date", DT),
                             ("planned_harvest_date_estimate", DT),
                             ("expected_yield_estimate_kg", L), ("status", S)),
    "product_catalog": _s(("product_id", S), ("product_name", S), ("category", S),
                          ("storage_requirements", S)),
    "customers": _s(("customer_id", S), ("customer_name", S), ("customer_type", S),
                    ("shipping_address", S)),
    "orders": _s(("order_id", S), ("customer_id", S), ("order_date", DT),
                 ("delivery_date_requested", DT), ("delivery_address", S), ("status", S),
                 ("total_amount", D)),
    "order_items": _s(("order_item_id", S), ("order_id", S), ("product_id", S),
                      ("ordered_quantity_kg", L), ("price_per_kg_at_order", D),
                      ("line_item_total", D)),
    "demand_forecasts": _s(("forecast_id", S), ("product_id", S), ("region", S),
                           ("forecast_date", DT), ("target_date_start", DT),
                           ("target_date_end", DT), ("forecasted_demand_kg", L),
                           ("confidence_level", S)),
    "market_prices": _s(("price_record_id", S), ("product_id", S), ("region", S),
                        ("market_date", DT), ("average_market_price_per_kg", D), ("source", S)),
    "inventory_stock": _s(("stock_id", S), ("product_id", S), ("location_id", S),
                          ("current_quantity_kg", L), ("entry_date", DT), ("best_before_date", DT),
                          ("expiry_date", DT), ("storage_conditions", S), ("status", S)),
    "shipments": _s(("shipment_id", S), ("order_id", S), ("origin_location_id", S),
                    ("destination_location_id", S), ("departure_timestamp", TS),
                    ("arrival_timestamp_estimate", TS), ("arrival_timestamp_actual", TS),
                    ("carrier_name", S), ("vehicle_id", S), ("status", S),
                    ("total_quantity_kg", L), ("requires_cold_chain", B)),
    "cold_chain_readings": _s(("reading_id", S), ("shipment_id", S), ("vehicle_id", S),
                              ("timestamp", TS), ("temperature_celsius", D), ("location", S),
                              ("sensor_id", S)),
    "vehicles": _s(("vehicle_id", S), ("vehicle_type", S), ("carrier_name", S),
                   ("capacity_kg", L), ("has_temperature_monitoring", B),
                   ("vehicle_license_no", S)),
    "warehouses": _s(("warehouse_id", S), ("location_address", S)),
    "route_legs": _s(("route_id", S), ("leg_seq", L), ("duration_text", S), ("distance_m", L)),
}

ALERT_MESSAGE = _s(("message_id", S), ("publish_time", TS), ("data", S))

DRIVER_TABLES = tuple(DRIVER)
