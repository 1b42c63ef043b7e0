"""Fixture views as SQL text, for the DuckDB oracle side of the checks.

These mirror ``larder.sources.fixtures`` (which builds the same tables with
the DataFrame API); the two are written independently so the oracle check
cross-validates them. Request views cover every source row.
"""

from __future__ import annotations

LINE_ID = ("concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), "
           "cast(l_partkey as string), cast(l_suppkey as string), "
           "cast(cast(l_shipdate as date) as string))")

VIEWS: dict[str, str] = {
    "farm_profiles": """
select cast(s_suppkey as string) farm_id, s_name farm_name,
       case when s_suppkey % 2 = 0 then concat('Lat: ', cast(s_nationkey as string), '.5, Lon: ', cast(s_suppkey % 90 as string), '.75') else n_name end farm_location,
       s_name supplier_name, n_name primary_crops_grown
  from supplier join nation on s_nationkey = n_nationkey""",
    "harvest_records": f"""
select {LINE_ID} harvest_id, cast(l_suppkey as string) farm_id, cast(l_partkey as string) product_id,
       cast(l_shipdate as date) harvest_date, cast(l_quantity as bigint) harvested_quantity_kg,
       1 - l_discount quality_score, l_returnflag quality_notes
  from lineitem""",
    "farm_qc_issues": f"""
select {LINE_ID} issue_id, cast(l_suppkey as string) farm_id,
       case when l_linenumber = 1 then null else cast(l_partkey as string) end product_id,
       cast(l_shipdate as date) issue_date, concat('T', cast(l_linenumber as string)) issue_type,
       case l_returnflag when 'R' then 'High' when 'A' then 'Medium' else 'Low' end severity, l_linestatus notes
  from lineitem""",
    "planting_schedules": """
select cast(l_suppkey as string) farm_id, cast(l_partkey as string) product_id,
       cast(l_shipdate as date) - 90 planned_planting_date, cast(l_shipdate as date) planned_harvest_date_estimate,
       cast(l_quantity as bigint) expected_yield_estimate_kg,
       case l_linenumber when 1 then 'Planned' when 2 then 'Planted' when 3 then 'Growing' when 4 then 'Harvesting' else 'Completed' end status
  from lineitem""",
    "product_catalog": """
select cast(p_partkey as string) product_id, p_name product_name, p_type category, p_brand storage_requirements
  from part""",
    "customers": """
select cast(c_custkey as string) customer_id, c_name customer_name, c_mktsegment customer_type,
       case when c_custkey % 10 = 9 then null
            when c_custkey % 2 = 0 then concat('Lat: ', cast(c_nationkey as string), '.5, Lon: -', cast(c_custkey % 180 as string), '.25')
            else concat(c_name, ', ', n_name) end shipping_address
  from customer join nation on c_nationkey = n_nationkey""",
    "orders_v": """
select cast(o_orderkey as string) order_id, cast(o_custkey as string) customer_id, cast(o_orderdate as date) order_date,
       cast(o_orderdate as date) + 3 delivery_date_requested, shipping_address delivery_address,
       o_orderstatus status, o_totalprice total_amount
  from orders join customers on cast(o_custkey as string) = customer_id""",
    "order_items": f"""
select {LINE_ID} order_item_id, cast(l_orderkey as string) order_id, cast(l_partkey as string) product_id,
       cast(l_quantity as bigint) ordered_quantity_kg, l_extendedprice / l_quantity price_per_kg_at_order,
       l_extendedprice line_item_total
  from lineitem""",
    "demand_forecasts": """
select concat_ws('|', cast(l_partkey as string), r_name, cast(cast(date_trunc('month', o_orderdate) as date) as string), cast(l_linenumber as string)) forecast_id,
       cast(l_partkey as string) product_id, r_name region,
       cast(date_trunc('month', o_orderdate) as date) - l_linenumber forecast_date,
       cast(date_trunc('month', o_orderdate) as date) target_date_start,
       last_day(cast(o_orderdate as date)) target_date_end,
       cast(sum(cast(l_quantity as bigint)) as bigint) forecasted_demand_kg,
       case when l_linenumber <= 2 then 'High' else 'Low' end confidence_level
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
 group by l_partkey, r_name, cast(date_trunc('month', o_orderdate) as date), last_day(cast(o_orderdate as date)), l_linenumber""",
    "market_prices": """
select concat_ws('|', cast(l_partkey as string), r_name, cast(cast(o_orderdate as date) as string)) price_record_id,
       cast(l_partkey as string) product_id, r_name region, cast(o_orderdate as date) market_date,
       cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as bigint)) as double) average_market_price_per_kg,
       'derived' source
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
 group by l_partkey, r_name, cast(o_orderdate as date)""",
    "vehicles": """
select concat('V', cast(s_suppkey as string)) vehicle_id, concat('LIC-', cast(s_suppkey as string)) vehicle_license_no,
       case when s_nationkey % 2 = 0 then 'Reefer' else 'Van' end vehicle_type,
       cast(floor(abs(s_acctbal)) as bigint) capacity_kg, s_suppkey % 2 = 0 has_temperature_monitoring,
       s_name carrier_name
  from supplier""",
    "warehouses": """
select cast(n_nationkey + 5 as string) warehouse_id, n_name location_address from nation""",
    "shipments": """
select cast(o_orderkey as string) shipment_id, cast(o_orderkey as string) order_id,
       cast(o_custkey % 25 + 5 as string) origin_location_id, cast(o_custkey as string) destination_location_id,
       o_orderdate departure_timestamp, o_orderdate + interval 7 day arrival_timestamp_estimate,
       cast(null as timestamp) arrival_timestamp_actual, cast(null as varchar) carrier_name,
       concat('V', cast(o_custkey % 10 as string)) vehicle_id,
       case o_orderstatus when 'O' then 'In Transit' when 'F' then 'Delivered' else 'Planned' end status,
       cast(floor(o_totalprice / 1000) as bigint) total_quantity_kg,
       o_orderpriority in ('1-URGENT', '2-HIGH') requires_cold_chain
  from orders""",
    "inventory_stock": f"""
select {LINE_ID} stock_id, cast(l_partkey as string) product_id, cast(l_suppkey as string) location_id,
       cast(l_quantity as bigint) current_quantity_kg, cast(l_shipdate as date) - 30 entry_date,
       cast(l_shipdate as date) - 3 best_before_date, cast(l_shipdate as date) expiry_date,
       l_linestatus storage_conditions,
       case l_returnflag when 'N' then 'Available' when 'R' then 'Reserved' else 'Expired' end status
  from lineitem""",
    "cold_chain_readings": """
select cast(event_id as string) reading_id, cast(user_id as string) shipment_id, ts as "timestamp",
       value temperature_celsius, props location, event_type sensor_id
  from events""",
    "alerts": """
select cast(event_id as string) message_id, ts publish_time,
       translate(base64(cast(case event_type when 'signup' then 'ping' when 'view' then '[1]'
         when 'click' then concat('{"shipment_id":"', cast(user_id as string), '","temperature":', cast(value as string), '}')
         when 'error' then concat('{"severity":"Critical","shipment_id":"', cast(user_id as string), '","temperature":', cast(value as string), ',"message":"m"}')
         else concat('{"severity":"Warning","shipment_id":null,"temperature":', cast(value as string), '}') end as blob)), concat(chr(13), chr(10)), '') data
  from events""",
    "alert_envelopes": """
select message_id event_id,
       case cast(message_id as bigint) % 5
         when 0 then '"just text"'
         when 1 then concat('{"attributes":{"messageId":"', message_id, '"}}')
         when 2 then concat('{"message":{"messageId":"', message_id, '"}}')
         else concat('{"message":{"data":"', data, '","messageId":"m', message_id,
                     '"},"attributes":{"messageId":"', message_id, '","publishTime":"',
                     strftime(publish_time, '%Y-%m-%dT%H:%M:%S'), '"}}') end event
  from alerts""",
    "alert_records": """
select case when cast(message_id as bigint) % 3 = 0 then concat('alerts-', cast(cast(message_id as bigint) % 4 as string), '-', message_id)
            else concat('h', message_id) end message_id,
       case when cast(message_id as bigint) % 3 = 2 then '1998-01-01T00:00:00'
            else strftime(publish_time, '%Y-%m-%dT%H:%M:%S') end publish_time,
       case when cast(message_id as bigint) % 7 <> 0 then data end data
  from alerts""",
    "legs": """
select cast(l_suppkey as string) route_id,
       cast(row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey) as bigint) leg_seq,
       cast(l_orderkey as string) order_id,
       case l_linenumber % 4 when 0 then concat(cast(cast(l_quantity as bigint) * 60 as string), 's')
            when 1 then concat('1h', cast(cast(l_quantity as bigint) as string), 'm5s')
            when 2 then concat(cast(cast(l_quantity as bigint) as string), 'm7s') else '2h' end duration_text,
       cast(l_quantity as bigint) * 1000 distance_m
  from lineitem""",
    "req_availability": """
select concat('A', cast(p_partkey as string)) request_id, cast(p_partkey as string) product_id,
       case when p_partkey % 3 = 0 then null else cast(p_partkey % 10 as string) end location_id
  from part
union all select 'A-none', 'NOPE', null""",
    "req_advice": """
select concat('H', cast(p_partkey as string)) request_id,
       case when p_partkey % 20 in (0, 5) then cast(p_partkey % 10 as string) end farm_id,
       case when p_partkey % 20 in (0, 10) then cast(p_partkey as string) end product_id,
       case when p_partkey % 3 = 0 then date '1998-01-01' end start_date,
       case when p_partkey % 2 = 0 then date '1998-06-30' end end_date
  from part""",
    "req_pickup": f"""
select {LINE_ID} request_id, cast(l_suppkey as string) farm_id, cast(l_partkey as string) product_id,
       cast(l_linenumber * 10 as bigint) quantity_kg, cast(l_shipdate as date) + 3 requested_date
  from lineitem""",
    "req_search": """
select concat('S', cast(n_nationkey as string)) request_id,
       case n_nationkey % 5 when 0 then '' when 1 then 'RED' when 2 then 'o_d' when 3 then concat('%', cast(n_nationkey as string))
         else case when n_nationkey % 10 = 9 then 'a\\b' else 'zzz' end end query
  from nation""",
    "req_order_items": """
select cast(l_orderkey as string) request_id,
       case when o_custkey % 11 = 0 then concat('X', cast(o_custkey as string)) else cast(o_custkey as string) end customer_id,
       cast(o_orderdate as date) order_date, l_linenumber pos, cast(l_partkey as string) product_id,
       case when l_linenumber = 7 and l_partkey % 3 = 0 then '2.7' when l_linenumber = 6 and l_partkey % 5 = 0 then '0'
            else cast(cast(l_quantity as bigint) as string) end quantity_text
  from lineitem join orders on l_orderkey = o_orderkey""",
    "order_bodies": """
select cast(o_orderkey as string) request_id, cast(o_orderdate as date) order_date,
       case when o_orderkey % 59 = 0 then '[1]' else concat('{',
         case when o_orderkey % 47 = 0 then '"x":1' when o_orderkey % 53 = 0 then '"customer_id":null'
              else concat('"customer_id":"', case when o_custkey % 11 = 0 then 'X' else '' end, cast(o_custkey as string), '"') end,
         case when o_orderkey % 37 = 0 then ',"items":[]' when o_orderkey % 41 = 0 then ''
              when o_orderkey % 43 = 0 then ',"items":"none"' else concat(',"items":[', items, ']') end,
         case when o_orderkey % 3 = 0 then ',"status":null' when o_orderkey % 3 = 1 then ',"status":"Confirmed"' else '' end,
         case when o_orderkey % 5 = 0 then ',"delivery_date_requested":null'
              when o_orderkey % 61 = 0 then ',"delivery_date_requested":"soon"'
              when o_orderkey % 5 = 1 then ',"delivery_date_requested":"1999-01-31"' else '' end,
         case when o_orderkey % 7 = 0 then ',"delivery_address":null'
              when o_orderkey % 7 = 1 then ',"delivery_address":"Dock 5"' else '' end, '}') end body
  from orders join (
    select l_orderkey, string_agg(item, ',' order by l_linenumber, item) items from (
    select l_orderkey, l_linenumber, concat('{"product_id":',
             case when l_linenumber = 2 and l_partkey % 19 = 0 then 'null' else concat('"', cast(l_partkey as string), '"') end,
             case when l_linenumber = 3 and l_partkey % 13 = 0 then '}' else concat(',"quantity_kg":',
               case when l_linenumber = 7 and l_partkey % 3 = 0 then '"2.7"' when l_linenumber = 6 and l_partkey % 5 = 0 then '0'
                    when l_linenumber = 5 and l_partkey % 7 = 0 then '12.9' when l_linenumber = 4 and l_partkey % 11 = 0 then 'true'
                    when l_linenumber = 2 and l_partkey % 17 = 0 then 'null' when l_linenumber = 1 and l_partkey % 23 = 0 then '" 7 "'
                    else cast(cast(l_quantity as bigint) as string) end, '}') end) item
      from lineitem) group by l_orderkey) on l_orderkey = o_orderkey""",
    "reading_reports": """
select cast(event_id as string) report_id, cast(user_id as string) shipment_id,
       case when event_id % 17 = 0 then 'hot' when event_id % 19 = 0 then 'nan' else cast(value as string) end temperature_text,
       case when event_id % 23 = 0 then '10:00' when event_id % 2 = 0 then '2024-01-01T10:00:00Z' else '2024-01-01T10:00:00+05:30' end timestamp_text
  from events""",
    "harvest_reports": f"""
select {LINE_ID} report_id, cast(l_suppkey as string) farm_id,
       case when l_linenumber = 6 then null else cast(l_partkey as string) end product_id,
       case when l_linenumber = 7 then '2.7' else cast(cast(l_quantity as bigint) as string) end quantity_text,
       case when l_linenumber = 5 then '2024-02-30' else cast(cast(l_shipdate as date) as string) end date_text
  from lineitem""",
    "qc_reports": f"""
select {LINE_ID} report_id, cast(l_suppkey as string) farm_id,
       case when l_linenumber = 3 then null else concat('T', cast(l_linenumber as string)) end issue_type,
       case when l_linenumber = 1 then null else cast(l_partkey as string) end product_id,
       case when l_linenumber = 2 then null when l_linenumber = 5 then '2024-13-01' else cast(cast(l_shipdate as date) as string) end issue_date_text,
       case when l_linenumber = 4 then 'lots' else cast(cast(l_quantity as bigint) as string) end affected_text,
       case when l_linestatus = 'O' then 'High' end severity, l_returnflag notes
  from lineitem""",
    "req_license": """
select concat('L', cast(s_suppkey as string)) request_id,
       case when s_suppkey % 13 = 0 then '' when s_suppkey % 17 = 0 then null
            when s_suppkey % 4 = 0 then concat('LIC-X', cast(s_suppkey as string)) else concat('LIC-', cast(s_suppkey as string)) end vehicle_license_no
  from supplier""",
    "geocodes": """
select n_name address, cast(n_nationkey as double) * 2.5 latitude, cast(n_regionkey as double) * 10.0 longitude
  from nation""",
    "req_routes": """
select concat(kind, cast(s_suppkey as string)) request_id, cast(s_suppkey as string) route_id,
       case when s_suppkey % 7 = 0 then concat('Z', cast(s_suppkey as string)) else cast(s_suppkey as string) end origin_location_id,
       case when s_suppkey % 5 = 0 then null else concat('V', cast(s_suppkey as string)) end vehicle_id,
       timestamp '1998-06-15 08:00:00' departure_time, date '1998-06-15' route_date
  from supplier, (values ('R'), ('U'), ('E')) t(kind)""",
    "route_orders": """
select concat('R', route_id) request_id, leg_seq pos, order_id from legs
union all
select concat('U', cast(s_suppkey as string)), 1, 'NOPE' from supplier""",
    "request_lines": """
select case when o_orderkey % 7 = 0 then '[' || o_orderkey || ']' when o_orderkey % 11 = 0 then '{bad ' || o_orderkey
            else '{"request_id":"J' || o_orderkey || '","location_id":"' || (o_custkey % 25) || '"'
                 || case o_orderkey % 3 when 0 then ',"status":null' when 1 then ',"status":"Reserved"' else '' end || '}' end as value
  from orders""",
    "req_partial": """
select concat('P', cast(o_orderkey as string)) request_id,
       case when o_custkey % 3 <> 0 then cast(o_custkey as string) end product_id,
       case when o_custkey % 4 <> 0 then cast(o_custkey % 25 as string) end location_id,
       case when o_orderpriority <> '5-LOW' then cast(o_orderkey as string) end shipment_id,
       case when o_custkey % 5 <> 0 then cast(o_orderdate as date) end target_date_start,
       case when o_orderpriority <> '1-URGENT' then cast(o_orderdate as date) + 30 end target_date_end
  from orders""",
    "req_origins": """
select concat('O', cast(o_orderkey as string)) request_id,
       case when o_orderkey % 7 = 0 then '999999' else cast(o_custkey % 25 + 5 as string) end location_id
  from orders""",
    "req_forecast": """
select concat('F', cast(p_partkey as string)) request_id, cast(p_partkey as string) product_id,
       make_date(1996, cast(p_partkey % 12 + 1 as integer), 1) target_date_start,
       last_day(make_date(1996, cast(p_partkey % 12 + 1 as integer), 1)) target_date_end,
       case p_partkey % 3 when 0 then null when 1 then '' else r_name end region
  from part join region on p_partkey % 5 = r_regionkey""",
    "req_price": f"""
select {LINE_ID} request_id, cast(l_partkey as string) product_id,
       case l_linenumber % 3 when 0 then null when 1 then 'ASIA' else '' end region,
       case when l_linenumber = 4 then null else cast(o_orderdate as date) end date
  from lineitem join orders on l_orderkey = o_orderkey""",
    "req_tracking": """
select concat('T', cast(o_orderkey as string)) request_id,
       case when o_orderkey % 13 = 0 then concat('X', cast(o_orderkey as string)) else cast(o_orderkey as string) end shipment_id
  from orders""",
    "req_stock": f"""
select concat('W', cast(s_suppkey as string), '-', v) request_id, cast(s_suppkey as string) location_id,
       cast(null as varchar) product_id, case when v = 'r' then 'Reserved' end status, v = 'n' nearing_expiry
  from supplier, (values ('a'), ('r'), ('n')) t(v)
union all
select concat('W', {LINE_ID}) request_id, cast(l_suppkey as string) location_id, cast(l_partkey as string) product_id,
       case l_linenumber % 3 when 0 then null when 1 then 'Available' else '' end status,
       l_linenumber % 2 = 0 nearing_expiry
  from lineitem""",
    "req_destinations_x": """
select concat('D', cast(o_orderkey as string)) request_id, concat('V', cast(o_custkey % 120 as string)) vehicle_id,
       case when o_orderkey % 9 = 0 then ['NOPE', 'NOPE2']
            else [cast(o_custkey as string), cast(o_custkey + 1 as string), cast(o_custkey as string), 'NOPE'] end destination_locations
  from orders""",
}

# Views that read other views.
DEPENDS: dict[str, tuple[str, ...]] = {"orders_v": ("customers",), "alert_envelopes": ("alerts",), "alert_records": ("alerts",),
                                        "route_orders": ("legs",)}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it needs (dependencies first)."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, ()):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in ordered)
    if not ordered or sql.lstrip().upper().startswith("WITH " + ordered[0].upper() + " AS"):
        return sql
    body = sql.lstrip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{sql}"
