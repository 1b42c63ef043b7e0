"""Delivery routes: origin and destination coordinates, stop tables with
arrival times, header totals and capacity checks (H14, H20-H23, R2-R5).

The reference asks a routing web service for legs and a geocoding service
for coordinates. Here both are data: the caller passes a ``legs`` table
(route_id, leg_seq, duration_text, distance_m[, order_id]) and optionally a
``geocodes`` table (address, latitude, longitude) used when an address does
not carry embedded 'Lat: .., Lon: ..' coordinates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.parse import coordinates, duration_seconds
from larder.operators.common import present, requested, topk
from larder.operators.window import DEFAULT_CHUNK, row_number_bucketed, running_sum


def _geo(df: DataFrame, text_col: str, geocodes: DataFrame | None) -> DataFrame:
    """latitude/longitude from embedded text, else from ``geocodes``;
    ``source`` says which ('parsed', 'geocoded' or null).

    Texts are parsed in a projection. Only texts that carry no coordinates
    meet ``geocodes``; the other rows get a join key of their own, spread by
    a hash, so null or parsed texts never form one hot key."""
    out = df.withColumn("_c", coordinates(F.col(text_col)))
    if geocodes is None:
        out = out.withColumns({"_glat": F.lit(None).cast("double"),
                               "_glon": F.lit(None).cast("double")})
    else:
        g = topk(geocodes.select(F.col("address").alias("_key"), "latitude", "longitude"),
                 ["_key"], [F.col("latitude").asc(), F.col("longitude").asc()], 1) \
            .select(F.struct(F.lit(True).alias("text"), "_key").alias("_key"),
                    F.col("latitude").alias("_glat"), F.col("longitude").alias("_glon"))
        ask = F.col("_c").isNull() & F.col(text_col).isNotNull()
        spread = F.xxhash64(*df.columns).cast("string")
        key = F.struct(ask.alias("text"), F.when(ask, F.col(text_col)).otherwise(spread)
                       .alias("_key"))
        out = out.withColumn("_key", key).join(g, "_key", "left").drop("_key")
    parsed = F.col("_c").isNotNull()
    geocoded = F.col("_glat").isNotNull() & F.col("_glon").isNotNull()
    return out.select(
        *df.columns,
        F.when(parsed, F.col("_c.latitude")).when(geocoded, F.col("_glat")).alias("latitude"),
        F.when(parsed, F.col("_c.longitude")).when(geocoded, F.col("_glon")).alias("longitude"),
        F.when(parsed, "parsed").when(geocoded, "geocoded").alias("source"))


# ------------------------------------------------------------- U1 / H20
def location_texts(farms: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Location id -> text, farm location first, warehouse address
    second (the reference's UNION ALL ... LIMIT 1)."""
    u = (farms.select(F.col("farm_id").alias("location_id"),
                      F.col("farm_location").alias("location_text"), F.lit(0).alias("prio"))
         .unionByName(warehouses.select(F.col("warehouse_id").alias("location_id"),
                                        F.col("location_address").alias("location_text"),
                                        F.lit(1).alias("prio"))))
    return topk(u, ["location_id"], [F.col("prio").asc(), F.col("location_text").asc()], 1) \
        .select("location_id", "location_text")


def origin_coordinates(req: DataFrame, farms: DataFrame, warehouses: DataFrame,
                       geocodes: DataFrame | None = None) -> DataFrame:
    """Coordinates of each requested location id; 'not_found' when
    the id is unknown or no coordinates can be had. Located once per place,
    before the requests join."""
    loc = _geo(location_texts(farms, warehouses), "location_text", geocodes)
    out = req.select("request_id", "location_id").join(loc, "location_id", "left")
    return out.select("request_id", "location_id", "location_text", "latitude", "longitude",
                      "source", F.when(F.col("latitude").isNotNull(), "success")
                      .otherwise("not_found").alias("status"))


# -------------------------------------------------------------- R2 / H21
def order_total_kg(order_items: DataFrame) -> DataFrame:
    """R2: kilograms per order (partial aggregation before the shuffle)."""
    return order_items.groupBy("order_id").agg(
        F.sum("ordered_quantity_kg").cast("bigint").alias("total_kg"))


def _order_addresses(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """J2 + A6: (order, delivery address) of orders whose customer exists,
    duplicates removed."""
    return (orders.select("order_id", "customer_id", "delivery_address")
            .join(customers.select("customer_id"), "customer_id", "left_semi")
            .select("order_id", "delivery_address").distinct())


def _valid_destinations(dest: DataFrame, orders: DataFrame, customers: DataFrame,
                        geocodes: DataFrame | None) -> DataFrame:
    """Distinct listed orders that have a customer and coordinates, with their
    first position in the list."""
    d = dest.groupBy("request_id", "order_id").agg(F.min("pos").alias("position"))
    a = _geo(_order_addresses(requested(orders, dest, ["order_id"]), customers),
             "delivery_address", geocodes).filter(F.col("latitude").isNotNull())
    return d.join(a, "order_id")


def order_destinations(dest: DataFrame, orders: DataFrame, customers: DataFrame,
                       order_items: DataFrame, geocodes: DataFrame | None = None) -> DataFrame:
    """Per request and distinct listed order: address, coordinates and
    kilograms; orders without coordinates are dropped (as the reference
    drops what it cannot geocode). ``dest`` is the exploded order list
    ``(request_id, pos, order_id)``. Orders and items are cut to the listed
    orders first."""
    kg = order_total_kg(requested(order_items, dest, ["order_id"]))
    return (_valid_destinations(dest, orders, customers, geocodes).join(kg, "order_id", "left")
            .select("request_id", "order_id", F.col("delivery_address").alias("address"),
                    "latitude", "longitude",
                    F.coalesce(F.col("total_kg"), F.lit(0)).cast("bigint").alias("total_kg"),
                    "position"))


# -------------------------------------------------------------------- H23
def leg_durations(legs: DataFrame) -> DataFrame:
    """Routing duration text of every leg in seconds."""
    return legs.select("route_id", "leg_seq", "duration_text",
                       duration_seconds("duration_text").alias("duration_seconds"))


# -------------------------------------------------------------------- H14
def _route_status(routes: DataFrame, legs: DataFrame, dest: DataFrame, stops: DataFrame,
                  farms: DataFrame, warehouses: DataFrame,
                  geocodes: DataFrame | None) -> DataFrame:
    """Status per route request, given its valid destinations ``stops``, by the first check that fails: 'error' (no
    origin or an empty order list), 'not_found' (origin without
    coordinates), 'unavailable' (no listed order has a customer and
    coordinates, or the route has no legs), else 'success'."""
    org = origin_coordinates(routes.select("request_id",
                                           F.col("origin_location_id").alias("location_id")),
                             farms, warehouses, geocodes).select(
        "request_id", F.col("status").alias("origin_status"))
    per_route = requested(legs, routes, ["route_id"]).groupBy("route_id").agg(
        F.count("*").alias("n_legs"),
        F.sum(F.coalesce(duration_seconds("duration_text"), F.lit(0))).alias("total_sec"),
        F.sum("distance_m").alias("total_m"))
    listed = dest.groupBy("request_id").agg(F.count("*").alias("n_listed"))
    valid = stops.groupBy("request_id").agg(F.count("*").alias("n_valid"))
    origin = F.col("origin_location_id")
    code = (F.when(present(origin).isNull() | F.col("n_listed").isNull(), 0)
            .when(F.col("origin_status") != "success", 1).when(F.col("n_valid").isNull(), 2)
            .when(F.col("n_legs").isNull(), 3).otherwise(4))
    texts = [F.lit("Missing required input parameters"),
             F.concat(F.lit("Origin location ID "), origin,
                      F.lit(" not found or coordinates unavailable.")),
             F.lit("Could not find valid destinations or coordinates for provided order IDs."),
             F.lit("Could not compute a route with the provided locations.")]
    kinds = ["error", "not_found", "unavailable", "unavailable", "success"]
    return (routes.join(org, "request_id").join(per_route, "route_id", "left")
            .join(listed, "request_id", "left").join(valid, "request_id", "left")
            .withColumn("_code", code)
            .withColumn("status", F.get(F.array(*[F.lit(k) for k in kinds]), F.col("_code")))
            .withColumn("message", F.get(F.array(*texts), F.col("_code"))))


def route_headers(routes: DataFrame, legs: DataFrame, dest: DataFrame, orders: DataFrame,
                  customers: DataFrame, order_items: DataFrame, farms: DataFrame,
                  warehouses: DataFrame, geocodes: DataFrame | None = None) -> DataFrame:
    """H14 header: status and message, stop count (legs + 1), total duration
    ('<n>s') and distance, route date. ``dest`` is the exploded order list
    ``(request_id, pos, order_id)``; a request without rows there has an
    empty list."""
    stops = _valid_destinations(dest, orders, customers, geocodes)
    r = _route_status(routes, legs, dest, stops, farms, warehouses, geocodes)
    ok = F.col("status") == "success"
    return r.select(
        "request_id", "route_id", "status", "message", "vehicle_id",
        F.when(ok, F.col("n_legs") + 1).cast("bigint").alias("num_stops_on_route"),
        F.when(ok, F.concat(F.col("total_sec").cast("string"), F.lit("s")))
        .alias("estimated_total_duration"),
        F.when(ok, F.col("total_m")).cast("bigint").alias("estimated_total_distance_meters"),
        F.col("route_date").cast("date").alias("route_date"))


def route_stops(routes: DataFrame, legs: DataFrame, dest: DataFrame, orders: DataFrame,
                customers: DataFrame, order_items: DataFrame, farms: DataFrame,
                warehouses: DataFrame, geocodes: DataFrame | None = None) -> DataFrame:
    """H14 stops of the 'success' requests: the origin as stop 0 at the
    departure time, then leg i ends at the i-th listed order that has a
    customer and coordinates (J10). Arrival = departure + running sum of leg
    durations (W1). Legs are numbered from 1 per route; legs beyond the
    destinations, and destinations beyond the legs, give no stop. Sums and
    numbers are two-level, so a huge route never sits in one task.

    A request has a first valid destination exactly where it lists one, so
    the origin is emitted next to it and destinations are found only once.
    Legs that only requests without a located origin name are cut in their
    scan. Stops and legs meet where the legs were summed."""
    located = origin_coordinates(routes.select("request_id", F.col("origin_location_id").alias("location_id")),
                                 farms, warehouses, geocodes).filter("status = 'success'")
    asked = (routes.filter(present("origin_location_id").isNotNull())
             .join(located.select("request_id"), "request_id", "left_semi")
             .select("request_id", "route_id", "origin_location_id", "departure_time"))
    found = order_destinations(dest.filter(F.col("request_id").isNotNull()), orders, customers, order_items, geocodes)
    mine = requested(legs.select("route_id", "leg_seq", "duration_text", "distance_m"), asked, ["route_id"])
    ok = asked.join(mine.select("route_id").distinct(), "route_id", "left_semi")
    # orders without a position come first and give no stop; they stay until all are numbered, so that numbers and
    # counts are made of the same rows, found once
    block = F.coalesce(F.floor(F.col("position") / DEFAULT_CHUNK), F.lit(-1))
    ends = row_number_bucketed(found.withColumn("_block", block), ["request_id"], "_block",
                               ["position", "order_id", "address"], "leg_seq", of_key=ok).filter(F.col("position").isNotNull())
    zero = F.lit(0).cast("bigint")
    numbers = F.when(F.col("leg_seq") == 1, F.array(zero, zero + 1)).otherwise(F.array(F.col("leg_seq").cast("bigint")))
    stop = (ends.withColumn("stop", F.explode(numbers))
            .select("request_id", "route_id", F.col("stop").alias("leg_seq"), "departure_time",
                    F.when(F.col("stop") == 0, F.col("origin_location_id")).alias("origin_location_id"),
                    *[F.when(F.col("stop") != 0, F.col(c)).alias(c) for c in ("order_id", "address", "total_kg")]))
    # stops stand beside their legs, dealt once: each looks up the legs of its number
    timed = running_sum(mine, ["route_id"], "leg_seq", duration_seconds("duration_text"), "cum_sec",
                        beside=stop.withColumn("_stop", F.lit(True)))
    leg = F.when(F.col("_stop").isNull(), F.struct("duration_text", "distance_m", "cum_sec"))
    legs_of = F.collect_list(leg).over(Window.partitionBy("route_id", "_chunk", "leg_seq"))
    origin = F.col("stop") == 0
    at = F.when(origin, F.lit(0)).otherwise(F.col("cum_sec"))
    return (timed.withColumn("_legs", legs_of).filter("_stop")
            .select("request_id", F.col("leg_seq").alias("stop"), "departure_time", "origin_location_id", "order_id",
                    "address", "total_kg", F.inline_outer("_legs"))
            .filter(origin | F.col("cum_sec").isNotNull())
            .select("request_id", F.col("stop").alias("stop_number"),
                    F.when(origin, F.col("origin_location_id")).alias("location_id"),
                    F.when(~origin, F.col("order_id")).alias("destination_id"),
                    F.when(~origin, F.col("address")).alias("destination_address"),
                    F.timestamp_add("SECOND", at, F.col("departure_time")).alias("estimated_arrival_time"),
                    F.when(origin, F.lit("0s")).otherwise(F.col("duration_text"))
                    .alias("estimated_duration_from_previous_stop"),
                    F.when(origin, F.lit(0)).otherwise(F.col("distance_m")).cast("bigint")
                    .alias("estimated_distance_from_previous_stop_meters"),
                    F.when(~origin, F.col("total_kg")).alias("total_kg_for_stop")))


# --------------------------------------------------------------------- R5
def capacity_check(routes: DataFrame, legs: DataFrame, order_items: DataFrame,
                   vehicles: DataFrame) -> DataFrame:
    """Kilograms loaded on a route (sum over its stops) against the
    vehicle's capacity; ``over_capacity`` null when the vehicle is unknown."""
    legs = requested(legs.select("route_id", "order_id"), routes, ["route_id"])
    kg = order_total_kg(requested(order_items, legs, ["order_id"]))
    load = (legs.join(kg, "order_id", "left")
            .groupBy("route_id").agg(F.sum(F.coalesce(F.col("total_kg"), F.lit(0)))
                                     .cast("bigint").alias("total_kg")))
    veh = topk(requested(vehicles.select("vehicle_id", "capacity_kg"), routes, ["vehicle_id"]), ["vehicle_id"],
               [F.col("capacity_kg").asc()], 1).drop("rank")
    out = (routes.select("request_id", "route_id", "vehicle_id")
           .join(load, "route_id", "left").join(veh, "vehicle_id", "left"))
    total = F.coalesce(F.col("total_kg"), F.lit(0)).cast("bigint")
    return out.select("request_id", "vehicle_id", total.alias("total_kg"), "capacity_kg",
                      (total > F.col("capacity_kg")).alias("over_capacity"))

