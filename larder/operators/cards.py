"""One answer per request (U2, S9, F25): the bounded sections of a request as
nested arrays, gathered by one aggregate.

Every section is a table of at most k rows per request with a ``rank``. The
sections and the requests themselves are stacked, each in a column of its own,
and grouped by request once; no section joins another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators import farm, logistics

JSON = {"ignoreNullFields": "false"}


def iso_text(ts: str | Column) -> Column:
    """ISO-8601 text of a timestamp; microseconds only where there are some."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def gather(req: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """One row per request: ``request_id`` and for each section an array of
    its rows (structs without ``request_id`` and ``rank``) in rank order,
    empty where it has none."""
    frames = [req.select("request_id")]
    for name, df in sections.items():
        fields = [c for c in df.columns if c not in ("request_id", "rank")]
        frames.append(df.select("request_id", F.struct("rank", F.struct(*fields).alias("row")).alias(name)))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    arrays = [F.transform(F.array_sort(F.collect_list(n)), lambda x: x["row"]).alias(n) for n in sections]
    return stacked.groupBy("request_id").agg(*arrays)


def _date_fields(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        cols.append(iso_text(f.name).alias(f.name) if kind.startswith("timestamp") else
                    F.col(f.name).cast("string").alias(f.name) if kind == "date" else F.col(f.name))
    return df.select(*cols)


def advice_card(req: DataFrame, harvests: DataFrame, issues: DataFrame, schedules: DataFrame,
                farms: DataFrame, as_of) -> DataFrame:
    """H2 as one body: ``request_id, farm_details, recent_harvests,
    recent_qc_issues, upcoming_schedules``; at most five rows a section, the
    farm only for requests that name one."""
    return gather(req, {
        "farm_details": _date_fields(farm.advice_farm_profile(req, farms)).withColumn("rank", F.lit(1)),
        "recent_harvests": _date_fields(farm.advice_harvests(req, harvests, as_of)),
        "recent_qc_issues": _date_fields(farm.advice_qc_issues(req, issues, as_of)),
        "upcoming_schedules": _date_fields(farm.advice_schedules(req, schedules, as_of))})


def advice_card_json(card: DataFrame) -> DataFrame:
    """The body of each advice card as JSON text; no farm is ``{}``."""
    details = F.coalesce(F.to_json(F.get("farm_details", F.lit(0)), JSON), F.lit("{}"))
    parts = [F.lit('{"status":"success","farm_details":'), details]
    for name in ("recent_harvests", "recent_qc_issues", "upcoming_schedules"):
        parts += [F.lit(f',"{name}":'), F.to_json(name, JSON)]
    return card.select("request_id", F.concat(*parts, F.lit("}")).alias("json"))


def shipment_card(req: DataFrame, shipments: DataFrame, readings: DataFrame) -> DataFrame:
    """H9 as one body: ``request_id, shipment_id`` (asked for),
    ``shipment_details`` (one row or none) and
    ``recent_cold_chain_readings`` (at most ten)."""
    track = logistics.shipment_tracking(req, shipments)
    details = track.filter("found").withColumn("rank", F.lit(1)).drop("found", "message", "status") \
        .withColumnRenamed("shipment_status", "status")
    details = details.select("request_id", *[c for c in logistics.SHIPMENT_COLS], "rank")
    card = gather(req, {"shipment_details": _date_fields(details),
                        "recent_cold_chain_readings": _date_fields(logistics.shipment_readings(req, shipments, readings))})
    return card.join(req.select("request_id", "shipment_id"), "request_id")


def shipment_card_json(card: DataFrame) -> DataFrame:
    """The body of each shipment card as JSON text; an unknown shipment gives
    the not-found body."""
    found = F.concat(F.lit('{"status":"success","shipment_details":'),
                     F.to_json(F.get("shipment_details", F.lit(0)), JSON),
                     F.lit(',"recent_cold_chain_readings":'), F.to_json("recent_cold_chain_readings", JSON), F.lit("}"))
    missing = F.to_json(F.struct(F.lit("not_found").alias("status"), F.concat(
        F.lit("Shipment ID "), F.col("shipment_id"), F.lit(" not found.")).alias("message")), JSON)
    return card.select("request_id", F.when(F.size("shipment_details") > 0, found).otherwise(missing).alias("json"))
