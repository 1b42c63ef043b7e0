"""Cold-chain alert stream (H19, ST1), alert producer (R6) and the
validated readings append stream (ST3).

``classify_alerts`` is a pure column transformation, so the same code runs
on a batch DataFrame and inside a Structured Streaming query. It is
stateless (no watermark, no state store): the reference keeps no state
either. Nothing in it can raise on bad input - undecodable messages become
class ``error`` instead of failing the micro-batch.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.bands import band_message, temperature_band
from larder.functions.text import json_text
from larder.operators.logistics import coldchain_reading_log
from larder.schemas import DRIVER
from larder.session import scratch_dir
from larder.sources.fixtures import alert_messages_from_events, envelopes_from_messages
from larder.sources.sinks import write_classes
from larder.sources.tables import spread

FILES_PER_BATCH = 1000

# Fixed texts and defaults of the reference's consumer.
DEFAULTS = {"severity": "Unknown", "shipment_id": "Unknown Shipment", "temperature": "N/A",
            "message": "No message"}
PY_NONE = "None"
B64_JUNK = "[^A-Za-z0-9+/=]"
DEGREE_C = "°C"


def _field(v: Column, name: str) -> Column:
    """Text of a JSON field as Python's str() would print it: default when
    the key is absent, null for a JSON null, else ``json_text``."""
    raw = F.variant_get(v, f"$.{name}", "variant")
    return (F.when(raw.isNull(), F.lit(DEFAULTS[name]))
            .when(F.is_variant_null(raw), F.lit(None).cast("string"))
            .otherwise(json_text(raw)))


def classify_alerts(msgs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """ST1/H19 over ``(message_id, publish_time, data)``.

    Classes: ``no_data`` (no data field), ``error`` (bad base64, bad UTF-8,
    or JSON that is not an object), ``plain_text`` (not JSON),
    ``critical`` / ``warning`` (exact-case severity), ``info`` (any other
    severity, including a missing one).
    """
    data = F.col("data")
    clean = F.regexp_replace(data, B64_JUNK, "")
    raw = F.when(data.isNull() | (F.length(clean) % 4 != 0), F.lit(None).cast("binary")) \
        .otherwise(F.try_to_binary(clean, F.lit("base64")))
    txt = F.try_validate_utf8(raw.cast("string"))
    m = msgs.select("message_id", "publish_time", *keep, data.alias("data"), txt.alias("_txt"),
                    F.try_parse_json(txt).alias("_v"))
    v = F.col("_v")
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    m = m.select("message_id", "publish_time", *keep, "data", "_txt", "_v", is_obj.alias("_obj"),
                 *[F.when(is_obj, _field(v, k)).alias(k) for k in DEFAULTS])
    sev = F.col("severity")
    cls = (F.when(F.col("data").isNull(), "no_data")
           .when(F.col("_txt").isNull(), "error")
           .when(F.col("_v").isNull(), "plain_text")
           .when(~F.col("_obj"), "error")
           .when(sev == "Critical", "critical")
           .when(sev == "Warning", "warning")
           .otherwise("info"))
    s, t, msg = [F.coalesce(F.col(k), F.lit(PY_NONE)) for k in ("shipment_id", "temperature",
                                                               "message")]
    text = (F.when(F.col("alert_class") == "critical",
                   F.concat(F.lit("Shipment "), s, F.lit(": HIGH TEMP "), t, F.lit(DEGREE_C + " - "),
                            msg))
            .when(F.col("alert_class") == "warning",
                  F.concat(F.lit("Shipment "), s, F.lit(": Elevated Temp "), t,
                           F.lit(DEGREE_C + " - "), msg))
            .when(F.col("alert_class") == "info",
                  F.concat(F.lit("Info Alert: Shipment "), s, F.lit(", Temp "), t,
                           F.lit(DEGREE_C + " - "), msg))
            .when(F.col("alert_class") == "plain_text", F.col("_txt")))
    return (m.withColumn("alert_class", cls)
            .select("message_id", "publish_time", *keep, "alert_class", "severity",
                    "shipment_id", "temperature", "message", text.alias("text")))


def classify_envelopes(events: DataFrame, col: str = "event") -> DataFrame:
    """ST1 from raw broker events (JSON text in ``col``): the envelope
    checks come first - ``bad_event`` (not a JSON object), ``no_message``
    (message missing or empty), ``no_data`` (message without data) - then
    the payload is classified by ``classify_alerts``. Message id and publish
    time come from the attributes next to the message, else from the
    message itself (D12). A data field that is not text is class ``error``
    (the reference fails on it)."""
    v = F.try_parse_json(F.col(col))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    msg = F.variant_get(v, "$.message", "variant")
    msg_text = F.to_json(msg)
    msg_empty = (msg.isNull() | F.is_variant_null(msg) |
                 msg_text.isin("{}", '""', "[]", "false", "0", "0.0"))
    msg_obj = F.coalesce(F.schema_of_variant(msg).startswith("OBJECT"), F.lit(False))
    data = F.variant_get(v, "$.message.data", "variant")
    data_text = F.try_variant_get(v, "$.message.data", "string")

    def attr(outer: str, inner: str) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.attributes.{outer}", "string"),
                          F.try_variant_get(v, f"$.message.{inner}", "string"))

    envelope = (F.when(~is_obj, "bad_event").when(msg_empty, "no_message")
                .when(~msg_obj | data.isNull(), "no_data")
                .when(data_text.isNull(), "error"))
    flat = events.select("*", attr("messageId", "messageId").alias("message_id"),
                         attr("publishTime", "publishTime").alias("publish_time"),
                         F.when(envelope.isNull(), data_text).alias("data"),
                         envelope.alias("_envelope"))
    out = classify_alerts(flat, keep=tuple(c for c in events.columns) + ("_envelope",))
    payload = ["severity", "shipment_id", "temperature", "message", "text"]
    return out.select(
        *[c for c in out.columns if c not in ("_envelope", "alert_class", *payload)],
        F.coalesce(F.col("_envelope"), F.col("alert_class")).alias("alert_class"),
        *[F.when(F.col("_envelope").isNull(), F.col(c)).alias(c) for c in payload])


def messages_from_records(records: DataFrame) -> DataFrame:
    """S7, ST2: broker records (key, value, topic, partition, offset,
    timestamp, headers: array of key and value) as ``message_id, publish_time,
    data``, on a batch or a stream.

    The value is the message data as published (base64 text; none: null). Id
    and time come from the headers ``messageId`` and ``publishTime``, else the
    record's place in its topic and its own time: these never change on a
    replay. The last of several headers of a name counts, as in the broker's
    clients.
    """
    def header(name: str) -> Column:
        mine = F.filter("headers", lambda h: h["key"] == name)
        return F.try_validate_utf8(F.get(mine, F.size(mine) - 1)["value"].cast("string"))

    place = F.concat_ws("-", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    # the session's wall clock, whatever its zone, as UTC text
    time = F.date_format(F.to_utc_timestamp("timestamp", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    return records.select(F.coalesce(header("messageId"), place).alias("message_id"),
                          F.coalesce(header("publishTime"), time).alias("publish_time"),
                          F.try_validate_utf8(F.col("value").cast("string")).alias("data"))


# ---------------------------------------------------------------------- R6
def alerts_from_readings(readings: DataFrame) -> DataFrame:
    """One broker message per reading above 8.0 C: JSON with severity
    ('Critical' above 15.0, else 'Warning'), shipment, temperature, the
    band message and the reading time, base64-encoded."""
    band = temperature_band("temperature_celsius")
    r = readings.withColumn("_band", band).filter(F.col("_band").isin("critical", "elevated"))
    body = F.to_json(F.struct(
        F.when(F.col("_band") == "critical", "Critical").otherwise("Warning").alias("severity"),
        F.col("shipment_id").alias("shipment_id"),
        F.col("temperature_celsius").alias("temperature"),
        band_message(F.col("_band")).alias("message"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")))
    return r.select(F.col("reading_id").alias("message_id"),
                    F.col("timestamp").alias("publish_time"),
                    F.translate(F.base64(body.cast("binary")), "\r\n", "").alias("data"))


# --------------------------------------------------------- stream drivers
def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File stream over the ``events`` table, one Parquet file or a folder of
    them (a broker topic in production). The path is a glob because a file
    stream refuses a path that names a single file."""
    stream = (spark.readStream.schema(DRIVER["events"])
              .option("maxFilesPerTrigger", FILES_PER_BATCH)
              .parquet(f"{sf_dir.rstrip('/')}/{{events.parquet}}"))
    return spread(stream)


def _run_to_parquet(df: DataFrame, spark: SparkSession, name: str,
                    partition_by: str | None = None) -> DataFrame:
    """Run a streaming DataFrame to completion (``availableNow``) into a
    fresh Parquet folder under the shared checkpoint folder; exactly-once
    through the file sink's commit log and the query checkpoint. Returns the
    written table, empty where the stream had no rows."""
    base = scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")
    w = (df.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(partition_by)
    q = w.start(f"{base}/out")
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H19 as a Structured Streaming job: events -> broker messages ->
    classified alerts, routed into one table partitioned by ``alert_class``
    (S8: critical vs warning vs info as partitions instead of stderr/stdout).
    Returns the written table."""
    msgs = alert_messages_from_events(_events_stream(spark, sf_dir))
    out = _run_to_parquet(classify_alerts(msgs), spark, "alerts", "alert_class")
    return out.select("message_id", "publish_time", "alert_class", "severity", "shipment_id",
                      "temperature", "message", "text")


CLASSES = ("critical", "warning", "info", "plain_text")
QUARANTINE = "quarantine"


def alert_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8, ST3: raw broker events to one table per alert class and a
    quarantine table for the rest, all from each micro-batch. Returns the
    tables stacked, with ``sink``."""
    env = envelopes_from_messages(alert_messages_from_events(_events_stream(spark, sf_dir)))
    rows = classify_envelopes(env).select(*ENVELOPE_OUT)
    base = scratch_dir(spark, f"sinks-{uuid.uuid4().hex}")
    write_classes(spark.createDataFrame([], rows.schema), -1, "alerts", base, "alert_class", CLASSES, QUARANTINE)

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_classes(batch, batch_id, "alerts", base, "alert_class", CLASSES, QUARANTINE)

    q = (rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    parts = [spark.read.schema(rows.schema).parquet(f"{base}/{name}").withColumn("sink", F.lit(name))
             for name in (*CLASSES, QUARANTINE)]
    return reduce(DataFrame.unionByName, parts).select("sink", *ENVELOPE_OUT)


ENVELOPE_OUT = ["event_id", "message_id", "publish_time", "alert_class", "severity",
                "shipment_id", "temperature", "message", "text"]


def alert_envelope_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 over raw broker events as a Structured Streaming job: envelope
    checks, then payload classification, into a table partitioned by
    ``alert_class``. Returns the written table."""
    env = envelopes_from_messages(alert_messages_from_events(_events_stream(spark, sf_dir)))
    out = _run_to_parquet(classify_envelopes(env).select(*ENVELOPE_OUT), spark, "envelopes",
                          "alert_class")
    return out.select(*ENVELOPE_OUT)


def alert_producer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 -> H19 round trip as a stream: readings are banded, elevated and
    critical ones published as base64 JSON alerts, and the consumer
    classifies them."""
    ev = _events_stream(spark, sf_dir)
    readings = ev.select(F.col("event_id").cast("string").alias("reading_id"),
                         F.col("user_id").cast("string").alias("shipment_id"),
                         F.col("ts").alias("timestamp"),
                         F.col("value").alias("temperature_celsius"))
    out = _run_to_parquet(classify_alerts(alerts_from_readings(readings)), spark, "producer")
    return out.select("message_id", "alert_class", "severity", "shipment_id", "temperature",
                      "message")


def readings_append_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: raw reading reports arrive as a stream, are validated and typed
    (H10) and appended to the readings table; rejects go to a quarantine
    table. ``foreachBatch`` writes both sides of a micro-batch; the batch id
    makes a replayed batch overwrite its own files instead of duplicating."""
    e = F.col("event_id")
    temp = (F.when(e % 17 == 0, F.lit("hot")).when(e % 19 == 0, F.lit("nan"))
            .otherwise(F.col("value").cast("string")))
    ts = (F.when(e % 23 == 0, F.lit("10:00")).when(e % 2 == 0, F.lit("2024-01-01T10:00:00Z"))
          .otherwise(F.lit("2024-01-01T10:00:00+05:30")))
    reports = _events_stream(spark, sf_dir).select(
        e.cast("string").alias("report_id"), F.col("user_id").cast("string").alias("shipment_id"),
        temp.alias("temperature_text"), ts.alias("timestamp_text"))
    base = scratch_dir(spark, f"readings-{uuid.uuid4().hex}")

    def write(df: DataFrame, table: str, batch_id: int) -> None:
        (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(f"{base}/{table}"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        valid, rejects = coldchain_reading_log(batch)
        write(valid, "readings", batch_id)
        write(rejects, "quarantine", batch_id)
        batch.unpersist()

    schema = coldchain_reading_log(reports)[0].schema
    write(spark.createDataFrame([], schema), "readings", -1)  # the table exists without a batch

    q = (reports.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/readings").select(*schema.names)
