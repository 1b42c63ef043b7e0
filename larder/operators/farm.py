"""Farm domain: harvest log, harvest advice, QC issues, pickup feasibility
(H1-H4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.ids import stable_id
from larder.functions.parse import parse_date, parse_float, parse_int
from larder.operators.common import (ANY_KEY, expand_optional, normalise_optional, pattern_keys,
                                     requested, topk)
from larder.operators.validate import missing_fields, required_message
from larder.sources.requests import value_or_default

# Fixed values taken from the reference.
DEFAULT_LOOKBACK_DAYS = 90
PICKUP_WINDOW_DAYS = 7
#: End of a window without one.
LAST_DAY = "9999-12-31"
QC_DEFAULTS = {"severity": "Medium", "reported_by": "AI Agent", "notes": ""}
MSG_PICKUP_OK = ("Pickup request received and appears feasible. Logistics is being notified "
                 "and will confirm exact details.")
# Marker for "issue applies to every product of the farm" (product_id null).
_ANY_PRODUCT = "\u0001any"


def _date(d) -> Column:
    return d if isinstance(d, Column) else F.lit(d).cast("date")


def _opt(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


# --------------------------------------------------------------------- H1
HARVEST_COLS = ["harvest_id", "farm_id", "product_id", "product_name", "category",
                "harvest_date", "harvested_quantity_kg", "estimated_yield_kg", "quality_score",
                "quality_notes", "photos_gcs_path", "planting_date", "field_id"]


def harvest_log(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H1: validate and type raw harvest reports.

    Input columns: ``report_id, farm_id, product_id, quantity_text,
    date_text`` and optionally product_name, category, estimated_yield_text,
    quality_score_text, quality_notes, photos_gcs_path, planting_date_text,
    field_id. Returns ``(valid rows in harvest_records layout, rejects)``;
    the first failing check decides the error, in the reference's order.
    """
    r = reports
    est, qs, pd_ = (_opt(r, "estimated_yield_text"), _opt(r, "quality_score_text"),
                    _opt(r, "planting_date_text"))
    r = r.select(
        "*",
        missing_fields(["farm_id", "product_id", "harvested_quantity_kg", "harvest_date"],
                       {"farm_id": F.col("farm_id"), "product_id": F.col("product_id"),
                        "harvested_quantity_kg": F.col("quantity_text"),
                        "harvest_date": F.col("date_text")}, r).alias("missing"),
        parse_date("date_text").alias("_d"), parse_int("quantity_text").alias("_q"),
        est.alias("_est_t"), parse_int(est).alias("_est"), qs.alias("_qs_t"),
        parse_float(qs).alias("_qs"), pd_.alias("_pd_t"), parse_date(pd_).alias("_pd"))
    checks = [
        (F.size("missing") > 0, "missing_fields", required_message("missing")),
        (F.col("_d").isNull(), "invalid_harvest_date",
         F.lit("Invalid harvest_date format. Expected YYYY-MM-DD.")),
        (F.col("_q").isNull(), "invalid_harvested_quantity_kg",
         F.lit("Invalid format for harvested_quantity_kg. Expected integer.")),
        (F.col("_est_t").isNotNull() & F.col("_est").isNull(), "invalid_estimated_yield_kg",
         F.lit("Invalid format for estimated_yield_kg. Expected integer.")),
        (F.col("_qs_t").isNotNull() & F.col("_qs").isNull(), "invalid_quality_score",
         F.lit("Invalid format for quality_score. Expected number.")),
        (F.col("_pd_t").isNotNull() & F.col("_pd").isNull(), "invalid_planting_date",
         F.lit("Invalid planting_date format. Expected YYYY-MM-DD.")),
    ]
    code, msg = F.lit(None).cast("string"), F.lit(None).cast("string")
    for cond, c, m in reversed(checks):
        code = F.when(cond, F.lit(c)).otherwise(code)
        msg = F.when(cond, m).otherwise(msg)
    r = r.withColumn("error_code", code).withColumn("error_message", msg) \
        .withColumn("_notes", value_or_default(r, "quality_notes", ""))  # a null in a JSON report stays null
    valid = r.filter(F.col("error_code").isNull()).select(
        stable_id("report_id", "farm_id", "product_id", "quantity_text", "date_text")
        .alias("harvest_id"),
        "farm_id", "product_id", _opt(r, "product_name").alias("product_name"),
        _opt(r, "category").alias("category"), F.col("_d").alias("harvest_date"),
        F.col("_q").alias("harvested_quantity_kg"), F.col("_est").alias("estimated_yield_kg"),
        F.col("_qs").alias("quality_score"),
        F.col("_notes").alias("quality_notes"),
        _opt(r, "photos_gcs_path").alias("photos_gcs_path"),
        F.col("_pd").alias("planting_date"), _opt(r, "field_id").alias("field_id"))
    rejects = r.filter(F.col("error_code").isNotNull()).select(
        "report_id", "error_code", "error_message",
        F.array_join("missing", ", ").alias("missing"))
    return valid, rejects


# --------------------------------------------------------------------- H3
QC_COLS = ["issue_id", "farm_id", "product_id", "issue_date", "issue_type",
           "affected_quantity_kg", "severity", "reported_by", "notes", "photos_gcs_path"]


def qc_issue_log(reports: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """H3: validate and type raw QC issue reports (``report_id, farm_id,
    issue_type`` required; ``product_id, issue_date_text, affected_text,
    severity, reported_by, notes, photos_gcs_path`` optional, defaults when
    null: issue date ``as_of``, severity 'Medium', reporter 'AI Agent',
    notes '')."""
    r = reports
    d_text = _opt(r, "issue_date_text")
    aff = _opt(r, "affected_text")
    r = r.select(
        "*",
        missing_fields(["farm_id", "issue_type"],
                       {"farm_id": F.col("farm_id"), "issue_type": _opt(r, "issue_type")}, r)
        .alias("missing"),
        F.when(d_text.isNull(), _date(as_of)).otherwise(parse_date(d_text)).alias("_d"),
        aff.alias("_aff_t"), parse_int(aff).alias("_aff"))
    code = (F.when(F.size("missing") > 0, "missing_fields")
            .when(F.col("_d").isNull(), "invalid_issue_date")
            .when(F.col("_aff_t").isNotNull() & F.col("_aff").isNull(),
                  "invalid_affected_quantity_kg"))
    msg = (F.when(F.size("missing") > 0, required_message("missing"))
           .when(F.col("_d").isNull(), F.lit("Invalid issue_date format. Expected YYYY-MM-DD."))
           .when(F.col("_aff_t").isNotNull() & F.col("_aff").isNull(),
                 F.lit("Invalid format for affected_quantity_kg. Expected integer.")))
    r = r.withColumn("error_code", code).withColumn("error_message", msg)
    for k, v in QC_DEFAULTS.items():
        r = r.withColumn(f"_def_{k}", value_or_default(r, k, v))
    valid = r.filter(F.col("error_code").isNull()).select(
        stable_id("report_id", "farm_id", "issue_type", d_text).alias("issue_id"),
        "farm_id", _opt(r, "product_id").alias("product_id"), F.col("_d").alias("issue_date"),
        "issue_type", F.col("_aff").alias("affected_quantity_kg"),
        *[F.col(f"_def_{k}").alias(k) for k in QC_DEFAULTS],
        _opt(r, "photos_gcs_path").alias("photos_gcs_path"))
    valid = valid.select(*QC_COLS)
    rejects = r.filter(F.col("error_code").isNotNull()).select(
        "report_id", "error_code", "error_message",
        F.array_join("missing", ", ").alias("missing"))
    return valid, rejects


# --------------------------------------------------------------------- H2
def _date_window(req: DataFrame, as_of) -> DataFrame:
    """[lo, hi] per request; no dates at all -> last 90 days."""
    none = F.col("start_date").isNull() & F.col("end_date").isNull()
    return req.withColumn("lo", F.when(none, F.date_sub(_date(as_of), DEFAULT_LOOKBACK_DAYS))
                          .otherwise(F.col("start_date"))) \
              .withColumn("hi", F.col("end_date"))


def _topk_in_window(req: DataFrame, facts: DataFrame, keys: Sequence[str], date_col: str,
                    tie_col: str, out_cols: Sequence[str], k: int) -> DataFrame:
    """Latest ``k`` facts per request among facts matching ``keys`` with
    ``lo <= date <= hi`` (open ends when null).

    1. Facts are cut to the top k per (keys, date) - nothing beyond that can
       reach any answer, and WindowGroupLimit applies the cut map-side. A
       key keeps at most k rows per calendar day.
    2. Facts and the distinct ends of the windows are merged per key in date
       order; facts are numbered, and an end carries the number of the last
       fact up to it. The k facts up to that number are the only ones that
       can answer a window with this end, whatever its start.
    3. Requests meet those k facts on an equi join of (keys, end); facts
       before the start go. No row per day or year of a window is made.
    4. Re-ranked per request (a request may ask for several keys).
    """
    keys = list(keys)
    fields = list(dict.fromkeys([date_col, tie_col, *out_cols]))
    compact = topk(facts.filter(F.col(date_col).isNotNull()).select(*keys, *fields),
                   [*keys, date_col], [F.col(tie_col).asc()], k)
    req = req.withColumn("_end", F.coalesce("hi", F.lit(LAST_DAY).cast("date")))
    merged = compact.select(*keys, F.col(date_col).alias("_end"), "rank",
                            F.struct(*fields).alias("_fact")).unionByName(
        req.select(*keys, "_end").distinct(), allowMissingColumns=True)
    is_fact = F.col("_fact").isNotNull()
    # facts of a day before its ends; within a day the first by tie comes last
    per_key = Window.partitionBy(*keys)
    numbered = merged.withColumn("_n", F.count("_fact").over(
        per_key.orderBy("_end", F.col("rank").desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    latest = F.collect_list("_fact").over(per_key.orderBy("_n").rangeBetween(1 - k, 0))
    ends = numbered.withColumn("_latest", latest).filter(~is_fact) \
        .select(*keys, "_end", F.inline("_latest"))
    got = req.select("request_id", *keys, "lo", "_end").join(ends, [*keys, "_end"]) \
        .filter(F.col("lo").isNull() | (F.col(date_col) >= F.col("lo")))
    return topk(got.select("request_id", *fields), ["request_id"],
                [F.col(date_col).desc(), F.col(tie_col).asc()], k) \
        .select("request_id", *out_cols, *([tie_col] if tie_col not in out_cols else []), "rank")


_KEYS = ["farm_id", "product_id"]
_PKEYS = ["_p_farm_id", "_p_product_id"]
SALTS = 64  # parts of the no-filter pattern


def _advice_requests(req: DataFrame, as_of) -> DataFrame:
    req = normalise_optional(req, _KEYS)
    req = _date_window(req.select("request_id", *_KEYS,
                                  F.col("start_date").cast("date").alias("start_date"),
                                  F.col("end_date").cast("date").alias("end_date")), as_of)
    return pattern_keys(req, _KEYS)


def advice_harvests(req: DataFrame, harvests: DataFrame, as_of, k: int = 5) -> DataFrame:
    """H2 section 1: latest harvests per request (T1), any mix of farm /
    product / date filters. Each harvest row is expanded once into the four
    filter patterns it can answer (farm+product, farm, product, none), so
    every presence group shares one pipeline; patterns that no request
    carries are dropped before anything is shuffled."""
    req = _advice_requests(req, as_of).select("request_id", *_PKEYS, "lo", "hi")
    out = ["harvest_date", "harvested_quantity_kg", "quality_score", "quality_notes"]
    facts = requested(expand_optional(harvests.select(*_KEYS, "harvest_id", *out), _KEYS), req, _PKEYS)
    return _topk_in_window(req, facts, _PKEYS, "harvest_date", "harvest_id", out,
                           k).drop("harvest_id")


def advice_qc_issues(req: DataFrame, issues: DataFrame, as_of, k: int = 5) -> DataFrame:
    """H2 section 2: latest QC issues per request (T2). With a product
    filter, issues without a product (farm-wide) match too (P4): such issues
    carry the product key 'general', and a request for product p asks for
    both p and 'general' - equi joins only, merged by the final re-rank."""
    req = _advice_requests(req, as_of)
    req = req.withColumn("_p_product_id", F.explode(
        F.when(F.col("product_id").isNotNull(),
               F.array(F.col("_p_product_id"), F.lit(_ANY_PRODUCT)))
        .otherwise(F.array(F.col("_p_product_id")))))
    out = ["issue_date", "issue_type", "severity", "notes"]
    facts = issues.select("farm_id", F.coalesce(F.col("product_id"), F.lit(_ANY_PRODUCT))
                          .alias("product_id"), "issue_id", *out)
    facts = requested(expand_optional(facts, _KEYS), req, _PKEYS)
    return _topk_in_window(req.select("request_id", *_PKEYS, "lo", "hi"), facts, _PKEYS,
                           "issue_date", "issue_id", out, k).drop("issue_id")


def advice_schedules(req: DataFrame, schedules: DataFrame, as_of, k: int = 5) -> DataFrame:
    """H2 section 3: next schedules (planned harvest on/after ``as_of``),
    earliest planting first, ties by every projected column (T3).

    Schedules are expanded into their four filter patterns and cut to the
    top k per pattern key, those of patterns that a request carries. The
    no-filter pattern holds every row, so its top k is taken per salt first:
    no task meets more than k rows of it per map task and salt. Each request then
    equi-joins the k rows of its own pattern. The join side is at most k rows per key, so a
    hot key (e.g. every request without filters) meets a tiny side that AQE
    broadcasts or splits."""
    out = ["planned_planting_date", "planned_harvest_date_estimate",
           "expected_yield_estimate_kg", "status"]
    order = [F.col(c).asc_nulls_first() for c in out]
    future = schedules.filter(F.col("planned_harvest_date_estimate") >= _date(as_of)) \
        .select(*_KEYS, *out)
    r = pattern_keys(normalise_optional(req, _KEYS), _KEYS).select("request_id", *_PKEYS)
    facts = requested(expand_optional(future, _KEYS), r, _PKEYS)
    no_filter = (F.col("_p_farm_id") == ANY_KEY) & (F.col("_p_product_id") == ANY_KEY)
    salted = facts.withColumn("_salt", F.when(no_filter, F.pmod(F.xxhash64(*_KEYS, *out), F.lit(SALTS))).otherwise(0))
    top = topk(topk(salted, [*_PKEYS, "_salt"], order, k).drop("rank"), _PKEYS, order, k).select(*_PKEYS, *out, "rank")
    return r.join(top, _PKEYS).select("request_id", *out, "rank")


def advice_farm_profile(req: DataFrame, farms: DataFrame) -> DataFrame:
    """H2 section 4: the farm's profile, only for requests naming a farm
    (first row per farm id, T8)."""
    req = normalise_optional(req, ["farm_id"])
    prof = topk(farms.select("farm_id", "farm_name", "farm_location", "primary_crops_grown"),
                ["farm_id"], [F.col("farm_name").asc()], 1).drop("rank")
    return (req.filter(F.col("farm_id").isNotNull()).select("request_id", "farm_id")
            .join(prof, "farm_id")
            .select("request_id", "farm_name", "farm_location", "primary_crops_grown"))


# --------------------------------------------------------------------- H4
def pickup_feasibility(req: DataFrame, harvests: DataFrame) -> DataFrame:
    """H4: a pickup is feasible when the farm harvested at least the asked
    kilograms of the product on or after ``requested_date - 7`` (no upper
    bound, as in the reference). Date and quantity may be text; a request with
    a missing field, a bad date or a bad quantity gets one row with status
    'error' and the first failing check's message.

    Harvests are summed per (farm, product, day) first. Distinct request
    thresholds are merged into the same per-(farm, product) stream, sorted
    by day descending with harvest days before thresholds of the same day;
    a running sum then gives, at each threshold, the kilograms harvested on
    or after it. One window pass per key over at most (days + distinct
    thresholds) rows - no range join, no per-request scan.
    """
    keys = ["farm_id", "product_id"]
    fields = [*keys, "quantity_kg", "requested_date"]
    r = req.select("request_id", *keys,
                   missing_fields(fields, {f: F.col(f) for f in fields}, req).alias("_miss"),
                   parse_date("requested_date").alias("_d"), parse_int("quantity_kg").alias("_q")) \
        .withColumn("t", F.date_sub("_d", PICKUP_WINDOW_DAYS))
    daily = (requested(harvests, r, keys).groupBy(*keys, F.col("harvest_date").alias("d"))
             .agg(F.sum("harvested_quantity_kg").alias("kg"))
             .withColumn("side", F.lit(1)))
    thr = (r.select(*keys, F.col("t").alias("d")).distinct()
           .withColumn("kg", F.lit(None).cast("bigint")).withColumn("side", F.lit(0)))
    w = (Window.partitionBy(*keys).orderBy(F.col("d").desc(), F.col("side").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    avail = (daily.unionByName(thr)
             .withColumn("avail", F.sum(F.coalesce(F.col("kg"), F.lit(0))).over(w))
             .filter(F.col("side") == 0)
             .select(*keys, F.col("d").alias("t"), "avail"))
    out = r.join(avail, keys + ["t"], "left")
    available = F.coalesce(F.col("avail"), F.lit(0)).cast("bigint")
    q = F.col("_q")
    error = (F.when(F.size("_miss") > 0, required_message("_miss"))
             .when(F.col("_d").isNull(), F.lit("Invalid requested_date format. Expected YYYY-MM-DD."))
             .when(q.isNull(), F.lit("Invalid format for quantity_kg. Expected integer.")))
    ok = error.isNull() & (available >= q)
    msg_no = F.concat(F.lit("Unable to schedule pickup for "), q.cast("string"),
                      F.lit(" kg. Only found approximately "), available.cast("string"),
                      F.lit(" kg recently harvested or on hand for this product at this farm. "
                            "Please adjust quantity or date."))
    return out.select("request_id",
                      F.when(error.isNotNull(), "error").when(ok, "success")
                      .otherwise("unavailable").alias("status"),
                      F.when(error.isNull(), available).alias("available_kg"),
                      F.when(ok, q).alias("confirmed_quantity_kg"),
                      F.coalesce(error, F.when(ok, F.lit(MSG_PICKUP_OK)).otherwise(msg_no))
                      .alias("message"))
