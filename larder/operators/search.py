"""Catalogue search and lookups.

A search request is ``%q%`` matched case-insensitively (``LIKE``, so '%' and
'_' in ``q`` stay live wildcards) against one or two text columns. Pattern x
text is inherently a non-equi problem; to keep it an equi join at any size:

1. Every text is indexed by its distinct 1-, 2- and 3-grams (lower case).
2. Each literal fragment of a distinct pattern picks one gram: among its
   n-grams (n = min(3, its length)) the one that occurs in the fewest texts
   (gram frequencies are bounded by the alphabet). A text matching the pattern
   contains every fragment, hence all these grams.
3. The posting lists of a pattern's grams are intersected: the lists join the
   patterns on gram, and a text stays that stands in all of them. A list more
   than ``LIST_RATIO`` times as long as the pattern's shortest is left out, as
   reading it costs more than it can cut, so a pattern reads a bounded multiple
   of its shortest list and verifies at most that list. ``LIKE`` verifies each
   candidate. Nothing is capped; the answer is exact.
4. Patterns with no literal character ('%', '_', '%_%') match texts with at
   least as many characters as the pattern has '_': an equi join on length.

An empty or null query browses: the first 100 rows by id, a bounded table
attached by broadcast. A backslash in the query is rejected before the join
(Spark's LIKE treats it as an escape and would raise); ``search_rejects``
returns such requests with their error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.common import attach_bounded, present, requested, topk

BROWSE_LIMIT = 100
SEARCH_LIMIT = 100
MAX_GRAM = 3
#: A posting list is intersected when it is at most this many times as long as the pattern's shortest.
LIST_RATIO = 8


def _grams(text: Column, n: int) -> Column:
    """Array of the n-grams of ``text`` (caller guarantees length >= n)."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - F.lit(n - 1)),
                       lambda i: text.substr(i, F.lit(n)))


def _all_grams(text: Column) -> Column:
    """Distinct 1..3-grams of a lower-cased text."""
    parts = [F.when(F.length(text) >= n, _grams(text, n)).otherwise(F.array().cast("array<string>"))
             for n in range(1, MAX_GRAM + 1)]
    return F.array_distinct(F.concat(*parts))


def _fragments(p: Column) -> Column:
    """Distinct literal fragments of a pattern; null when it has none."""
    frags = F.array_distinct(F.filter(F.split(p, "[%_]"), lambda f: F.length(f) > 0))
    return F.when(F.size(frags) > 0, frags)


def _longest_grams(text: Column) -> Column:
    """Distinct n-grams of a fragment, n = min(3, its length)."""
    n = F.least(F.length(text), F.lit(MAX_GRAM))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: text.substr(i, n)))


def candidates(pats: DataFrame, idx: DataFrame, id_col: str) -> DataFrame:
    """(pattern, id) of the texts in all posting lists that a pattern reads.
    ``pats``: pattern, fragments; ``idx``: id, gram, one row per distinct pair."""
    freq = idx.groupBy("gram").agg(F.count("*").alias("df"))  # bounded by the alphabet
    frags = pats.select("pattern", F.size("fragments").alias("n"), F.posexplode("fragments").alias("f", "text"))
    rarest = topk(frags.select("pattern", "n", "f", F.explode(_longest_grams(F.col("text"))).alias("gram"))
                  .join(freq, "gram"), ["pattern", "f"], [F.col("df").asc(), F.col("gram").asc()], 1)
    whole = Window.partitionBy("pattern")
    # a pattern with a fragment whose grams occur nowhere can't match and drops out here
    chosen = (rarest.withColumn("found", F.count("*").over(whole)).withColumn("least", F.min("df").over(whole))
              .filter((F.col("found") == F.col("n")) & (F.col("df") <= LIST_RATIO * F.col("least")))
              .select("pattern", "gram").distinct())
    chosen = chosen.withColumn("lists", F.count("*").over(whole))
    # dealt by text once: the intersection and the join of the text share it
    return (chosen.join(idx, "gram").select("pattern", "lists", id_col).repartition(id_col)
            .groupBy(id_col, "pattern", "lists").agg(F.count("*").alias("hits"))
            .filter("hits = lists").select("pattern", id_col))


def search_text(req: DataFrame, texts: DataFrame, id_col: str, search_cols: Sequence[str],
                out_cols: Sequence[str], limit: int | None) -> DataFrame:
    """Rows of ``texts`` whose any ``search_cols`` matches ``%query%``
    (case-insensitive), per request; at most ``limit`` per request ordered
    by ``id_col`` (all matches when ``limit`` is None). Requests with an
    empty query get the first ``BROWSE_LIMIT`` rows by id."""
    req = req.select("request_id", F.nullif(F.col("query"), F.lit("")).alias("query"))
    searching = req.filter(F.col("query").isNotNull() & ~F.col("query").contains("\\"))
    browsing = req.filter(F.col("query").isNull())
    t = texts.select(*dict.fromkeys([id_col, *out_cols, *search_cols]))

    # distinct patterns
    pats = searching.select(F.lower(F.concat(F.lit("%"), F.col("query"), F.lit("%")))
                            .alias("pattern")).distinct()
    pats = pats.withColumn("fragments", _fragments(F.col("pattern")))

    # gram index of the texts, only grams that some pattern may use
    lowered = [F.coalesce(F.lower(F.col(c)), F.lit("")) for c in search_cols]
    used = pats.select(F.explode("fragments").alias("f")).select(F.explode(_longest_grams(F.col("f"))).alias("gram")).distinct()
    idx = t.select(id_col, F.explode(F.array_distinct(F.flatten(F.array(
        *[_all_grams(x) for x in lowered])))).alias("gram")).join(used, "gram", "left_semi")
    cand = candidates(pats, idx, id_col)

    # wildcard-only patterns: equi join on text length
    wild = pats.filter(F.col("fragments").isNull()).select(
        "pattern", (F.length("pattern") - F.length(F.regexp_replace("pattern", "_", "")))
        .alias("need"))
    max_need = wild.agg(F.max("need").alias("m")).select("m").scalar()
    longest = F.greatest(*[F.length(x) for x in lowered]) if len(lowered) > 1 \
        else F.length(lowered[0])
    by_len = t.select(id_col, F.explode(F.when(  # no such pattern: no text is exploded
        max_need.isNotNull(), F.sequence(F.lit(0), F.least(longest, max_need)))).alias("need"))
    cand = cand.unionByName(wild.join(by_len, "need").select("pattern", id_col))

    matched = cand.join(t, id_col).filter(
        _any_like([F.lower(F.col(c)) for c in search_cols], F.col("pattern")))
    per_pattern = (topk(matched, ["pattern"], [F.col(id_col).asc()], limit)
                   if limit is not None else matched)
    found = (searching.select("request_id", F.lower(F.concat(F.lit("%"), F.col("query"),
                                                              F.lit("%"))).alias("pattern"))
             .join(per_pattern, "pattern").drop("pattern"))

    browse = topk(t.withColumn("_g", F.lit(0)), ["_g"], [F.col(id_col).asc()],
                  BROWSE_LIMIT).drop("_g")  # bounded: BROWSE_LIMIT rows
    shown = attach_bounded(browsing.select("request_id"),
                           browse.select("rank", *dict.fromkeys([id_col, *out_cols])), "rank")
    cols = ["request_id", *dict.fromkeys([id_col, *out_cols])]
    if limit is not None:
        cols.append("rank")
    return found.select(*cols).unionByName(shown.select(*cols))


def _any_like(cols: list[Column], pattern: Column) -> Column:
    cond = None
    for c in cols:
        e = F.coalesce(F.like(c, pattern), F.lit(False))
        cond = e if cond is None else cond | e
    return cond


def search_rejects(req: DataFrame) -> DataFrame:
    """Search requests that can't be answered, one row each with its error:
    those whose query holds a backslash."""
    return req.filter(F.col("query").contains("\\")).select(
        "request_id", "query", F.lit("invalid_query").alias("error_code"),
        F.lit("A search query must not contain a backslash.").alias("error_message"))


# ------------------------------------------------------------ H15 - H17
def farm_search(req: DataFrame, farms: DataFrame) -> DataFrame:
    """Farms whose name or location contains the query; <= 100 each."""
    return search_text(req, farms, "farm_id", ["farm_name", "farm_location"],
                       ["farm_id", "farm_name", "farm_location", "supplier_name"], SEARCH_LIMIT)


def product_search(req: DataFrame, products: DataFrame) -> DataFrame:
    """Products whose name contains the query; every match (no limit
    when searching, 100 when browsing)."""
    return search_text(req, products, "product_id", ["product_name"],
                       ["product_id", "product_name", "category", "storage_requirements"], None)


def customer_search(req: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers whose name contains the query; <= 100 each."""
    return search_text(req, customers, "customer_id", ["customer_name"],
                       ["customer_id", "customer_name", "customer_type", "shipping_address"],
                       SEARCH_LIMIT)


def browse_first(table: DataFrame, id_col: str, cols: Sequence[str],
                 limit: int = BROWSE_LIMIT) -> DataFrame:
    """The first ``limit`` rows by id (a top-k report)."""
    return topk(table.select(*cols).withColumn("_g", F.lit(0)), ["_g"],
                [F.col(id_col).asc()], limit).drop("_g")


# -------------------------------------------------------------------- H18
VEHICLE_COLS = ["vehicle_id", "carrier_name", "vehicle_type", "capacity_kg",
                "has_temperature_monitoring", "vehicle_license_no"]


NO_LICENSE = "Missing or empty vehicle_license_no in request body"


def vehicle_by_license(req: DataFrame, vehicles: DataFrame) -> DataFrame:
    """The vehicle with the exact licence number (first by id when the
    licence repeats); unknown licences keep a row with ``found`` false and
    status 'not_found'. A request without a licence, or with an empty one, is
    an error with a message (F1)."""
    v = topk(requested(vehicles.select(*VEHICLE_COLS), req, ["vehicle_license_no"]), ["vehicle_license_no"],
             [F.col("vehicle_id").asc()], 1).drop("rank")
    v = v.withColumnRenamed("vehicle_license_no", "_lic")
    named = present("vehicle_license_no")
    out = req.select("request_id", "vehicle_license_no", named.alias("_asked")).join(
        v, F.col("_asked") == F.col("_lic"), "left")
    found = F.col("_lic").isNotNull()
    return out.select("request_id", *[c for c in VEHICLE_COLS], found.alias("found"),
                      F.when(F.col("_asked").isNull(), "error").when(found, "success")
                      .otherwise("not_found").alias("status"),
                      F.when(F.col("_asked").isNull(), NO_LICENSE).alias("message"))


def vehicle_details(req: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Type, capacity, cold-chain equipment and carrier of the
    requested vehicle id (first row per id); ``found`` false when unknown or
    when the request names no vehicle."""
    v = topk(requested(vehicles, req, ["vehicle_id"])
             .select("vehicle_id", "vehicle_type", "capacity_kg", "has_temperature_monitoring",
                     "carrier_name"), ["vehicle_id"], [F.col("capacity_kg").asc()], 1).drop("rank") \
        .withColumnRenamed("vehicle_id", "_vid")
    out = req.select("request_id", "vehicle_id").join(
        v, F.col("vehicle_id") == F.col("_vid"), "left")
    return out.select("request_id", "vehicle_id", "vehicle_type", "capacity_kg",
                      "has_temperature_monitoring", "carrier_name",
                      F.col("_vid").isNotNull().alias("found"))
