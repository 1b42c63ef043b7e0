"""Write PLANS.md: the physical-plan shape of every registered batch query
(operator counts from the formatted plan; nothing is executed).

    python explain_all.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Queries that run jobs when they are called.
RUNNING = {"alert_stream", "alert_producer_stream", "readings_append_stream", "alert_envelope_stream", "alert_sinks",
           "orders_stored", "order_destinations_bucketed", "customer_lookup"}

SCALE_NOTES = """## Scale review (1000x the data, one key holding a third of the rows)

| Family | Shuffle keys | Largest per-task unit | Broadcast |
|---|---|---|---|
| availability, stock, incoming, upcoming | product (partial aggregation first) | one product's aggregate row | AQE only |
| forecasts, price of a day, warehouse stock | request keys after an Expand of optional filters | k rows per key (WindowGroupLimit on both sides) | AQE only |
| advice sections | (pattern key, day); pattern key; (pattern key, window end) | 5 rows per key and day, distinct ends per key (calendar-bounded) | AQE only |
| pickup feasibility | (farm, product) | days + distinct thresholds of one key (calendar-bounded) | AQE only |
| as-of price, orders | product; request | price days + order days of one product (calendar-bounded) | AQE only |
| tracking, readings | shipment | 10 rows per shipment (WindowGroupLimit) | AQE only |
| search | gram; text | posting lists up to 8 times a pattern's shortest, intersected per text, verified by LIKE; 100 rows per pattern | none |
| destinations, coordinates | request, order; address texts without coordinates | one order; one address text | AQE only |
| route stops and headers | (route, 100k-leg chunk), (request, 100k-position block), (route, leg) | one chunk or block; the per-route totals table | AQE only |
| route legs fixture | (supplier, day) | one supplier-day | AQE only |
| streams | none (map-only) | one micro-batch partition | none |

No query plans a cartesian product or a nested-loop join (tests/test_plans.py). Explicit
broadcasts exist only for the 25-row nation and 5-row region tables; the bounded browse list
(LIMIT 100) is attached through a scalar subquery, not a join.
"""


def main(argv) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from larder.plans import catalog
    from larder.plans.explain import plan_summary
    from larder.session import build_session
    spark = build_session("local[8]", 16)
    lines = ["# PLANS", "",
             f"Physical-plan shape of every registered batch query on `{sf_dir}` "
             "(generated by `explain_all.py`; counts are operators in the plan tree, "
             "AQE may still coalesce partitions or switch a join to broadcast at run time).",
             "Queries that run jobs when called (streams, stored tables) are described in README.", "",
             "| Query | Shuffles | Joins | Top-k / windows | Aggregates | Other |",
             "|---|---|---|---|---|---|"]
    for name, fn in catalog.queries().items():
        if name in RUNNING:
            continue
        c = plan_summary(fn(spark, sf_dir))["counts"]
        shuffles = c.get("Exchange", 0)
        joins = ", ".join(f"{k} {v}" for k, v in c.items() if "Join" in k or "Cartesian" in k)
        wins = ", ".join(f"{k} {v}" for k, v in c.items() if k in ("WindowGroupLimit", "Window"))
        aggs = ", ".join(f"{k} {v}" for k, v in c.items() if "Aggregate" in k)
        other = ", ".join(f"{k} {v}" for k, v in c.items()
                          if k in ("Expand", "Generate", "Subquery", "BroadcastExchange",
                                   "ReusedExchange", "Scan parquet"))
        lines.append(f"| `{name}` | {shuffles} | {joins or '-'} | {wins or '-'} | "
                     f"{aggs or '-'} | {other or '-'} |")
    lines += ["", SCALE_NOTES]
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "PLANS.md"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
