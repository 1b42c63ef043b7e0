"""Physical-plan summaries: what a query will shuffle, join and push down.

``plan_summary(df)`` reads the formatted plan (nothing is executed) and
counts the operators that decide cost at scale.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

COUNTED = ("Exchange (", "BroadcastExchange", "ReusedExchange", "SortMergeJoin", "BroadcastHashJoin",
           "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "WindowGroupLimit",
           "Window ", "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Expand",
           "Generate", "Subquery", "Scan parquet")


def formatted_plan(df: DataFrame) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def plan_summary(df: DataFrame) -> dict:
    text = formatted_plan(df)
    head = text.split("\n\n\n")[0]  # the operator tree, before per-node details
    counts = {k.strip(" ("): head.count(k) for k in COUNTED}
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", text)))
    return {"counts": {k: v for k, v in counts.items() if v},
            "pushed_filters": pushed}


def shuffled_rows(df: DataFrame) -> int:
    """Rows written to shuffles by a run of ``df`` (collected here), from the
    metrics of the plan that ran; reused exchanges count once."""
    df.collect()
    seen, total = set(), 0

    def walk(node):
        nonlocal total
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        if name == "Exchange" and node.id() not in seen:
            seen.add(node.id())
            total += node.metrics().apply("shuffleRecordsWritten").value()
        subqueries = node.subqueries()
        for kids in (node.children(), subqueries):
            for i in range(kids.size()):
                walk(kids.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return total
