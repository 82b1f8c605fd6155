"""Shared vocabulary of run-history analytics.

``runs``: one row per executed node: run_id, execution_id, flow_id, node_id,
node_type, status, check_type, check_name, dataset, source_id, column_name,
columns (array), pass_rate, threshold_pass, rows_scanned, rows_failed,
duration_seconds, created_at.
``executions``: execution_id, flow_id, status, started_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of a dimension in an overall score; others weigh 0.10.
DIMENSION_WEIGHTS = {
    "completeness": 0.25,
    "validity": 0.20,
    "uniqueness": 0.20,
    "consistency": 0.15,
    "timeliness": 0.10,
    "accuracy": 0.10,
}
OTHER_WEIGHT = 0.10

# Grouping of check types in the dimensional breakdown.
DIMENSION_GROUPS = {
    "completeness": "structural",
    "uniqueness": "structural",
    "consistency": "structural",
    "validity": "semantic",
    "conformity": "semantic",
    "accuracy": "semantic",
    "business_rule": "semantic",
    "distribution": "statistical",
    "outliers": "statistical",
    "patterns": "statistical",
}


def lookup(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def weight(check_type: Column) -> Column:
    return lookup(check_type, DIMENSION_WEIGHTS, OTHER_WEIGHT)


def health(score: Column) -> Column:
    return F.when(score >= 95, "healthy").when(score >= 80, "warning").otherwise("critical")


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"INTERVAL '{days}' DAY")


def finished_checks(runs: DataFrame) -> DataFrame:
    return runs.where((F.col("node_type") == "check")
                      & F.col("status").isin("completed", "failed"))


def within(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return df.where((F.col(ts) >= days_before(as_of, days)) & (F.col(ts) <= as_of))


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, 0 of nothing."""
    percent = F.try_divide(F.lit(100.0) * part, whole.cast("double"))
    return F.coalesce(F.round(percent, digits), F.lit(0.0))


def mean_where(cond: Column, value: Column) -> Column:
    return F.avg(F.when(cond, value))
