"""Inventory, maturity and daily snapshots of the checked estate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.relations import count_rows
from veritab.history.common import days_before, finished_checks, share

# Check types that count as standard.
STANDARD_DIMENSIONS = (
    "completeness", "validity", "uniqueness", "consistency", "timeliness", "accuracy",
    "conformity", "reconciliation",
)


def _beside(frames: list[DataFrame]) -> DataFrame:
    """One-row frames side by side."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def _zero(col: Column, digits: int = 1) -> Column:
    return F.coalesce(F.round(col, digits), F.lit(0.0))


def inventory(runs: DataFrame, executions: DataFrame, flows: DataFrame, datasets: DataFrame,
              as_of: Column) -> DataFrame:
    """KQI-001 to KQI-010 as one row."""
    recent = F.col("created_at") >= days_before(as_of, 1)
    analysed = finished_checks(runs).agg(
        F.count_distinct("dataset").alias("datasets_analyzed"),
        F.count_distinct(F.when(recent, F.col("dataset"))).alias("datasets_analyzed_24h"))
    # The flow failed last if any execution at its latest start did.
    last = executions.groupBy("flow_id").agg(F.max(F.struct(
        "started_at", (F.col("status") == "failed").alias("failed"))).alias("last"))
    per_flow = runs.groupBy("flow_id").agg(
        F.count_distinct(F.when(F.col("node_type").isin("check", "source"), F.col("dataset")))
        .alias("datasets"),
        F.count_distinct(F.when(F.col("node_type") == "check", F.col("node_id"))).alias("checks"))
    row = _beside([
        datasets.agg(F.count("*").alias("total_datasets")), analysed,
        flows.agg(F.count("*").alias("total_flows"),
                  count_rows(F.col("status") == "active").alias("active_flows"),
                  count_rows(F.col("status") == "inactive").alias("paused_flows")),
        last.agg(count_rows(F.col("last.failed")).alias("failed_flows")),
        per_flow.agg(_zero(F.avg("datasets")).alias("avg_datasets_per_flow"),
                     _zero(F.avg(F.when(F.col("checks") > 0, F.col("checks"))))
                     .alias("avg_checks_per_flow")),
    ])
    total, seen = F.col("total_datasets"), F.col("datasets_analyzed")
    return row.withColumns({
        "datasets_analyzed_pct": F.least(share(seen, total), F.lit(100.0)),
        "datasets_without_flows": F.greatest(total - seen, F.lit(0)),
        "active_flows_pct": share(F.col("active_flows"), F.col("total_flows")),
    })


def checks_by_dimension(runs: DataFrame) -> DataFrame:
    """Distinct checks (flow and node) per check type."""
    return runs.where((F.col("node_type") == "check") & F.col("check_type").isNotNull()).groupBy(
        F.col("check_type").alias("dimension")).agg(
        F.count_distinct("flow_id", "node_id").alias("checks"))


def check_inventory(runs: DataFrame) -> DataFrame:
    total = runs.where(F.col("node_type") == "check").agg(
        F.count_distinct("flow_id", "node_id").alias("total_checks"))
    standard = checks_by_dimension(runs).agg(F.coalesce(F.sum(F.when(
        F.col("dimension").isin(*STANDARD_DIMENSIONS), F.col("checks"))), F.lit(0))
        .alias("standard_checks"))
    return _beside([total, standard]).withColumns({
        "custom_checks": F.greatest(F.col("total_checks") - F.col("standard_checks"), F.lit(0)),
        "standard_checks_pct": share(F.col("standard_checks"), F.col("total_checks")),
    })


def maturity(runs: DataFrame, datasets: DataFrame, sla_definitions: DataFrame) -> DataFrame:
    """Governance shares. ``datasets``: dataset, owner, criticality, domain."""
    def filled(name: str) -> Column:
        return count_rows(F.col(name).isNotNull() & (F.col(name) != "")).alias(name)

    checks = runs.where(F.col("node_type") == "check")
    row = _beside([
        datasets.agg(F.count("*").alias("n"), *[filled(c) for c in ("owner", "criticality", "domain")]),
        checks.agg(
            F.count_distinct(F.when(F.col("threshold_pass").isNotNull(), F.col("dataset")))
            .alias("guarded"),
            F.count_distinct("flow_id", "node_id").alias("checks")),
        sla_definitions.agg(F.count("*").alias("slas")),
    ])
    n, cap = F.col("n"), F.lit(100.0)
    return row.select(
        share(F.col("owner"), n).alias("datasets_with_owner_pct"),
        share(F.col("criticality"), n).alias("datasets_with_criticality_pct"),
        share(F.col("domain"), n).alias("datasets_with_domain_pct"),
        F.least(share(F.col("guarded"), n), cap).alias("datasets_with_thresholds_pct"),
        F.least(share(F.col("slas"), F.greatest(F.col("checks"), F.lit(1))), cap)
        .alias("checks_with_sla_pct"))


def coverage_trend(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Distinct datasets, executions and checks per day."""
    start = F.date_sub(F.to_date(as_of), days)
    return runs.where((F.col("node_type") == "check") & (F.to_date("created_at") >= start)).groupBy(
        F.to_date("created_at").alias("day")).agg(
        F.count_distinct("dataset").alias("datasets"),
        F.count_distinct("execution_id").alias("flows"),
        F.count_distinct("flow_id", "node_id").alias("checks"))


def daily_snapshot(runs: DataFrame) -> DataFrame:
    """``kqi_id, value, snapshot_date`` rows to append to a snapshot table."""
    # Identifiers of the snapshotted indicators.
    series = {"KQI-002": F.count_distinct("dataset"), "KQI-005": F.count_distinct("flow_id"),
              "KQI-011": F.count_distinct("flow_id", "node_id")}
    per_day = finished_checks(runs).groupBy(F.to_date("created_at").alias("snapshot_date")).agg(
        *[agg.cast("double").alias(name) for name, agg in series.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("kqi_id"), F.col(f"`{n}`").alias("value"))
                      for n in series])
    return per_day.select("snapshot_date", F.inline(cells))


def snapshot_trend(snapshots: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Coverage trend read back from snapshots."""
    recent = snapshots.where(F.col("snapshot_date") >= F.date_sub(F.to_date(as_of), days))

    def pick(kqi: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("kqi_id") == kqi, F.col("value"))), F.lit(0.0)).cast("long")

    return recent.groupBy(F.col("snapshot_date").alias("day")).agg(
        pick("KQI-002").alias("datasets"), pick("KQI-005").alias("flows"),
        pick("KQI-011").alias("checks"))
