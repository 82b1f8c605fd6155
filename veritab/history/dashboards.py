"""Scores and breakdowns over the check runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.relations import count_rows
from veritab.history.common import (
    DIMENSION_GROUPS, DIMENSION_WEIGHTS, days_before, finished_checks, health, lookup,
    mean_where, weight, within,
)


def overview(runs: DataFrame, flows: DataFrame) -> DataFrame:
    rate = F.col("pass_rate")
    checks = finished_checks(runs).agg(
        F.count("*").alias("total_executions"),
        F.round(F.coalesce(F.avg(rate), F.lit(0.0)), 2).alias("average_pass_rate"),
        count_rows(rate < 80).alias("critical_violations"))
    return checks.crossJoin(F.broadcast(flows.agg(F.count("*").alias("total_flows")))).withColumn(
        "dq_score", F.col("average_pass_rate"))


def pass_rate_trend(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Daily mean pass rate; the score trend is the same series."""
    return within(finished_checks(runs), "created_at", as_of, days).groupBy(
        F.to_date("created_at").alias("day")).agg(F.round(F.avg("pass_rate"), 2).alias("value"))


def execution_trend(executions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return within(executions, "started_at", as_of, days).groupBy(
        F.to_date("started_at").alias("day")).agg(F.count("*").alias("value"))


def by_category(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Per weighted dimension. Flows count over all time, the rest in the period."""
    checks = runs.where((F.col("node_type") == "check")
                        & F.col("check_type").isin(*DIMENSION_WEIGHTS))
    recent = (F.col("status").isin("completed", "failed")
              & (F.col("created_at") >= days_before(as_of, days)) & (F.col("created_at") <= as_of))
    return checks.groupBy(F.col("check_type").alias("category")).agg(
        F.count_distinct("flow_id").alias("total_rules"),
        count_rows(recent).alias("total_executions"),
        F.round(mean_where(recent, F.col("pass_rate")), 2).alias("pass_rate"),
        F.round(mean_where(recent, F.col("duration_seconds")), 2).alias("avg_execution_time"),
    ).where(F.col("total_executions") > 0)


def by_source(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    checks = within(finished_checks(runs), "created_at", as_of, days)
    rate = F.avg("pass_rate")
    return checks.groupBy("source_id").agg(
        F.count_distinct("flow_id").alias("total_rules"), F.count("*").alias("total_executions"),
        F.round(rate, 2).alias("pass_rate"), F.max("created_at").alias("last_execution"),
        health(rate).alias("health_status"))


def _trend(now: Column, before: Column, step: float = 1.0) -> Column:
    return (F.when(now - before > step, "up").when(now - before < -step, "down")
            .otherwise("stable"))


def _two_periods(runs: DataFrame, as_of: Column, days: int) -> tuple[DataFrame, Column, Column]:
    start = days_before(as_of, days)
    ts = F.col("created_at")
    checks = finished_checks(runs).where((ts >= days_before(as_of, 2 * days)) & (ts <= as_of))
    return checks, ts >= start, ts < start


def scorecard(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Score per dimension with its trend against the period before, in one scan."""
    checks, now, before = _two_periods(runs, as_of, days)
    rate = F.col("pass_rate")
    scored = checks.where(F.col("check_type").isin(*DIMENSION_WEIGHTS)).groupBy(
        F.col("check_type").alias("dimension")).agg(
        count_rows(now).alias("n"), F.round(mean_where(now, rate), 2).alias("score"),
        mean_where(before, rate).alias("prev")).where(F.col("n") > 0)
    issues = F.col("n") - F.floor(F.col("n") * F.col("score") / 100)
    return scored.select(
        "dimension", "score", weight(F.col("dimension")).alias("weight"),
        issues.alias("issues_count"), _trend(F.col("score"), F.col("prev")).alias("trend"))


def scorecard_total(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """The weighted overall score with its issues and trend."""
    checks, _, before = _two_periods(runs, as_of, days)
    previous = checks.agg(mean_where(before, F.col("pass_rate")).alias("prev"))
    parts = scorecard(runs, as_of, days)
    w = F.col("weight")
    total = parts.agg(
        F.coalesce(F.sum(F.col("score") * w) / F.sum(w), F.lit(0.0)).alias("raw"),
        F.coalesce(F.sum("issues_count"), F.lit(0)).alias("total_issues"),
        F.coalesce(F.sum(F.when(F.col("score") < 80, F.col("issues_count"))), F.lit(0))
        .alias("critical_issues"))
    return total.crossJoin(F.broadcast(previous)).select(
        F.round("raw", 2).alias("overall_score"), "total_issues", "critical_issues",
        _trend(F.col("raw"), F.col("prev")).alias("trend"))


def by_column(runs: DataFrame) -> DataFrame:
    """Per checked column, for ordering worst first."""
    rate = F.avg("pass_rate")
    return finished_checks(runs).select(
        F.explode("columns").alias("column_name"), "pass_rate", "rows_scanned", "rows_failed",
    ).groupBy("column_name").agg(
        F.count("*").alias("check_count"), F.round(rate, 2).alias("avg_pass_rate"),
        F.sum("rows_scanned").alias("total_rows_scanned"),
        F.sum("rows_failed").alias("total_rows_failed"), health(rate).alias("status"))


def by_dimension_group(runs: DataFrame) -> DataFrame:
    """Structural, semantic and statistical roll-up with the check types below.

    ``check_type`` is NULL on the roll-up rows; a group without runs scores 0.
    """
    checks = finished_checks(runs).withColumn("check_type", F.coalesce("check_type", F.lit("unknown")))
    grouped = checks.withColumn(
        "dimension", lookup(F.col("check_type"), DIMENSION_GROUPS, "structural"))
    counted = grouped.rollup("dimension", "check_type").agg(
        F.count("*").alias("check_count"), F.avg("pass_rate").alias("rate"),
        F.sum("rows_scanned").alias("total_rows_scanned"),
        F.sum("rows_failed").alias("total_rows_failed")).where(F.col("dimension").isNotNull())
    names = sorted(set(DIMENSION_GROUPS.values()))
    known = runs.sparkSession.createDataFrame([(n, None) for n in names],
                                              "dimension string, check_type string")
    absent = known.join(counted.select("dimension").distinct(), "dimension", "left_anti").select(
        "dimension", "check_type", F.lit(0).cast("long").alias("check_count"),
        F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("total_rows_scanned"),
        F.lit(0).cast("long").alias("total_rows_failed"))
    return counted.unionByName(absent).select(
        "dimension", "check_type", "check_count", F.round("rate", 2).alias("avg_pass_rate"),
        "total_rows_scanned", "total_rows_failed",
        F.when(F.col("check_type").isNull(), health(F.col("rate"))).alias("status"))


# --- quality of single datasets ---------------------------------------------

def dataset_scores(runs: DataFrame) -> DataFrame:
    """Mean pass rate per dataset and dimension."""
    return finished_checks(runs).where(F.col("pass_rate").isNotNull()).groupBy(
        "dataset", F.lower("check_type").alias("dimension")).agg(
        F.round(F.avg("pass_rate"), 1).alias("score"))


def dataset_overall(runs: DataFrame) -> DataFrame:
    w = weight(F.col("dimension"))
    return dataset_scores(runs).groupBy("dataset").agg(
        # Rounding twice keeps the order of summation out of the last digit.
        F.round(F.round(F.sum(F.col("score") * w) / F.sum(w), 6), 1).alias("overall_score"),
        F.count("*").alias("dimensions"))


def worst_check(runs: DataFrame) -> DataFrame:
    """Per dataset the check with the lowest mean pass rate, ties by name."""
    means = finished_checks(runs).where(F.col("pass_rate").isNotNull()).groupBy(
        "dataset", "check_name").agg(F.round(F.avg("pass_rate"), 6).alias("rate"))
    return means.groupBy("dataset").agg(F.min(F.struct("rate", "check_name")).alias("worst")).select(
        "dataset", F.col("worst.check_name").alias("check_name"),
        F.round("worst.rate", 1).alias("pass_rate"))


def unstable_column(runs: DataFrame) -> DataFrame:
    """Per dataset the column whose pass rate varies most, ties by name."""
    spread = finished_checks(runs).where(
        F.col("pass_rate").isNotNull() & F.col("column_name").isNotNull()).groupBy(
        "dataset", "column_name").agg(F.round(F.stddev_pop("pass_rate"), 6).alias("spread"))
    first = F.min(F.struct((-F.col("spread")).alias("order"), "column_name", "spread"))
    return spread.where(F.col("spread") > 0).groupBy("dataset").agg(first.alias("top")).select(
        "dataset", F.col("top.column_name").alias("column_name"),
        F.round("top.spread", 1).alias("variance"))


def days_since_healthy(runs: DataFrame, as_of: Column) -> DataFrame:
    """Whole days since all checks of an execution last passed (99.9 or better)."""
    healthy = finished_checks(runs).groupBy("dataset", "execution_id").agg(
        F.min("pass_rate").alias("lowest"), F.max("created_at").alias("at")).where(
        F.col("lowest") >= 99.9)
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(F.max("at"))
    return healthy.groupBy("dataset").agg(F.floor(seconds / 86400).alias("days_since_healthy"))


def column_coverage(runs: DataFrame, schema: DataFrame) -> DataFrame:
    """Checks per schema column, and as a share of the dataset's distinct checks.

    ``schema``: dataset, column_name.
    """
    checks = finished_checks(runs)
    totals = checks.groupBy("dataset").agg(F.count_distinct("node_id").alias("checks"))
    counts = checks.groupBy("dataset", "column_name").agg(F.count("*").alias("n"))
    joined = (schema.select("dataset", "column_name").distinct()
              .join(counts, ["dataset", "column_name"], "left").join(totals, "dataset", "left"))
    n = F.coalesce(F.col("n"), F.lit(0))
    percent = F.round(n * 100.0 / F.greatest(F.coalesce(F.col("checks"), F.lit(1)), F.lit(1)), 1)
    return joined.select("dataset", "column_name", n.alias("checks_count"),
                         F.least(percent, F.lit(100.0)).alias("coverage_pct"))


# --- execution report --------------------------------------------------------

def _passed() -> Column:
    return F.col("pass_rate") >= F.coalesce(F.col("threshold_pass"), F.lit(100.0))


def execution_report(runs: DataFrame) -> DataFrame:
    """One row per execution; its nodes and violations are separate frames."""
    check = F.col("node_type") == "check"
    counted = runs.groupBy("execution_id", "flow_id").agg(
        F.count("*").alias("total_nodes"), count_rows(F.col("status") == "failed").alias("nodes_failed"),
        count_rows(check).alias("total_checks"), count_rows(check & _passed()).alias("passed_checks"),
        F.coalesce(F.sum(F.when(check, F.col("rows_failed"))), F.lit(0)).alias("total_violations"),
        F.min("created_at").alias("executed_at"))
    score = F.try_divide(F.lit(100.0) * F.col("passed_checks"), F.col("total_checks").cast("double"))
    return counted.withColumn("overall_quality_score", F.round(score, 2))


def execution_nodes(runs: DataFrame) -> DataFrame:
    """The nodes of every execution in the order they ran, with times and result."""
    order = Window.partitionBy("execution_id").orderBy("created_at", "node_id")
    return runs.select(
        "execution_id", "node_id", "node_type", "status",
        F.row_number().over(order).alias("position"), F.col("created_at").alias("started_at"),
        F.timestamp_micros(F.unix_micros(F.col("created_at").cast("timestamp")) + F.col("duration_seconds") * 1_000_000)
        .alias("ended_at"), "duration_seconds",
        F.when(F.col("node_type") == "check", F.when(_passed(), "passed").otherwise("failed")).alias("result"))


def execution_violations(runs: DataFrame) -> DataFrame:
    """The failing checks of every execution."""
    failed, total = F.col("rows_failed"), F.col("rows_scanned")
    return runs.where((F.col("node_type") == "check") & (failed > 0)).select(
        "execution_id", "run_id", "node_id", "check_type", "column_name", "dataset",
        failed.alias("failed_rows"), total.alias("total_rows"),
        F.round(F.try_divide(F.lit(100.0) * failed, total.cast("double")), 2).alias("failure_rate"))
