"""Which checks earn their keep: effective, noisy, always passing or failing, duplicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.relations import count_rows
from veritab.history.common import days_before, finished_checks, share

# Thresholds of the classification.
NOISY_FLIP_RATE = 0.30
ALWAYS_PASSING_DAYS = 90
ALWAYS_PASSING_MIN_RUNS = 10
ALWAYS_FAILING_DAYS = 30
ALWAYS_FAILING_MIN_RUNS = 5
ALWAYS_FAILING_RATE = 0.90
MAX_RUNS_PER_CHECK = 30
DEFAULT_THRESHOLD = 80.0

# Advice shown for a problematic check.
RECOMMENDATIONS = {
    "noisy": "Review threshold or investigate data volatility causing frequent status flips.",
    "always_pass": "Consider tightening the threshold or removing if the check adds no value.",
    "always_fail": "Fix underlying data issue or reconfigure threshold. Persistent failures may mask new issues.",
    "duplicate": "Consolidate with similar check to reduce execution overhead.",
}


def classify(runs: DataFrame, as_of: Column) -> DataFrame:
    """One row per check (flow and node) with its class.

    Only the latest runs of a check count; the ranking keeps that many per task
    before anything is shuffled.
    """
    key = ["flow_id", "node_id"]
    recent = finished_checks(runs).where(
        F.col("created_at") >= days_before(as_of, ALWAYS_PASSING_DAYS))
    newest = Window.partitionBy(*key).orderBy(F.desc("created_at"), F.desc("run_id"))
    rate = F.coalesce(F.col("pass_rate"), F.lit(0.0))
    limit = F.coalesce(F.nullif(F.col("threshold_pass"), F.lit(0.0)), F.lit(DEFAULT_THRESHOLD))
    kept = recent.withColumn("nth", F.row_number().over(newest)).where(
        F.col("nth") <= MAX_RUNS_PER_CHECK)
    kept = kept.withColumns({
        "rate": rate, "ok": (F.col("status") == "completed") & (rate >= limit),
        "lately": F.col("created_at") >= days_before(as_of, ALWAYS_FAILING_DAYS)})
    kept = kept.withColumn("flip", F.col("ok") != F.lag("ok").over(newest))
    latest = F.max_by(F.struct("check_name", "check_type", "column_name", "created_at"),
                      F.struct("created_at", "run_id"))
    checks = kept.groupBy(*key).agg(
        F.count("*").alias("total_runs"), count_rows(F.col("ok")).alias("passes"),
        count_rows(F.col("flip")).alias("flips"), F.avg("rate").alias("mean_rate"),
        count_rows(F.col("lately")).alias("late_runs"),
        count_rows(F.col("lately") & ~F.col("ok")).alias("late_fails"),
        F.avg(F.when(F.col("lately"), F.col("rate"))).alias("late_rate"),
        latest.alias("meta"))
    checks = checks.select(*key, "total_runs", "passes", "flips", "mean_rate", "late_runs",
                           "late_fails", "late_rate", "meta.*")
    # Of the checks of one type on one column, the most recently run one stays.
    target = ["check_type", "column_name"]
    keeper = checks.where((F.col("check_type") != "") & (F.col("column_name") != "")).groupBy(
        *target).agg(F.max_by(F.struct(*key), F.struct("created_at", *key)).alias("keep"))
    checks = checks.join(keeper, target, "left")
    duplicate = F.col("keep").isNotNull() & (F.struct(*key) != F.col("keep"))
    total, passes = F.col("total_runs"), F.col("passes")
    flip_rate = F.try_divide(F.col("flips").cast("double"), total - 1)
    fail_rate = F.try_divide(F.col("late_fails").cast("double"), F.col("late_runs"))
    kind = (
        F.when(duplicate, "duplicate")
        .when((total >= ALWAYS_PASSING_MIN_RUNS) & (passes == total), "always_pass")
        .when((F.col("late_runs") >= ALWAYS_FAILING_MIN_RUNS) & (fail_rate >= ALWAYS_FAILING_RATE),
              "always_fail")
        .when(flip_rate > NOISY_FLIP_RATE, "noisy")
        .otherwise("effective"))
    shown = checks.withColumn("classification", kind)
    kind = F.col("classification")
    return shown.select(
        *key, "check_name", "check_type", "column_name", "total_runs", "classification",
        F.when(kind == "noisy", F.round(flip_rate, 2)).alias("flip_rate"),
        F.when(kind == "noisy", F.round("mean_rate", 1)).when(kind == "always_pass", 100.0)
        .when(kind == "always_fail", F.round("late_rate", 1)).alias("pass_rate_30d"))


def score(classified: DataFrame) -> DataFrame:
    """Share of effective checks and the distribution of classes."""
    def n(name: str) -> Column:
        return count_rows(F.col("classification") == name)

    counted = classified.agg(
        n("noisy").alias("noisy_checks_count"), n("always_pass").alias("always_passing_count"),
        n("always_fail").alias("always_failing_count"),
        n("duplicate").alias("duplicate_checks_count"), n("effective").alias("effective_count"),
        F.count("*").alias("total"))
    return counted.withColumn(
        "effectiveness_score", share(F.col("effective_count"), F.col("total"))).drop("total")


def problematic(classified: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of the checks worth attention, with advice."""
    order = {name: i for i, name in enumerate(RECOMMENDATIONS)}
    pairs = [F.lit(x) for item in RECOMMENDATIONS.items() for x in item]
    ranks = [F.lit(x) for item in order.items() for x in item]
    listed = classified.where(F.col("classification") != "effective").select(
        "flow_id", "node_id", "check_name", "classification", "flip_rate", "pass_rate_30d",
        F.create_map(*pairs)[F.col("classification")].alias("recommendation"))
    return (listed.orderBy(F.create_map(*ranks)[F.col("classification")], "flow_id", "node_id")
            .offset((page - 1) * page_size).limit(page_size))
