"""How reliably the flows run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.predicates import epoch_micros
from veritab.functions.relations import count_rows
from veritab.history.common import finished_checks, share, within

# Longest stretch of one flow's history that is ordered in a single group.
CHUNK_SECONDS = 3600


def recovery_times(executions: DataFrame, by: str = "flow_id") -> DataFrame:
    """Per flow: how many failure streaks recovered, and the seconds that took.

    A streak starts at a failed execution that does not follow a failed one and
    ends at the next completed one. Starts and ends alternate, so the time in
    failure is the sum of the ends minus the sum of the starts that ended.

    History is ordered in chunks of an hour; chunks only hand on their last
    status, so a flow with very many executions is not ordered in one task.
    """
    events = executions.where(F.col("status").isin("failed", "completed")).select(
        F.col(by).alias("flow"), (F.col("status") == "failed").alias("bad"),
        epoch_micros(F.col("started_at")).cast("decimal(20,0)").alias("at"), "execution_id")
    events = events.withColumn("chunk", F.floor(F.col("at") / (CHUNK_SECONDS * 1_000_000)))
    # Sums of microseconds stay exact as decimals.
    zero = F.lit(0).cast("decimal(20,0)")
    order = Window.partitionBy("flow", "chunk").orderBy("at", "execution_id")
    events = events.withColumn("before", F.lag("bad").over(order))
    first, bad, before = F.col("before").isNull(), F.col("bad"), F.col("before")
    start = F.coalesce(bad & ~before, F.lit(False))
    end = F.coalesce(~bad & before, F.lit(False))
    position = F.struct("at", "execution_id")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("at"))), zero)

    chunks = events.groupBy("flow", "chunk").agg(
        total(start).alias("starts"), total(end).alias("ends"), count_rows(end).alias("n"),
        F.max(F.when(first, bad)).alias("first_bad"), F.max(F.when(first, F.col("at"))).alias("first_at"),
        F.max_by("bad", position).alias("last_bad"),
        F.max_by("at", position).alias("last_at"),
        F.max(F.when(start, F.col("at"))).alias("last_start"))
    seam = Window.partitionBy("flow").orderBy("chunk")
    inherited = F.coalesce(F.lag("last_bad").over(seam), F.lit(False))
    joined = chunks.withColumn("inherited", inherited)
    opens = F.col("first_bad") & ~F.col("inherited")
    closes = ~F.col("first_bad") & F.col("inherited")
    at = F.col("first_at")
    joined = joined.select(
        "flow", "chunk", "last_bad",
        (F.col("starts") + F.when(opens, at).otherwise(zero)).alias("starts"),
        (F.col("ends") + F.when(closes, at).otherwise(zero)).alias("ends"),
        (F.col("n") + F.when(closes, 1).otherwise(0)).alias("n"),
        F.coalesce(F.col("last_start"), F.when(opens, at)).alias("last_start"))
    per_flow = joined.groupBy("flow").agg(
        F.sum("starts").alias("starts"), F.sum("ends").alias("ends"), F.sum("n").alias("recoveries"),
        F.max("last_start").alias("last_start"), F.max_by("last_bad", "chunk").alias("open"))
    unended = F.when(F.col("open"), F.col("last_start")).otherwise(zero)
    return per_flow.select(
        F.col("flow").alias(by), "recoveries",
        ((F.col("ends") - (F.col("starts") - unended)).cast("double") / 1e6).alias("seconds"))


def mean_time_to_recovery(executions: DataFrame) -> DataFrame:
    """Hours over all recovered streaks of all flows; NULL without any."""
    return recovery_times(executions).agg(F.round(F.try_divide(
        F.sum("seconds"), F.sum("recoveries")) / 3600, 2).alias("mttr_hours"))


def stability_index(runs: DataFrame, as_of: Column, days: int = 30, latest: int = 30) -> DataFrame:
    """100 minus the spread of the mean pass rates of the latest executions."""
    means = within(finished_checks(runs), "created_at", as_of, days).groupBy("execution_id").agg(
        F.avg("pass_rate").alias("rate"), F.max("created_at").alias("at"))
    recent = means.orderBy(F.desc("at"), F.desc("execution_id")).limit(latest)
    spread = F.stddev_pop("rate")
    return recent.agg(F.when(F.count("rate") <= 1, 100.0).otherwise(
        F.round(F.greatest(F.lit(0.0), F.lit(100.0) - spread), 1)).alias("quality_stability_index"))


def summary(executions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    recent = within(executions, "started_at", as_of, days)
    counted = recent.agg(
        F.count("*").alias("total"), F.count_distinct(F.to_date("started_at")).alias("active"),
        count_rows(F.col("status") == "completed").alias("completed"),
        count_rows(F.col("status") == "failed").alias("failed"))
    return counted.select(
        F.round(F.col("total") / F.greatest(F.col("active"), F.lit(1)), 1).alias("runs_per_day"),
        share(F.col("completed"), F.col("total")).alias("success_rate"),
        share(F.col("failed"), F.col("total")).alias("failure_rate"))


def timeline(executions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Executions per day by outcome; any other status is partial."""
    status = F.col("status")
    return within(executions, "started_at", as_of, days).groupBy(
        F.to_date("started_at").alias("day")).agg(
        count_rows(status == "completed").alias("success"),
        count_rows(status == "failed").alias("failed"),
        count_rows(~status.isin("completed", "failed")).alias("partial"))


def heatmap(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Mean pass rate per day and check."""
    return within(finished_checks(runs), "created_at", as_of, days).groupBy(
        F.to_date("created_at").alias("day"), "node_id").agg(
        F.max("check_name").alias("check_name"), F.round(F.avg("pass_rate"), 1).alias("value"))


def severity_band(rate: Column, status: Column) -> Column:
    unknown = F.when(status == "failed", "High").otherwise("Medium")
    return (F.when(rate.isNull(), unknown).when(rate < 50, "Critical").when(rate < 70, "High")
            .when(rate < 90, "Medium").otherwise("Low"))


def recent_alerts(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The latest failed or warning checks."""
    alerts = runs.where((F.col("node_type") == "check") & F.col("status").isin("failed", "warning"))
    latest = alerts.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)
    return latest.select(
        "run_id", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("date"),
        F.col("check_name").alias("check"),
        severity_band(F.col("pass_rate"), F.col("status")).alias("severity"),
        (F.col("status") != "failed").alias("resolved"))
