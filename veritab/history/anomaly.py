"""Unusual pass rates, volumes and failure rates in the run history."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.relations import count_rows
from veritab.history.common import days_before
from veritab.sources.scratch import numbered_folders

# Detection thresholds.
Z_SCORE = 2.0
MIN_EXECUTIONS = 3
# Suggestion per kind of anomaly: signal, action.
SUGGESTIONS = {
    "pass_rate_drop": (
        "Quality rule pass rate degradation",
        "Review data pipeline inputs for the affected rules and check for upstream schema changes"),
    "volume_anomaly": (
        "Execution volume deviation",
        "Investigate data source ingestion pipeline for missing or duplicate loads"),
    "failure_spike": (
        "Flow failure rate spike",
        "Check infrastructure health and review failed node error messages"),
}
SEVERITIES = ("Critical", "High", "Medium", "Low")


def _shape(df: DataFrame, kind: str, subject: Column, severity: Column, detected: Column,
           current: Column, expected: Column, z: Column, summary: Column) -> DataFrame:
    return df.select(
        F.lit(kind).alias("anomaly_type"), subject.cast("string").alias("subject"),
        severity.alias("severity"), F.to_date(detected).alias("detected_on"),
        F.round(current, 4).alias("current_value"), F.round(expected, 4).alias("expected_value"),
        F.round(z, 4).alias("z_score"), summary.alias("summary"))


def pass_rate_drops(rule_runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Rules whose latest completed run is far below their mean.

    ``rule_runs``: rule_id, run_id, status, pass_rate, started_at.
    """
    done = rule_runs.where(F.col("status") == "completed")
    rate = F.when(F.col("started_at") >= days_before(as_of, days), F.col("pass_rate"))
    counted = F.when(F.col("started_at") >= days_before(as_of, days), F.lit(1))
    per_rule = done.groupBy("rule_id").agg(
        F.avg(rate).alias("mu"), F.stddev_samp(rate).alias("sd"), F.count(counted).alias("n"),
        F.max_by(F.struct("pass_rate", "started_at"), F.struct("started_at", "run_id")).alias("last"))
    z = F.try_divide(F.col("last.pass_rate") - F.col("mu"), F.col("sd"))
    odd = per_rule.where(F.col("n") >= MIN_EXECUTIONS).withColumn("z", z).where(F.col("z") < -Z_SCORE)
    severity = F.when(F.col("z") < -3, "Critical").when(F.col("z") < -2.5, "High").otherwise("Medium")
    text = F.format_string("Pass rate dropped to %.1f%% (avg %.1f%%)", F.col("last.pass_rate"), F.col("mu"))
    return _shape(odd, "pass_rate_drop", F.col("rule_id"), severity, F.col("last.started_at"),
                  F.col("last.pass_rate"), F.col("mu"), F.col("z"), text)


def daily_volume(executions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Executions per day: all, failed, completed."""
    status = F.col("status")
    recent = executions.where(F.col("started_at") >= days_before(as_of, days))
    return recent.groupBy(F.to_date("started_at").alias("day")).agg(
        F.count("*").alias("total_executions"),
        count_rows(status == "failed").alias("failed_executions"),
        count_rows(status == "completed").alias("successful_executions"))


def _latest_day(daily: DataFrame, value: Column) -> DataFrame:
    """The latest day with mean and population deviation over all days."""
    stats = daily.agg(
        F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"), F.count("*").alias("n"),
        F.max_by(value, "day").alias("latest"), F.max("day").alias("day"))
    z = F.try_divide(F.col("latest") - F.col("mu"), F.col("sd"))
    return stats.where(F.col("n") >= MIN_EXECUTIONS).withColumn("z", z)


def volume_anomaly(executions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    daily = daily_volume(executions, as_of, days)
    odd = _latest_day(daily, F.col("total_executions").cast("double")).where(F.abs("z") > Z_SCORE)
    severity = F.when(F.abs("z") > 3, "High").otherwise("Medium")
    text = F.format_string("Execution volume %s (%.0f vs avg %.0f)",
                           F.when(F.col("z") > 0, "spike").otherwise("drop"), F.col("latest"), F.col("mu"))
    return _shape(odd, "volume_anomaly", F.lit("All flows"), severity, F.col("day"),
                  F.col("latest"), F.col("mu"), F.col("z"), text)


def failure_spike(executions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    daily = daily_volume(executions, as_of, days)
    rate = F.col("failed_executions") * 100.0 / F.col("total_executions")
    odd = _latest_day(daily, rate).where(F.col("z") > Z_SCORE)
    severity = F.when(F.col("z") > 3, "Critical").otherwise("High")
    text = F.format_string("Failure rate spike (%.1f%% vs avg %.1f%%)", F.col("latest"), F.col("mu"))
    return _shape(odd, "failure_spike", F.lit("All flows"), severity, F.col("day"),
                  F.col("latest"), F.col("mu"), F.col("z"), text)


def detect(rule_runs: DataFrame, executions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        pass_rate_drops(rule_runs, as_of, days), volume_anomaly(executions, as_of, days),
        failure_spike(executions, as_of, days)])


def summary(anomalies: DataFrame) -> DataFrame:
    return anomalies.agg(F.count("*").alias("total_anomalies"), *[
        count_rows(F.col("severity") == s).alias(f"{s.lower()}_anomalies") for s in SEVERITIES])


def suggestions(anomalies: DataFrame) -> DataFrame:
    """One suggestion per kind of anomaly found, from its worst case.

    Nothing found yields the single all-clear row.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    worst = anomalies.groupBy("anomaly_type").agg(
        F.min_by("severity", F.struct(rank, "subject")).alias("severity"))
    kind = F.col("anomaly_type")
    text = F.create_map(*[F.lit(x) for k, (signal, _) in SUGGESTIONS.items() for x in (k, signal)])
    action = F.create_map(*[F.lit(x) for k, (_, act) in SUGGESTIONS.items() for x in (k, act)])
    urgent = (kind == "failure_spike") | ((kind == "pass_rate_drop") & (F.col("severity") == "Critical"))
    found = worst.select(text[kind].alias("signal"),
                         F.when(urgent, "P1").otherwise("P2").alias("priority"),
                         action[kind].alias("action"))
    none = anomalies.agg(F.count("*").alias("n")).where(F.col("n") == 0).select(
        F.lit("All systems nominal").alias("signal"), F.lit("P3").alias("priority"),
        F.lit("No anomalies detected. Consider tightening detection thresholds for proactive monitoring.")
        .alias("action"))
    return found.unionByName(none)


def fingerprint(workspace: Column, kind: Column, dataset: Column, column: Column, rule: Column) -> Column:
    blank = F.lit("")
    parts = [F.coalesce(c.cast("string"), blank) for c in (workspace, kind, dataset, column, rule)]
    return F.sha1(F.concat_ws("|", *parts))


def plan_upsert(detected: DataFrame, existing: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Whether each detected anomaly updates a live one or is inserted.

    ``detected``: fingerprint and its fields. ``existing``: anomaly_id,
    fingerprint, status, detected_at. The latest open or acknowledged anomaly of
    the last ``hours`` takes the update.
    """
    live = existing.where(F.col("status").isin("open", "acknowledged") & (
        F.col("detected_at") >= as_of - F.expr(f"INTERVAL '{hours}' HOUR")))
    target = live.groupBy("fingerprint").agg(
        F.max_by("anomaly_id", F.struct("detected_at", "anomaly_id")).alias("anomaly_id"))
    return detected.join(target, "fingerprint", "left").withColumn(
        "action", F.when(F.col("anomaly_id").isNull(), "insert").otherwise("update"))


DELIVERY = "version long, delivery string, detected long, inserted long, updated long"


def deliveries(spark: SparkSession, root: str) -> DataFrame:
    """The deliveries a store of anomalies has taken: version, delivery, detected, inserted, updated."""
    if not numbered_folders(spark, f"{root}/manifest", "version"):
        return spark.createDataFrame([], DELIVERY)
    return spark.read.schema(DELIVERY).parquet(f"{root}/manifest")


def recorded_anomalies(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows after the last delivery; None before the first."""
    versions = numbered_folders(spark, f"{root}/manifest", "version")
    return spark.read.parquet(f"{root}/rows/version={versions[-1]}") if versions else None


def record_anomalies(detected: DataFrame, root: str, delivery: str, as_of: datetime, order: str | None = None,
                     start: DataFrame | None = None, hours: int = 24) -> DataFrame:
    """Applies a delivery of detected anomalies to the store under ``root``; returns the rows after it.

    ``detected``: fingerprint and the fields to set. A live anomaly of the same fingerprint takes them and
    is detected anew; otherwise an open one is inserted. Of several with one fingerprint in a delivery
    the one highest in ``order`` stays. ``start`` are the rows before the first delivery.

    The store is copied on write: a delivery writes the rows of a new version, then the version's manifest, which is the
    commit. A delivery that is repeated changes nothing; one that broke off left no manifest and is overwritten.
    """
    spark = detected.sparkSession
    taken = deliveries(spark, root)
    if not taken.where(F.col("delivery") == delivery).isEmpty():
        return recorded_anomalies(spark, root)
    versions = numbered_folders(spark, f"{root}/manifest", "version")
    version, now = (versions[-1] + 1 if versions else 0), F.lit(as_of).cast("timestamp")
    fields = [c for c in detected.columns if c not in ("fingerprint", order)]
    latest = detected.groupBy("fingerprint").agg(
        F.max_by(F.struct(*fields), F.struct(*([order] if order else fields))).alias("new"), F.count("*").alias("times"))
    kept = recorded_anomalies(spark, root) if versions else start
    rows, inserts = None, latest.withColumn("anomaly_id", F.lit(None).cast("long"))
    if kept is not None:
        planned = plan_upsert(latest, kept, now, hours)
        updates = planned.where("action = 'update'").select("anomaly_id", "new")
        missing = [c for c in (*fields, "updated_at", "created_at") if c not in kept.columns]
        kept = kept.withColumns({c: F.lit(None).cast("timestamp" if c.endswith("_at") else detected.schema[c].dataType) for c in missing})
        hit = F.col("new").isNotNull()
        rows = kept.join(updates, "anomaly_id", "left").withColumns({
            **{c: F.when(hit, F.col(f"new.{c}")).otherwise(F.col(c)) for c in fields},
            **{c: F.when(hit, now).otherwise(F.col(c)) for c in ("detected_at", "updated_at")}}).drop("new")
        inserts = planned.where("action = 'insert'").drop("action")
    added = inserts.select(
        F.xxhash64("fingerprint", F.lit(delivery)).alias("anomaly_id"), "fingerprint", *[F.col(f"new.{c}").alias(c) for c in fields],
        F.lit("open").alias("status"), *[now.alias(c) for c in ("detected_at", "created_at", "updated_at")])
    target = f"{root}/rows/version={version}"
    (added if rows is None else rows.unionByName(added, allowMissingColumns=True)).write.mode("overwrite").parquet(target)
    counts = latest.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("detected")).crossJoin(
        F.broadcast(inserts.agg(F.count("*").alias("inserted"))))
    counts.select(F.lit(delivery).alias("delivery"), "detected", "inserted", (F.col("detected") - F.col("inserted")).alias("updated")).coalesce(1).write.mode(
        "overwrite").parquet(f"{root}/manifest/version={version}")
    return recorded_anomalies(spark, root)
