"""Issues and incidents derived from failing runs, and their service levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.nearby import running_sums
from veritab.functions.predicates import epoch_micros
from veritab.functions.quantiles import interpolated, quantile_ranks, values_at_ranks
from veritab.functions.relations import count_rows
from veritab.history.common import days_before, lookup

# Severity of a rule -> severity of its issue.
ISSUE_SEVERITY = {
    "blocker": "critical",
    "critical": "critical",
    "high": "major",
    "major": "major",
    "medium": "minor",
    "minor": "minor",
    "low": "informational",
    "info": "informational",
    "informational": "informational",
}
# Hours to resolve, cost of a missed issue, incident priority.
SLA_HOURS = {"critical": 4.0, "major": 8.0, "minor": 24.0, "informational": 72.0}
ISSUE_COST = {"critical": 15000.0, "major": 5000.0, "minor": 1000.0, "info": 200.0}
PRIORITY = {"critical": "P1", "major": "P2", "minor": "P3", "informational": "P4"}
SEVERITY_RANK = {"critical": 0, "major": 1, "minor": 2, "informational": 3}
OPEN_STATUSES = ("open", "in_progress", "reopened")


def issue_severity(rule_severity: Column) -> Column:
    return lookup(F.lower(rule_severity), ISSUE_SEVERITY, "minor")


def hours_after(ts: Column, hours: Column) -> Column:
    return F.timestamp_micros(epoch_micros(ts) + (hours * 3_600_000_000).cast("long"))


def hours_between(start: Column, end: Column) -> Column:
    return (epoch_micros(end) - epoch_micros(start)) / 3.6e9


def derive_issues(rule_runs: DataFrame, sla_hours: Mapping[str, float] = SLA_HOURS) -> DataFrame:
    """One issue per completed run with failing rows.

    ``rule_runs``: run_id, rule_id, rule_name, dataset_id, severity, status,
    rows_scanned, rows_failed, pass_rate, completed_at.
    """
    severity = issue_severity(F.col("severity"))
    summary = F.when(F.col("pass_rate").isNotNull(), F.format_string(
        "%d of %d rows failed (%.1f%% pass rate)", "rows_failed", "rows_scanned", "pass_rate")
    ).otherwise(F.format_string("%d of %d rows failed", "rows_failed", "rows_scanned"))
    failing = rule_runs.where((F.col("status") == "completed") & (F.col("rows_failed") > 0))
    title = F.concat(F.lit("["), F.upper(severity), F.lit("] "), F.col("rule_name"))
    hours = F.create_map(*[F.lit(x) for item in sla_hours.items() for x in item])[severity]
    return failing.select(
        "run_id", "rule_id", "dataset_id", severity.alias("severity"),
        title.alias("title"), summary.alias("impact_summary"),
        F.col("rows_failed").alias("failure_count"), F.col("completed_at").alias("opened_at"),
        F.when(hours.isNotNull(), hours_after(F.col("completed_at"), hours)).alias("due_at"))


def _since_resolutions(failures: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failures with the number of resolutions of their rule and dataset up to then (``stretch``), and the resolutions so numbered.

    Both are swept in order of time. The sweep runs in cells of time that hand on their counts, so a
    rule with a long history is spread over tasks. A resolution comes before a failure of the same instant.
    """
    home = ["rule_id", "dataset_id"]
    known = [F.col(c).isNotNull() for c in home]
    zero = F.lit(0).cast("long")
    own = failures.where(known[0] & known[1])
    instant = lambda ts: F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
    ends = resolutions.where(known[0] & known[1] & F.col("resolved_at").isNotNull()).select(
        *home, instant("resolved_at").alias("at"), F.lit(0).alias("turn"), F.lit(1).cast("long").alias("resolved"),
        F.lit(None).cast(own.schema["run_id"].dataType).alias("run_id"), F.col("resolved_at").cast("timestamp").alias("resolved_at"))
    begins = own.select(*home, instant("completed_at").alias("at"), F.lit(1).alias("turn"), zero.alias("resolved"), "run_id",
                        F.lit(None).cast("timestamp").alias("resolved_at"))
    swept = running_sums(begins.unionByName(ends), home, "at", "turn", ["resolved"])
    # Rows of one instant are peers: the largest count among equal resolutions numbers them, each failure sees it whole.
    numbers = swept.where(F.col("turn") == 0).select(*home, F.col("resolved_upto").alias("stretch"), "resolved_at")
    counted = swept.where(F.col("turn") == 1).select("run_id", "at", F.col("resolved_upto").alias("stretch")).distinct()
    placed = failures.withColumn("at", instant("completed_at")).join(counted, ["run_id", "at"], "left").drop("at")
    return placed.withColumn("stretch", F.coalesce("stretch", zero)), numbers


def group_failures(failures: DataFrame, open_issues: DataFrame, policy: str,
                   time_zone: str = "UTC", resolutions: DataFrame | None = None) -> DataFrame:
    """Fold a batch of failures into issues.

    ``one_per_execution`` opens an issue each; ``one_per_rule`` adds to the open
    issue of the rule and dataset; ``one_per_day`` does so within a calendar day
    of the time zone. A run without rule or dataset always stands alone. Since a
    new issue stays open for the rest of the batch, a group-by gives the result
    of handling the failures one after the other.

    ``failures``: run_id, rule_id, dataset_id, rows_failed, completed_at.
    ``open_issues``: issue_id, rule_id, dataset_id, status, failure_count, opened_at.
    ``resolutions``: rule_id, dataset_id, resolved_at of issues resolved while the batch's failures
    came in. They end what is open then: a later failure opens a new issue. The result then has
    ``resolved_at`` too, NULL for issues still open; only failures before a rule's first resolution
    add to an issue of ``open_issues``.
    """
    if policy not in ("one_per_execution", "one_per_rule", "one_per_day"):
        raise ValueError(f"unknown grouping policy {policy!r}")

    def day(ts: str) -> Column:
        if policy != "one_per_day":
            return F.lit(None).cast("date")
        return F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), time_zone))

    alone = F.col("rule_id").isNull() | F.col("dataset_id").isNull()
    if policy == "one_per_execution":
        alone = F.lit(True)
    keyed = failures.withColumns({"day": day("completed_at"),
                                  "own": F.when(alone, F.col("run_id"))})
    numbers = None
    if resolutions is None:
        keyed = keyed.withColumn("stretch", F.lit(0).cast("long"))
    else:
        keyed, numbers = _since_resolutions(keyed, resolutions)
    batch = keyed.groupBy("rule_id", "dataset_id", "day", "own", "stretch").agg(
        F.sum("rows_failed").alias("added"), F.count("*").alias("failures"),
        F.min("completed_at").alias("first_seen"), F.max("completed_at").alias("last_seen_at"))
    candidates = open_issues.where(F.col("status").isin(*OPEN_STATUSES)).withColumn(
        "issue_day", day("opened_at"))
    target = candidates.groupBy(F.col("rule_id").alias("r"), F.col("dataset_id").alias("d"),
                                F.col("issue_day")).agg(
        F.max_by(F.struct("issue_id", "failure_count", "opened_at"),
                 F.struct("opened_at", "issue_id")).alias("issue"))
    on = [F.col("rule_id") == F.col("r"), F.col("dataset_id") == F.col("d"),
          F.col("day").eqNullSafe(F.col("issue_day")), F.col("own").isNull(), F.col("stretch") == 0]
    joined = batch.join(target, on, "left")
    ended = []
    if numbers is not None:
        ends = numbers.select(F.col("rule_id").alias("__r"), F.col("dataset_id").alias("__d"),
                              (F.col("stretch") - 1).alias("__stretch"), "resolved_at")
        joined = joined.join(ends, (F.col("rule_id") == F.col("__r")) & (F.col("dataset_id") == F.col("__d"))
                             & (F.col("stretch") == F.col("__stretch")), "left")
        ended = ["resolved_at"]
    total = F.coalesce(F.col("issue.failure_count"), F.lit(0)) + F.col("added")
    return joined.select(
        "rule_id", "dataset_id", F.col("issue.issue_id").alias("issue_id"),
        F.when(F.col("issue").isNull(), "insert").otherwise("update").alias("action"),
        "failures", total.cast("long").alias("failure_count"),
        F.coalesce(F.col("issue.opened_at"), F.col("first_seen")).alias("opened_at"), "last_seen_at", *ended)


def auto_incidents(issues: DataFrame, open_links: DataFrame, min_severity: str = "major",
                   recurrence: int = 1, priority: str | None = None) -> DataFrame:
    """Incidents to open: severe and frequent issues without an open incident.

    ``open_links``: issue_id of issues linked to an incident still open.
    """
    rank = lookup(F.col("severity"), SEVERITY_RANK, 99)
    wanted = issues.where((rank <= SEVERITY_RANK[min_severity])
                          & (F.col("failure_count") >= recurrence))
    free = wanted.join(open_links.select("issue_id").distinct(), "issue_id", "left_anti")
    derived = F.lit(priority) if priority else lookup(F.col("severity"), PRIORITY, "P3")
    title = F.concat(F.lit("[Auto] "), F.col("title"))
    return free.select("issue_id", title.alias("title"), "severity", derived.alias("priority"),
                       F.lit("open").alias("status"))


# --- reports ------------------------------------------------------------------

def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def issue_counts(issues: DataFrame) -> DataFrame:
    status, severity = F.col("status"), F.col("severity")
    known = status.isin("open", "resolved", "closed")
    return issues.agg(
        *[count_rows(status == s).alias(f"status_{s}") for s in ("open", "resolved", "closed")],
        *[count_rows(known & (severity == s)).alias(f"severity_{s}")
          for s in ("critical", "major", "minor", "info")])


def incident_counts(incidents: DataFrame) -> DataFrame:
    status, severity, priority = F.col("status"), F.col("severity"), F.col("priority")
    return incidents.agg(
        *[count_rows(status == s).alias(f"status_{s}")
          for s in ("open", "acknowledged", "resolved", "closed")],
        *[count_rows(severity == s).alias(f"severity_{s}")
          for s in ("critical", "major", "minor", "info")],
        *[count_rows(priority == p).alias(f"priority_{p.lower()}") for p in ("P1", "P2", "P3", "P4")])


def overdue(issues: DataFrame, as_of: Column, statuses: Sequence[str] = ("open",)) -> DataFrame:
    return issues.where(F.col("status").isin(*statuses) & (F.col("due_at") < as_of))


def overdue_counts(issues: DataFrame, links: DataFrame, as_of: Column) -> DataFrame:
    """Overdue issues, and incidents with at least one of them."""
    late = overdue(issues, as_of)
    hit = links.join(late.select("issue_id"), "issue_id", "left_semi").agg(
        F.count_distinct("incident_id").alias("incidents_breached"))
    return late.agg(F.count("*").alias("overdue_issues")).crossJoin(F.broadcast(hit))


def resolution_times(items: DataFrame) -> DataFrame:
    """Mean, median and 95th percentile hours. The percentile is an element:

    the one at index ``min(int(0.95 n), n - 1)`` of the sorted hours.
    """
    hours = hours_between(F.col("opened_at"), F.col("resolved_at"))
    done = items.select(hours.alias("h")).where(F.col("h") >= 0)
    stats = done.agg(F.round(F.avg("h"), 2).alias("avg_hours"), F.count("*").alias("total_resolved"))
    total = F.col("total")
    ranks = [*quantile_ranks([0.5]), F.least(F.floor(total * F.lit(0.95)), total - 1)]
    found = values_at_ranks(done, [F.col("h")], ranks)

    def pick(i: int) -> Column:
        return F.max(F.when(F.col("ask") == i, F.col("value")))

    ranked = found.agg(F.max("total").alias("total"), *[pick(i).alias(f"v{i}") for i in range(3)])
    return stats.crossJoin(F.broadcast(ranked)).select(
        "avg_hours", "total_resolved",
        F.round(interpolated(0.5, F.col("v0"), F.col("v1")), 2).alias("median_hours"),
        F.round("v2", 2).alias("p95_hours"))


# --- service levels -----------------------------------------------------------

def with_sla(incidents: DataFrame, as_of: Column, sla_hours: Mapping[str, float] = SLA_HOURS) -> DataFrame:
    """Target, elapsed hours and breach of every incident."""
    severity = F.coalesce(F.lower("severity"), F.lit("minor"))
    elapsed = hours_between(F.col("opened_at"), F.coalesce(F.col("resolved_at").cast("timestamp"), as_of))
    return incidents.withColumns({
        "severity": severity, "target_hours": lookup(severity, dict(sla_hours), 24.0),
        "elapsed": elapsed}).withColumn("breached", F.col("elapsed") > F.col("target_hours"))


def _since(incidents: DataFrame, as_of: Column, days: int) -> DataFrame:
    return incidents.where(F.col("opened_at") >= days_before(as_of, days))


def sla_metrics(incidents: DataFrame, as_of: Column, days: int = 30,
                sla_hours: Mapping[str, float] = SLA_HOURS) -> DataFrame:
    judged = with_sla(_since(incidents, as_of, days), as_of, sla_hours)
    breached, done = F.col("breached"), F.col("resolved_at").isNotNull()
    counted = judged.agg(
        F.count("*").alias("total_incidents"), count_rows(breached).alias("breaches_count"),
        F.coalesce(F.round(F.avg(F.when(breached, F.col("elapsed") - F.col("target_hours"))), 1),
                   F.lit(0.0)).alias("avg_breach_duration_hours"),
        F.coalesce(F.round(F.avg(F.when(done, F.col("elapsed"))), 1), F.lit(0.0)).alias("mttr_hours"),
        count_rows(done).alias("resolved_count"))
    total = F.col("total_incidents")
    kept = F.round(F.try_divide(100.0 * (total - F.col("breaches_count")), total.cast("double")), 1)
    return counted.withColumns({
        "compliance_rate": F.coalesce(kept, F.lit(100.0)),
        "open_count": total - F.col("resolved_count")})


def breaches_by_severity(incidents: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return with_sla(_since(incidents, as_of, days), as_of).where("breached").groupBy(
        F.initcap("severity").alias("name")).agg(F.count("*").alias("value"))


def sla_trend(incidents: DataFrame, as_of: Column, weeks: int = 8) -> DataFrame:
    """Weekly compliance, the latest week ending now; empty weeks are compliant."""
    week_us = 7 * 86_400_000_000
    age = epoch_micros(as_of) - epoch_micros(F.col("opened_at"))
    # The week ending w weeks ago holds ages above w and up to w + 1 weeks.
    nth = ((age + week_us - 1 - F.pmod(age + week_us - 1, F.lit(week_us))) / week_us - 1).cast("long")
    judged = with_sla(incidents, as_of).withColumn("w", nth)
    counted = judged.where(F.col("w").between(0, weeks - 1)).groupBy("w").agg(
        F.count("*").alias("total"), count_rows(F.col("breached")).alias("breaches"))
    calendar = incidents.sparkSession.range(weeks).select(F.col("id").alias("w"))
    joined = calendar.join(counted, "w", "left")
    total, bad = F.coalesce("total", F.lit(0)), F.coalesce("breaches", F.lit(0))
    kept = F.round(F.try_divide(100.0 * (total - bad), total.cast("double")), 1)
    start = F.timestamp_micros(epoch_micros(as_of) - (F.col("w") + 1) * week_us)
    return joined.select(
        F.to_date(start).alias("week_start"), F.date_format(start, "MMM dd").alias("label"),
        F.coalesce(kept, F.lit(100.0)).alias("compliance"), bad.alias("breaches"))


def sla_list(incidents: DataFrame, as_of: Column, days: int = 30, page: int = 1,
             page_size: int = 20) -> DataFrame:
    """One page of incidents, newest first, with target and elapsed hours."""
    judged = with_sla(_since(incidents, as_of, days), as_of)
    return judged.orderBy(F.desc("opened_at"), F.desc("incident_id")).offset(
        (page - 1) * page_size).limit(page_size).select(
        "incident_id", F.initcap("severity").alias("severity"),
        F.coalesce("priority", F.lit("P3")).alias("priority"), F.initcap("status").alias("status"),
        F.col("target_hours").alias("sla_target_hours"),
        F.round("elapsed", 1).alias("elapsed_hours"), "breached")


# --- value ----------------------------------------------------------------------

def _cost(severity: Column, costs: Mapping[str, float]) -> Column:
    return lookup(severity, dict(costs), 0.0)


def value_summary(issues: DataFrame, links: DataFrame, as_of: Column, days: int = 30,
                  costs: Mapping[str, float] = ISSUE_COST) -> DataFrame:
    """Issues caught, incidents avoided and cost saved in the period."""
    recent = issues.where(F.col("opened_at") >= days_before(as_of, days))
    escalated = links.where(F.col("issue_id").isNotNull()).select(
        F.col("issue_id").alias("linked")).distinct()
    joined = recent.join(escalated, F.col("issue_id") == F.col("linked"), "left")
    avoided = (F.col("severity").isin("critical", "major") & F.col("resolved_at").isNotNull()
               & F.col("linked").isNull())
    return joined.agg(
        F.count("*").alias("issues_caught"),
        count_rows(avoided).alias("estimated_incidents_avoided"),
        F.coalesce(F.round(F.sum(_cost(F.col("severity"), costs)), 2), F.lit(0.0))
        .alias("estimated_cost_saved_usd"))


def value_trend(issues: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Issues per day with the empty days filled in."""
    start, today = F.to_date(days_before(as_of, days)), F.to_date(as_of)
    calendar = issues.sparkSession.range(1).select(
        F.explode(F.sequence(start, today)).alias("day"))
    counted = issues.where(F.col("opened_at") >= days_before(as_of, days)).groupBy(
        F.to_date("opened_at").alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counted, "day", "left").select(
        "day", F.coalesce("n", F.lit(0)).alias("issues"))


def top_flows(issues: DataFrame, as_of: Column, days: int = 30, limit: int = 10,
              costs: Mapping[str, float] = ISSUE_COST) -> DataFrame:
    recent = issues.where(F.col("opened_at") >= days_before(as_of, days))
    return recent.groupBy("flow_id").agg(
        F.count("*").alias("issues_caught"),
        count_rows(F.col("severity") == "critical").alias("critical_issues"),
        F.round(F.sum(_cost(F.col("severity"), costs)), 2).alias("estimated_value_usd"),
    ).orderBy(F.desc("estimated_value_usd"), "flow_id").limit(limit)


# --- escalation -------------------------------------------------------------------

def _overdue_rules(alert_rules: DataFrame) -> DataFrame:
    return alert_rules.where(F.col("enabled") & (F.col("event") == "issue_overdue")).withColumn(
        "sent_to", F.coalesce("channel", "recipient")).where(F.col("sent_to").isNotNull())


def escalated_issues(issues: DataFrame, alert_rules: DataFrame, as_of: Column) -> DataFrame:
    """Each rule that notifies about overdue issues with each of these issues."""
    late = overdue(issues, as_of, OPEN_STATUSES).select("workspace_id", "issue_id", "severity", "due_at")
    return _overdue_rules(alert_rules).join(late, "workspace_id").select(
        "alert_rule_id", "workspace_id", "sent_to", "issue_id", "severity", "due_at")


def escalate(issues: DataFrame, alert_rules: DataFrame, as_of: Column) -> DataFrame:
    """Notifications for overdue issues: one per enabled rule and channel.

    ``alert_rules``: alert_rule_id, workspace_id, event, enabled, channel,
    recipient. A rule without channel notifies its recipient; with neither it
    stays silent. ``escalated_issues`` lists the issues each of them is about.
    """
    late = overdue(issues, as_of, OPEN_STATUSES).groupBy("workspace_id").agg(
        F.count("*").alias("overdue_issues"), F.min("due_at").alias("earliest_due"))
    return _overdue_rules(alert_rules).join(late, "workspace_id").select(
        "alert_rule_id", "workspace_id", "sent_to", "overdue_issues", "earliest_due")


def matches(conditions: Mapping[str, Any] | None) -> Column:
    """Row predicate of an alert rule: ``{field: value | [values] | {op: value}}``.

    No conditions match everything; an unknown operator matches nothing.
    """
    tests = [F.lit(True)]
    for name, wanted in (conditions or {}).items():
        col = F.col(name)
        if isinstance(wanted, Mapping):
            if "in" in wanted:
                tests.append(_member(col, wanted["in"] or []))
            elif "eq" in wanted:
                tests.append(col.eqNullSafe(F.lit(wanted["eq"])))
            elif "ne" in wanted:
                tests.append(~col.eqNullSafe(F.lit(wanted["ne"])))
            else:
                tests.append(F.lit(False))
        elif isinstance(wanted, (list, tuple)):
            tests.append(_member(col, wanted))
        else:
            tests.append(col.eqNullSafe(F.lit(wanted)))
    return reduce(and_, tests)


def _member(col: Column, values: Sequence[Any]) -> Column:
    listed = [v for v in values if v is not None]
    found = F.coalesce(col.isin(listed), F.lit(False)) if listed else F.lit(False)
    return found | col.isNull() if None in values else found


def match_alerts(runs: DataFrame, rules: Mapping[str, Mapping[str, Any] | None]) -> DataFrame:
    """Runs with every alert rule they trigger, all rules in one scan."""
    hits = F.array_compact(F.array(*[F.when(matches(c), F.lit(n)) for n, c in rules.items()]))
    return runs.withColumn("alert_rule", F.explode(hits))
