"""Run-history, anomaly and incident analytics over tables derived from events and orders."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from veritab.history import anomaly, coverage, dashboards, effectiveness, incidents, operations
from veritab.plans.suite import moment
from veritab.registry.base import AS_OF, derive, query, source
from veritab.sources.scratch import scratch_path

NOW = moment
NOW_SQL = f"TIMESTAMP '{AS_OF}'"
# Late enough that part of the history is older than 30 days.
LATER, LATER_SQL = "2024-02-20 00:00:00", "TIMESTAMP '2024-02-20 00:00:00'"
# The order dates end here.
CLOSING, CLOSING_SQL = "2001-08-02 00:00:00", "TIMESTAMP '2001-08-02 00:00:00'"

derive("runs_base", "events", [
    "event_id AS run_id", "CAST(floor(event_id / 4) AS BIGINT) AS execution_id",
    "user_id AS rule_id", "user_id % 7 AS node", "user_id", "event_id", "value",
    "CASE WHEN event_id % 25 = 0 THEN 'source' ELSE 'check' END AS node_type",
    """CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN
       (CASE WHEN event_id % 3 = 0 THEN 'warning' ELSE 'completed' END) ELSE 'completed' END AS status""",
    "ts AS created_at",
])
derive("runs", "runs_base", [
    "run_id", "execution_id", "execution_id % 10 AS flow_id", "rule_id", "node_type", "status", "created_at",
    "'n' || CAST(node AS STRING) AS node_id", "'check ' || CAST(node AS STRING) AS check_name",
    """CASE node WHEN 0 THEN 'completeness' WHEN 1 THEN 'validity' WHEN 2 THEN 'uniqueness'
       WHEN 3 THEN 'consistency' WHEN 4 THEN 'timeliness' WHEN 5 THEN 'accuracy' ELSE 'patterns' END AS check_type""",
    "'ds' || CAST(user_id % 12 AS STRING) AS dataset", "user_id % 5 AS source_id",
    "'c' || CAST(execution_id % 8 AS STRING) AS column_name",
    "split('c' || CAST(execution_id % 8 AS STRING) || ',c' || CAST(8 + user_id % 3 AS STRING), ',') AS columns",
    "CASE node WHEN 0 THEN 99.95e0 WHEN 1 THEN least(value, 50e0) ELSE least(value * 3, 100e0) END AS pass_rate",
    "CASE WHEN node IN (2, 3) THEN 50e0 END AS threshold_pass",
    "1000 + event_id % 500 AS rows_scanned", "event_id % 90 AS rows_failed",
    "event_id % 60 AS duration_seconds",
])
derive("executions", "events", [
    "event_id AS execution_id", "user_id % 10 AS flow_id",
    "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'completed' END AS status",
    "ts AS started_at"])
derive("rule_runs", "events", [
    "event_id AS run_id", "user_id AS rule_id", "'rule ' || CAST(user_id AS STRING) AS rule_name",
    "CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id % 6 END AS dataset_id",
    """CASE user_id % 5 WHEN 0 THEN 'blocker' WHEN 1 THEN 'High' WHEN 2 THEN 'medium' WHEN 3 THEN 'low'
       ELSE 'unheard' END AS severity""",
    "CASE event_type WHEN 'error' THEN 'failed' ELSE 'completed' END AS status",
    """CASE WHEN ts >= TIMESTAMP '2024-01-30 00:00:00' AND user_id % 4 = 0 THEN least(value, 100e0) / 2
       ELSE 90 + least(value, 100e0) / 10 END AS pass_rate""", "1000 + event_id % 500 AS rows_scanned",
    "CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 90 END AS rows_failed",
    "ts AS started_at", "ts AS completed_at"])
derive("flows", "nation", [
    "CAST(n_nationkey AS BIGINT) AS flow_id", "'flow ' || n_name AS flow_name",
    "CASE n_nationkey % 3 WHEN 0 THEN 'inactive' WHEN 1 THEN 'active' ELSE 'draft' END AS status"])
derive("datasets", "supplier", [
    "'ds' || CAST(s_suppkey AS STRING) AS dataset",
    "CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS owner",
    "CASE WHEN s_suppkey % 4 = 0 THEN 'high' END AS criticality",
    "CASE WHEN s_nationkey > 10 THEN 'sales' ELSE '' END AS domain"])
derive("schema_columns", "nation", [
    "'ds' || CAST(n_regionkey AS STRING) AS dataset", "'c' || CAST(n_nationkey % 12 AS STRING) AS column_name"])
derive("issues", "orders", [
    "o_orderkey AS issue_id", "o_custkey % 60 AS rule_id", "o_custkey % 8 AS dataset_id",
    "o_custkey % 3 AS workspace_id", "o_custkey % 10 AS flow_id",
    "CAST(floor(o_orderkey / 3) AS BIGINT) AS incident_id",
    """CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'major' WHEN '3-MEDIUM' THEN 'minor'
       WHEN '4-NOT SPECIFIED' THEN 'informational' ELSE 'info' END AS severity""",
    """CASE o_orderstatus WHEN 'O' THEN (CASE WHEN o_orderkey % 4 = 0 THEN 'in_progress' ELSE 'open' END)
       WHEN 'F' THEN 'resolved' ELSE 'closed' END AS status""",
    "o_orderkey % 9 + 1 AS failure_count", "'issue ' || CAST(o_orderkey AS STRING) AS title",
    "o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT) AS opened_at",
    "o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 + 30 AS INT) AS due_at",
    """CASE WHEN o_orderstatus = 'O' THEN NULL
       ELSE o_orderdate + INTERVAL '1' MINUTE * CAST((o_orderkey % 24) * 60 + (o_orderkey * 7) % 4001 AS INT) END AS resolved_at""",
])
derive("incidents", "issues", [
    "issue_id AS incident_id", "nullif(severity, 'info') AS severity",
    "CASE status WHEN 'in_progress' THEN 'acknowledged' ELSE status END AS status",
    "'P' || CAST(1 + issue_id % 5 AS STRING) AS priority", "opened_at", "resolved_at"])
derive("incident_issues", "issues", [
    "incident_id", "CASE WHEN issue_id % 5 = 0 THEN issue_id END AS issue_id"])
derive("alert_rules", "nation", [
    "CAST(n_nationkey AS BIGINT) AS alert_rule_id", "CAST(n_nationkey % 4 AS BIGINT) AS workspace_id",
    "CASE WHEN n_nationkey % 6 = 5 THEN 'run_failed' ELSE 'issue_overdue' END AS event",
    "n_nationkey % 3 <> 0 AS enabled", "CASE WHEN n_regionkey = 1 THEN 'mail:' || n_name END AS channel",
    "CASE WHEN n_regionkey < 3 THEN 'user ' || n_name END AS recipient"])

RUNS, EXECUTIONS, FLOWS, DATASETS = (source(n) for n in ("runs", "executions", "flows", "datasets"))
CHECKS = f"(SELECT * FROM {RUNS} r WHERE node_type = 'check' AND status IN ('completed', 'failed'))"
SIX = "('completeness', 'validity', 'uniqueness', 'consistency', 'timeliness', 'accuracy')"
HEALTH = "CASE WHEN {x} >= 95 THEN 'healthy' WHEN {x} >= 80 THEN 'warning' ELSE 'critical' END"
WEIGHT = """CASE {x} WHEN 'completeness' THEN 0.25e0 WHEN 'validity' THEN 0.2e0 WHEN 'uniqueness' THEN 0.2e0
            WHEN 'consistency' THEN 0.15e0 ELSE 0.1e0 END"""


def recent(frm: str, ts: str, now: str = NOW_SQL, days: int = 30) -> str:
    return (f"(SELECT * FROM {frm} p WHERE {ts} >= {now} - INTERVAL '{days}' DAY AND {ts} <= {now})")


def count(cond: str) -> str:
    return f"count(CASE WHEN {cond} THEN 1 END)"


@query("HIS-overview", f"""
    SELECT count(*) AS total_executions, round(avg(pass_rate), 2) AS average_pass_rate,
           {count('pass_rate < 80')} AS critical_violations, (SELECT count(*) FROM nation) AS total_flows,
           round(avg(pass_rate), 2) AS dq_score FROM {CHECKS} c""")
def _overview(t):
    return dashboards.overview(t["runs"], t["flows"])


@query("HIS-trend-rate", f"""SELECT CAST(created_at AS DATE) AS day, round(avg(pass_rate), 2) AS value
    FROM {recent(CHECKS, 'created_at', days=14)} c GROUP BY 1""")
def _trend_rate(t):
    return dashboards.pass_rate_trend(t["runs"], NOW(AS_OF), 14)


@query("HIS-trend-count", f"""SELECT CAST(started_at AS DATE) AS day, count(*) AS value
    FROM {recent(EXECUTIONS, 'started_at')} c GROUP BY 1""")
def _trend_count(t):
    return dashboards.execution_trend(t["executions"], NOW(AS_OF))


@query("HIS-category", f"""
    SELECT category, total_rules, total_executions, pass_rate, avg_execution_time FROM (
      SELECT check_type AS category, count(*) AS total_executions, round(avg(pass_rate), 2) AS pass_rate,
             round(avg(duration_seconds), 2) AS avg_execution_time
      FROM {recent(CHECKS, 'created_at', LATER_SQL)} c WHERE check_type IN {SIX} GROUP BY 1) a
    JOIN (SELECT check_type AS category, count(DISTINCT flow_id) AS total_rules FROM {RUNS} r
          WHERE node_type = 'check' GROUP BY 1) b USING (category)""")
def _category(t):
    return dashboards.by_category(t["runs"], NOW(LATER))


@query("HIS-source", f"""
    SELECT source_id, count(DISTINCT flow_id) AS total_rules, count(*) AS total_executions,
           round(avg(pass_rate), 2) AS pass_rate, max(created_at) AS last_execution,
           {HEALTH.format(x='avg(pass_rate)')} AS health_status
    FROM {recent(CHECKS, 'created_at')} c GROUP BY source_id""")
def _source(t):
    return dashboards.by_source(t["runs"], NOW(AS_OF))


_PERIODS = f"""(SELECT *, created_at >= {LATER_SQL} - INTERVAL '30' DAY AS cur FROM {CHECKS} c
    WHERE created_at >= {LATER_SQL} - INTERVAL '60' DAY AND created_at <= {LATER_SQL})"""
_TREND = "CASE WHEN {a} - {b} > 1 THEN 'up' WHEN {a} - {b} < -1 THEN 'down' ELSE 'stable' END"
_SCORECARD = f"""
    SELECT check_type AS dimension, score, {WEIGHT.format(x='check_type')} AS weight,
           n - CAST(floor(n * score / 100) AS BIGINT) AS issues_count, {_TREND.format(a='score', b='prev')} AS trend
    FROM (SELECT check_type, {count('cur')} AS n, round(avg(CASE WHEN cur THEN pass_rate END), 2) AS score,
                 avg(CASE WHEN NOT cur THEN pass_rate END) AS prev
          FROM {_PERIODS} p WHERE check_type IN {SIX} GROUP BY 1) s WHERE n > 0"""


@query("HIS-scorecard", _SCORECARD)
def _scorecard(t):
    return dashboards.scorecard(t["runs"], NOW(LATER))


@query("HIS-scorecard.total", f"""
    SELECT round(raw, 2) AS overall_score, total_issues, critical_issues, {_TREND.format(a='raw', b='prev')} AS trend
    FROM (SELECT sum(score * weight) / sum(weight) AS raw, CAST(sum(issues_count) AS BIGINT) AS total_issues,
                 CAST(coalesce(sum(CASE WHEN score < 80 THEN issues_count END), 0) AS BIGINT) AS critical_issues
          FROM ({_SCORECARD}) s) a
    CROSS JOIN (SELECT avg(CASE WHEN NOT cur THEN pass_rate END) AS prev FROM {_PERIODS} p) b""")
def _scorecard_total(t):
    return dashboards.scorecard_total(t["runs"], NOW(LATER))


@query("HIS-column", f"""
    SELECT column_name, count(*) AS check_count, round(avg(pass_rate), 2) AS avg_pass_rate,
           CAST(sum(rows_scanned) AS BIGINT) AS total_rows_scanned,
           CAST(sum(rows_failed) AS BIGINT) AS total_rows_failed, {HEALTH.format(x='avg(pass_rate)')} AS status
    FROM (SELECT unnest(columns) AS column_name, pass_rate, rows_scanned, rows_failed FROM {CHECKS} c) x
    GROUP BY column_name""")
def _column(t):
    return dashboards.by_column(t["runs"]).orderBy("avg_pass_rate")


_GROUPED = f"""(SELECT *, CASE WHEN check_type IN ('completeness', 'uniqueness', 'consistency', 'timeliness') THEN 'structural'
    WHEN check_type IN ('validity', 'accuracy') THEN 'semantic' WHEN check_type = 'patterns' THEN 'statistical'
    ELSE 'structural' END AS dimension FROM {CHECKS} c)"""
_SUMS = """count(*) AS check_count, round(avg(pass_rate), 2) AS avg_pass_rate,
    CAST(sum(rows_scanned) AS BIGINT) AS total_rows_scanned, CAST(sum(rows_failed) AS BIGINT) AS total_rows_failed"""


@query("HIS-dimgroup", f"""
    SELECT dimension, check_type, {_SUMS}, CAST(NULL AS VARCHAR) AS status FROM {_GROUPED} g GROUP BY 1, 2
    UNION ALL SELECT dimension, NULL, {_SUMS}, {HEALTH.format(x='avg(pass_rate)')} FROM {_GROUPED} g GROUP BY 1""")
def _dimgroup(t):
    return dashboards.by_dimension_group(t["runs"])


_DS = f"SELECT dataset, check_type AS dimension, round(avg(pass_rate), 1) AS score FROM {CHECKS} c GROUP BY 1, 2"


@query("HIS-dsprofile", _DS)
def _dsprofile(t):
    return dashboards.dataset_scores(t["runs"])


@query("HIS-dsprofile.overall", f"""
    SELECT dataset, round(round(sum(score * w) / sum(w), 6), 1) AS overall_score, count(*) AS dimensions
    FROM (SELECT *, {WEIGHT.format(x='dimension')} AS w FROM ({_DS}) d) x GROUP BY dataset""")
def _dsoverall(t):
    return dashboards.dataset_overall(t["runs"])


@query("HIS-worst", f"""
    SELECT dataset, check_name, round(rate, 1) AS pass_rate FROM (
      SELECT dataset, check_name, rate, row_number() OVER (PARTITION BY dataset ORDER BY rate, check_name) AS rn
      FROM (SELECT dataset, check_name, round(avg(pass_rate), 6) AS rate FROM {CHECKS} c GROUP BY 1, 2) m) r
    WHERE rn = 1""")
def _worst(t):
    return dashboards.worst_check(t["runs"])


@query("HIS-unstable", f"""
    SELECT dataset, column_name, round(sd, 1) AS variance FROM (
      SELECT dataset, column_name, sd, row_number() OVER (PARTITION BY dataset ORDER BY sd DESC, column_name) AS rn
      FROM (SELECT dataset, column_name, round(stddev_pop(pass_rate), 6) AS sd FROM {CHECKS} c GROUP BY 1, 2) m
      WHERE sd > 0) r WHERE rn = 1""")
def _unstable(t):
    return dashboards.unstable_column(t["runs"])


@query("HIS-healthy", f"""
    SELECT dataset, CAST(floor(date_diff('second', max(seen_at), {NOW_SQL}) / 86400) AS BIGINT) AS days_since_healthy
    FROM (SELECT dataset, execution_id, min(pass_rate) AS lowest, date_trunc('second', max(created_at)) AS seen_at
          FROM {CHECKS} c GROUP BY 1, 2) e WHERE lowest >= 99.9e0 GROUP BY dataset""")
def _healthy(t):
    return dashboards.days_since_healthy(t["runs"], NOW(AS_OF))


@query("HIS-colcov", f"""
    SELECT s.dataset, s.column_name, coalesce(n, 0) AS checks_count,
           least(round(coalesce(n, 0) * 100e0 / greatest(coalesce(k, 1), 1), 1), 100e0) AS coverage_pct
    FROM (SELECT DISTINCT dataset, column_name FROM {source('schema_columns')} x) s
    LEFT JOIN (SELECT dataset, column_name, count(*) AS n FROM {CHECKS} c GROUP BY 1, 2) a
      ON s.dataset = a.dataset AND s.column_name = a.column_name
    LEFT JOIN (SELECT dataset, count(DISTINCT node_id) AS k FROM {CHECKS} c GROUP BY 1) b ON s.dataset = b.dataset""")
def _colcov(t):
    return dashboards.column_coverage(t["runs"], t["schema_columns"])


@query("HIS-inventory", f"""
    SELECT total_datasets, datasets_analyzed, datasets_analyzed_24h, total_flows, active_flows, paused_flows,
           failed_flows, avg_datasets_per_flow, avg_checks_per_flow,
           least(round(100e0 * datasets_analyzed / total_datasets, 1), 100e0) AS datasets_analyzed_pct,
           greatest(total_datasets - datasets_analyzed, 0) AS datasets_without_flows,
           round(100e0 * active_flows / total_flows, 1) AS active_flows_pct
    FROM (SELECT count(*) AS total_datasets FROM supplier) a
    CROSS JOIN (SELECT count(DISTINCT dataset) AS datasets_analyzed,
                count(DISTINCT CASE WHEN created_at >= {NOW_SQL} - INTERVAL '1' DAY THEN dataset END) AS datasets_analyzed_24h
                FROM {CHECKS} c) b
    CROSS JOIN (SELECT count(*) AS total_flows, {count("status = 'active'")} AS active_flows,
                {count("status = 'inactive'")} AS paused_flows FROM {FLOWS} f) d
    CROSS JOIN (SELECT count(DISTINCT flow_id) AS failed_flows FROM {EXECUTIONS} e
                JOIN (SELECT flow_id, max(started_at) AS m FROM {EXECUTIONS} x GROUP BY 1) l USING (flow_id)
                WHERE e.started_at = l.m AND e.status = 'failed') g
    CROSS JOIN (SELECT round(avg(ds), 1) AS avg_datasets_per_flow, round(avg(ck), 1) AS avg_checks_per_flow FROM (
                SELECT flow_id, count(DISTINCT dataset) AS ds,
                       count(DISTINCT CASE WHEN node_type = 'check' THEN node_id END) AS ck
                FROM {RUNS} r GROUP BY 1) p) h""")
def _inventory(t):
    return coverage.inventory(t["runs"], t["executions"], t["flows"], t["datasets"], NOW(AS_OF))


_TOTAL_CHECKS = f"(SELECT count(*) FROM (SELECT DISTINCT flow_id, node_id FROM {RUNS} r WHERE node_type = 'check') d)"


@query("HIS-checkinv", f"""
    SELECT total_checks, standard_checks, total_checks - standard_checks AS custom_checks,
           round(100e0 * standard_checks / total_checks, 1) AS standard_checks_pct
    FROM (SELECT {_TOTAL_CHECKS} AS total_checks, count(*) AS standard_checks FROM (
      SELECT DISTINCT check_type, flow_id, node_id FROM {RUNS} r WHERE node_type = 'check' AND check_type <> 'patterns') d) x""")
def _checkinv(t):
    return coverage.check_inventory(t["runs"])


@query("HIS-checkinv.dimension", f"""
    SELECT check_type AS dimension, count(*) AS checks FROM (
      SELECT DISTINCT check_type, flow_id, node_id FROM {RUNS} r WHERE node_type = 'check') d GROUP BY 1""")
def _checkdims(t):
    return coverage.checks_by_dimension(t["runs"])


@query("HIS-maturity", f"""
    SELECT round(100e0 * {count("owner <> ''")} / count(*), 1) AS datasets_with_owner_pct,
           round(100e0 * {count("criticality <> ''")} / count(*), 1) AS datasets_with_criticality_pct,
           round(100e0 * {count("domain <> ''")} / count(*), 1) AS datasets_with_domain_pct,
           least(round(100e0 * (SELECT count(DISTINCT dataset) FROM {RUNS} r WHERE node_type = 'check'
                 AND threshold_pass IS NOT NULL) / count(*), 1), 100e0) AS datasets_with_thresholds_pct,
           least(round(100e0 * (SELECT count(*) FROM region) / {_TOTAL_CHECKS}, 1), 100e0) AS checks_with_sla_pct
    FROM {DATASETS} d""")
def _maturity(t):
    return coverage.maturity(t["runs"], t["datasets"], t["region"])


@query("HIS-covtrend", f"""
    SELECT CAST(created_at AS DATE) AS day, count(DISTINCT dataset) AS datasets,
           count(DISTINCT execution_id) AS flows, count(DISTINCT node_id || ':' || flow_id) AS checks
    FROM {RUNS} r WHERE node_type = 'check' AND created_at >= DATE '2024-01-11' GROUP BY 1""")
def _covtrend(t):
    return coverage.coverage_trend(t["runs"], NOW(AS_OF), 20)


_SNAP = f"""SELECT CAST(created_at AS DATE) AS d, count(DISTINCT dataset) AS a, count(DISTINCT flow_id) AS b,
    count(DISTINCT node_id || ':' || flow_id) AS c FROM {CHECKS} c GROUP BY 1"""


@query("HIS-snapshot", f"""
    SELECT 'KQI-002' AS kqi_id, CAST(a AS DOUBLE) AS value, d AS snapshot_date FROM ({_SNAP}) s
    UNION ALL SELECT 'KQI-005', CAST(b AS DOUBLE), d FROM ({_SNAP}) s
    UNION ALL SELECT 'KQI-011', CAST(c AS DOUBLE), d FROM ({_SNAP}) s""")
def _snapshot(t):
    return coverage.daily_snapshot(t["runs"])


@query("HIS-snapshot.trend", f"""SELECT d AS day, a AS datasets, b AS flows, c AS checks FROM ({_SNAP}) s
    WHERE d >= DATE '2024-01-21'""")
def _snapshot_trend(t):
    return coverage.snapshot_trend(coverage.daily_snapshot(t["runs"]), NOW(AS_OF), 10)


@query("HIS-opsummary", f"""
    SELECT round(CAST(count(*) AS DOUBLE) / count(DISTINCT CAST(started_at AS DATE)), 1) AS runs_per_day,
           round(100e0 * {count("status = 'completed'")} / count(*), 1) AS success_rate,
           round(100e0 * {count("status = 'failed'")} / count(*), 1) AS failure_rate
    FROM {recent(EXECUTIONS, 'started_at', LATER_SQL)} e""")
def _opsummary(t):
    return operations.summary(t["executions"], NOW(LATER))


_STREAKS = f"""
    SELECT flow_id, count(*) AS recoveries, round(sum(epoch_us(ended) - epoch_us(started)) / 1e6, 3) AS seconds FROM (
      SELECT flow_id, streak, min(CASE WHEN bad THEN started_at END) AS started,
             min(CASE WHEN NOT bad THEN started_at END) AS ended
      FROM (SELECT *, sum(CASE WHEN bad AND NOT coalesce(before, FALSE) THEN 1 ELSE 0 END)
                      OVER (PARTITION BY flow_id ORDER BY started_at, execution_id) AS streak
            FROM (SELECT *, lag(bad) OVER (PARTITION BY flow_id ORDER BY started_at, execution_id) AS before
                  FROM (SELECT *, status = 'failed' AS bad FROM {EXECUTIONS} e
                        WHERE status IN ('failed', 'completed')) b) l) s
      WHERE streak > 0 GROUP BY 1, 2) r WHERE ended IS NOT NULL GROUP BY 1"""


@query("HIS-mttr", f"SELECT round(sum(seconds) / sum(recoveries) / 3600, 2) AS mttr_hours FROM ({_STREAKS}) s")
def _mttr(t):
    return operations.mean_time_to_recovery(t["executions"])


@query("HIS-mttr.flows", _STREAKS)
def _mttr_flows(t):
    return operations.recovery_times(t["executions"]).withColumn("seconds", F.round("seconds", 3))


@query("HIS-qsi", f"""
    SELECT round(greatest(0, 100 - stddev_pop(rate)), 1) AS quality_stability_index FROM (
      SELECT execution_id, avg(pass_rate) AS rate, max(created_at) AS seen_at FROM {recent(CHECKS, 'created_at')} c
      GROUP BY 1 ORDER BY seen_at DESC, execution_id DESC LIMIT 30) x""")
def _qsi(t):
    return operations.stability_index(t["runs"], NOW(AS_OF))


@query("HIS-timeline", f"""
    SELECT CAST(started_at AS DATE) AS day, {count("status = 'completed'")} AS success,
           {count("status = 'failed'")} AS failed, {count("status NOT IN ('completed', 'failed')")} AS partial
    FROM {recent(EXECUTIONS, 'started_at')} e GROUP BY 1""")
def _timeline(t):
    return operations.timeline(t["executions"], NOW(AS_OF))


@query("HIS-heatmap", f"""
    SELECT CAST(created_at AS DATE) AS day, node_id, max(check_name) AS check_name, round(avg(pass_rate), 1) AS value
    FROM {recent(CHECKS, 'created_at')} c GROUP BY 1, 2""")
def _heatmap(t):
    return operations.heatmap(t["runs"], NOW(AS_OF))


@query("HIS-alerts", f"""
    SELECT run_id, strftime(created_at, '%Y-%m-%d %H:%M') AS date, check_name AS "check",
           CASE WHEN pass_rate IS NULL THEN CASE status WHEN 'failed' THEN 'High' ELSE 'Medium' END
                WHEN pass_rate < 50 THEN 'Critical' WHEN pass_rate < 70 THEN 'High' WHEN pass_rate < 90 THEN 'Medium'
                ELSE 'Low' END AS severity, status <> 'failed' AS resolved
    FROM {RUNS} r WHERE node_type = 'check' AND status IN ('failed', 'warning')
    ORDER BY created_at DESC, run_id DESC LIMIT 20""")
def _alerts(t):
    return operations.recent_alerts(t["runs"])


_EFFECT = f"""
    WITH ranked AS (
      SELECT *, row_number() OVER (PARTITION BY flow_id, node_id ORDER BY created_at DESC, run_id DESC) AS nth,
             status = 'completed' AND pass_rate >= coalesce(nullif(threshold_pass, 0), 80) AS ok,
             created_at >= {LATER_SQL} - INTERVAL '30' DAY AS lately
      FROM {CHECKS} c WHERE created_at >= {LATER_SQL} - INTERVAL '90' DAY),
    kept AS (SELECT *, ok <> lead(ok) OVER (PARTITION BY flow_id, node_id ORDER BY nth) AS flip
             FROM ranked WHERE nth <= 30),
    checks AS (
      SELECT flow_id, node_id, count(*) AS total_runs, {count('ok')} AS passes, {count('flip')} AS flips,
             avg(pass_rate) AS mean_rate, {count('lately')} AS late_runs, {count('lately AND NOT ok')} AS late_fails,
             avg(CASE WHEN lately THEN pass_rate END) AS late_rate, max(CASE WHEN nth = 1 THEN check_name END) AS check_name,
             max(CASE WHEN nth = 1 THEN check_type END) AS check_type,
             max(CASE WHEN nth = 1 THEN column_name END) AS column_name, max(created_at) AS seen_at
      FROM kept GROUP BY 1, 2),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY check_type, column_name
                ORDER BY seen_at DESC, flow_id DESC, node_id DESC) AS pos FROM checks),
    judged AS (SELECT *, CASE WHEN pos > 1 THEN 'duplicate' WHEN total_runs >= 10 AND passes = total_runs THEN 'always_pass'
        WHEN late_runs >= 5 AND CAST(late_fails AS DOUBLE) / late_runs >= 0.9e0 THEN 'always_fail'
        WHEN CAST(flips AS DOUBLE) / nullif(total_runs - 1, 0) > 0.3e0 THEN 'noisy' ELSE 'effective' END AS classification
        FROM ordered),
    answer AS (SELECT flow_id, node_id, check_name, check_type, column_name, total_runs, classification,
        CASE classification WHEN 'noisy' THEN round(CAST(flips AS DOUBLE) / (total_runs - 1), 2) END AS flip_rate,
        CASE classification WHEN 'noisy' THEN round(mean_rate, 1) WHEN 'always_pass' THEN 100e0
             WHEN 'always_fail' THEN round(late_rate, 1) END AS pass_rate_30d FROM judged)"""


@query("HIS-effect", _EFFECT + " SELECT * FROM answer")
def _effect(t):
    return effectiveness.classify(t["runs"], NOW(LATER))


def _kind(name: str) -> str:
    return count(f"classification = '{name}'")


@query("HIS-effscore", _EFFECT + f""" SELECT {_kind('noisy')} AS noisy_checks_count,
    {_kind('always_pass')} AS always_passing_count, {_kind('always_fail')} AS always_failing_count,
    {_kind('duplicate')} AS duplicate_checks_count, {_kind('effective')} AS effective_count,
    round(100e0 * {_kind('effective')} / count(*), 1) AS effectiveness_score FROM answer""")
def _effscore(t):
    return effectiveness.score(effectiveness.classify(t["runs"], NOW(LATER)))


@query("HIS-effscore.problematic", _EFFECT + """ SELECT flow_id, node_id, check_name, classification, flip_rate,
    pass_rate_30d FROM answer WHERE classification <> 'effective'
    ORDER BY CASE classification WHEN 'noisy' THEN 0 WHEN 'always_pass' THEN 1 WHEN 'always_fail' THEN 2 ELSE 3 END,
             flow_id, node_id LIMIT 20 OFFSET 20""")
def _problematic(t):
    return effectiveness.problematic(effectiveness.classify(t["runs"], NOW(LATER)), page=2).drop("recommendation")


@query("HIS-report", f"""
    SELECT execution_id, flow_id, count(*) AS total_nodes, {count("status = 'failed'")} AS nodes_failed,
           {count("node_type = 'check'")} AS total_checks,
           {count("node_type = 'check' AND pass_rate >= coalesce(threshold_pass, 100)")} AS passed_checks,
           CAST(coalesce(sum(CASE WHEN node_type = 'check' THEN rows_failed END), 0) AS BIGINT) AS total_violations,
           min(created_at) AS executed_at,
           round(100e0 * {count("node_type = 'check' AND pass_rate >= coalesce(threshold_pass, 100)")}
                 / nullif({count("node_type = 'check'")}, 0), 2) AS overall_quality_score
    FROM {RUNS} r GROUP BY 1, 2""")
def _report(t):
    return dashboards.execution_report(t["runs"])


@query("HIS-report.violations", f"""
    SELECT execution_id, run_id, node_id, check_type, column_name, dataset, rows_failed AS failed_rows,
           rows_scanned AS total_rows, round(100e0 * rows_failed / rows_scanned, 2) AS failure_rate
    FROM {RUNS} r WHERE node_type = 'check' AND rows_failed > 0""")
def _report_violations(t):
    return dashboards.execution_violations(t["runs"])


@query("HIS-report.nodes", f"""
    SELECT execution_id, node_id, node_type, status, CAST(row_number() OVER (PARTITION BY execution_id ORDER BY created_at, node_id) AS INTEGER) AS position,
           epoch_us(created_at) AS started_us, epoch_us(created_at) + duration_seconds * 1000000 AS ended_us, duration_seconds,
           CASE WHEN node_type = 'check' THEN CASE WHEN pass_rate >= coalesce(threshold_pass, 100) THEN 'passed' ELSE 'failed' END END AS result
    FROM {RUNS} r""")
def _report_nodes(t):
    nodes = dashboards.execution_nodes(t["runs"])
    return nodes.withColumns({"started_us": F.unix_micros(F.col("started_at").cast("timestamp")), "ended_us": F.unix_micros("ended_at")}).drop("started_at", "ended_at")


# --- anomalies ---
derive("hectic", "events", [
    "event_id AS execution_id", "user_id % 10 AS flow_id", "ts AS started_at",
    "CASE WHEN event_type = 'error' OR ts >= TIMESTAMP '2024-01-30 00:00:00' THEN 'failed' ELSE 'completed' END AS status"])
_HECTIC = source("hectic")
_RULES = source("rule_runs")
_DROPS = f"""
    SELECT 'pass_rate_drop' AS anomaly_type, CAST(rule_id AS VARCHAR) AS subject,
           CASE WHEN z < -3 THEN 'Critical' WHEN z < -2.5 THEN 'High' ELSE 'Medium' END AS severity,
           CAST(seen_at AS DATE) AS detected_on, round(latest, 4) AS current_value, round(mu, 4) AS expected_value,
           round(z, 4) AS z_score
    FROM (SELECT *, (latest - mu) / nullif(sd, 0) AS z FROM (
            SELECT rule_id, avg(pass_rate) AS mu, stddev_samp(pass_rate) AS sd, count(*) AS n,
                   arg_max(pass_rate, (epoch_us(started_at), run_id)) AS latest, max(started_at) AS seen_at
            FROM {_RULES} r WHERE status = 'completed' AND started_at >= {NOW_SQL} - INTERVAL '30' DAY
            GROUP BY 1) a) b WHERE n >= 3 AND z < {{limit}}"""


@query("ANO-passrate", _DROPS.format(limit=-2))
def _passrate(t):
    return anomaly.pass_rate_drops(t["rule_runs"], NOW(AS_OF)).drop("summary")


_DAILY = f"""SELECT CAST(started_at AS DATE) AS day, count(*) AS total_executions,
    {count("status = 'failed'")} AS failed_executions, {count("status = 'completed'")} AS successful_executions
    FROM {{frm}} e WHERE started_at >= {NOW_SQL} - INTERVAL '30' DAY GROUP BY 1"""


@query("ANO-voltrend", _DAILY.format(frm=EXECUTIONS))
def _voltrend(t):
    return anomaly.daily_volume(t["executions"], NOW(AS_OF))


def _latest_sql(kind: str, value: str, test: str, severity: str, daily: str) -> str:
    return f"""
    SELECT '{kind}' AS anomaly_type, 'All flows' AS subject, {severity} AS severity, day AS detected_on,
           round(latest, 4) AS current_value, round(mu, 4) AS expected_value, round(z, 4) AS z_score
    FROM (SELECT *, (latest - mu) / nullif(sd, 0) AS z FROM (
      SELECT avg({value}) AS mu, stddev_pop({value}) AS sd, count(*) AS n, arg_max({value}, day) AS latest,
             max(day) AS day FROM ({daily}) d) a) b WHERE n >= 3 AND {test}"""


_SPIKE = _latest_sql("failure_spike", "failed_executions * 100e0 / total_executions", "z > 2",
                     "CASE WHEN z > 3 THEN 'Critical' ELSE 'High' END", _DAILY.format(frm=_HECTIC))


@query("ANO-failspike", _SPIKE)
def _failspike(t):
    return anomaly.failure_spike(t["hectic"], NOW(AS_OF)).drop("summary")


# The last day of this history is cut short, so its volume drops.
derive("short_day", "events", [
    "event_id AS execution_id", "'completed' AS status",
    "CASE WHEN ts >= TIMESTAMP '2024-01-30 08:00:00' THEN NULL ELSE ts END AS started_at"])
_VOLUME = _latest_sql("volume_anomaly", "CAST(total_executions AS DOUBLE)", "abs(z) > 2",
                      "CASE WHEN abs(z) > 3 THEN 'High' ELSE 'Medium' END", _DAILY.format(frm=source("short_day")))


@query("ANO-volume", _VOLUME)
def _volume(t):
    return anomaly.volume_anomaly(t["short_day"], NOW(AS_OF)).drop("summary")


_ALL = (f"{_DROPS.format(limit=-2)} UNION ALL {_SPIKE} UNION ALL "
        + _latest_sql("volume_anomaly", "CAST(total_executions AS DOUBLE)", "abs(z) > 2",
                      "CASE WHEN abs(z) > 3 THEN 'High' ELSE 'Medium' END", _DAILY.format(frm=_HECTIC)))


def _detected(t):
    return anomaly.detect(t["rule_runs"], t["hectic"], NOW(AS_OF))


@query("ANO-summary", f"""SELECT count(*) AS total_anomalies, {count("severity = 'Critical'")} AS critical_anomalies,
    {count("severity = 'High'")} AS high_anomalies, {count("severity = 'Medium'")} AS medium_anomalies,
    {count("severity = 'Low'")} AS low_anomalies FROM ({_ALL}) a""")
def _ano_summary(t):
    return anomaly.summary(_detected(t))


_SUGGEST = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in anomaly.SUGGESTIONS.items())
_ACTION = " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in anomaly.SUGGESTIONS.items())


@query("ANO-suggest", f"""
    SELECT CASE anomaly_type {_SUGGEST} END AS signal,
           CASE WHEN anomaly_type = 'failure_spike' OR (anomaly_type = 'pass_rate_drop' AND
                max(CASE WHEN severity = 'Critical' THEN 1 ELSE 0 END) = 1) THEN 'P1' ELSE 'P2' END AS priority,
           CASE anomaly_type {_ACTION} END AS action FROM ({_ALL}) a GROUP BY anomaly_type""")
def _suggest(t):
    return anomaly.suggestions(_detected(t))


# Anomalies already on record: one per rule, some closed or too old to take an update.
derive("recorded", "rule_runs", [
    "run_id AS anomaly_id", "sha1('w1|pass_rate_drop||value|' || CAST(rule_id AS STRING)) AS fingerprint",
    "CASE WHEN run_id % 3 = 0 THEN 'resolved' WHEN run_id % 3 = 1 THEN 'open' ELSE 'acknowledged' END AS status",
    "started_at AS detected_at"])
_FOUND = f"""(SELECT DISTINCT sha1('w1|pass_rate_drop||value|' || CAST(rule_id AS VARCHAR)) AS fingerprint, rule_id
              FROM {_RULES} r WHERE status = 'failed')"""


@query("ANO-dedupe", f"""
    SELECT f.fingerprint, f.rule_id, x.anomaly_id,
           CASE WHEN x.anomaly_id IS NULL THEN 'insert' ELSE 'update' END AS action
    FROM {_FOUND} f LEFT JOIN (
      SELECT fingerprint, arg_max(anomaly_id, (epoch_us(detected_at), anomaly_id)) AS anomaly_id
      FROM {source('recorded')} e WHERE status IN ('open', 'acknowledged')
        AND detected_at >= {NOW_SQL} - INTERVAL '24' HOUR GROUP BY 1) x ON f.fingerprint = x.fingerprint""")
def _dedupe(t):
    found = t["rule_runs"].where("status = 'failed'").select("rule_id").distinct().select(
        "rule_id", anomaly.fingerprint(F.lit("w1"), F.lit("pass_rate_drop"), F.lit(None),
                                       F.lit("value"), F.col("rule_id")).alias("fingerprint"))
    return anomaly.plan_upsert(found, t["recorded"], NOW(AS_OF))


# Two deliveries, the first of them twice: live anomalies take the last fields, others are inserted once.
@query("ANO-dedupe.applied", f"""
    SELECT fingerprint, status, severity, seen_us, count(*) AS anomalies FROM (
      SELECT r.fingerprint, r.status, CASE WHEN x.anomaly_id IS NOT NULL THEN 'Critical' END AS severity,
             epoch_us(CASE WHEN x.anomaly_id IS NOT NULL THEN {NOW_SQL} + INTERVAL '1' HOUR ELSE r.detected_at END) AS seen_us
      FROM {source('recorded')} r LEFT JOIN (
        SELECT arg_max(anomaly_id, (epoch_us(detected_at), anomaly_id)) AS anomaly_id
        FROM {source('recorded')} e JOIN {_FOUND} f USING (fingerprint) WHERE status IN ('open', 'acknowledged')
          AND detected_at >= {NOW_SQL} - INTERVAL '24' HOUR GROUP BY fingerprint) x ON r.anomaly_id = x.anomaly_id
      UNION ALL
      SELECT fingerprint, 'open', 'Critical', epoch_us({NOW_SQL} + INTERVAL '1' HOUR) FROM {_FOUND} f
      WHERE fingerprint NOT IN (SELECT fingerprint FROM {source('recorded')} e WHERE status IN ('open', 'acknowledged')
        AND detected_at >= {NOW_SQL} - INTERVAL '24' HOUR)) a
    GROUP BY 1, 2, 3, 4""")
def _applied(t):
    found = t["rule_runs"].where("status = 'failed'").select(anomaly.fingerprint(
        F.lit("w1"), F.lit("pass_rate_drop"), F.lit(None), F.lit("value"), F.col("rule_id")).alias("fingerprint")).distinct()
    root = scratch_path(found.sparkSession, "anomalies")
    first = datetime.fromisoformat(AS_OF)
    for severity, delivery, at in (("High", "a", first), ("High", "a", first), ("Critical", "b", first + timedelta(hours=1))):
        rows = anomaly.record_anomalies(found.withColumn("severity", F.lit(severity)), root, delivery, at, start=t["recorded"])
    return rows.groupBy("fingerprint", "status", "severity", F.unix_micros("detected_at").alias("seen_us")).agg(F.count("*").alias("anomalies"))


# --- issues and incidents ---
_SEVERITY = """CASE lower(severity) WHEN 'blocker' THEN 'critical' WHEN 'high' THEN 'major' WHEN 'medium' THEN 'minor'
    WHEN 'low' THEN 'informational' ELSE 'minor' END"""
_HOURS = "CASE {s} WHEN 'critical' THEN 4 WHEN 'major' THEN 8 WHEN 'informational' THEN 72 ELSE 24 END"


@query("INC-severity", f"SELECT run_id, severity, {_SEVERITY} AS issue_severity FROM {_RULES} r")
def _severity(t):
    return t["rule_runs"].select("run_id", "severity",
                                 incidents.issue_severity(F.col("severity")).alias("issue_severity"))


@query("INC-issue", f"""
    SELECT run_id, rule_id, dataset_id, {_SEVERITY} AS severity,
           '[' || upper({_SEVERITY}) || '] ' || rule_name AS title,
           rows_failed AS failure_count, epoch_us(completed_at) AS opened_us,
           epoch_us(completed_at) + {_HOURS.format(s=_SEVERITY)} * 3600000000::BIGINT AS due_us
    FROM {_RULES} r WHERE status = 'completed' AND rows_failed > 0""")
def _issue(t):
    issues = incidents.derive_issues(t["rule_runs"])
    return issues.select("run_id", "rule_id", "dataset_id", "severity", "title", "failure_count",
                         F.unix_micros(F.col("opened_at").cast("timestamp")).alias("opened_us"),
                         F.unix_micros("due_at").alias("due_us"))


derive("failures", "rule_runs", ["run_id", "rule_id", "dataset_id", "rows_failed", "completed_at"])
derive("open_issues", "rule_runs", [
    "run_id + 1000000 AS issue_id", "rule_id", "dataset_id", "rows_failed AS failure_count",
    "CASE WHEN run_id % 50 = 0 THEN 'open' WHEN run_id % 50 = 1 THEN 'reopened' ELSE 'closed' END AS status",
    "started_at AS opened_at"])


def _group_sql(day: str, alone: str) -> str:
    """``day`` maps a UTC timestamp to the grouping day, ``alone`` marks single issues."""
    return f"""
    WITH f AS (SELECT *, {day.format(ts='completed_at')} AS day, CASE WHEN {alone} THEN run_id END AS own
               FROM {source('failures')} x),
    b AS (SELECT rule_id, dataset_id, day, own, sum(rows_failed) AS added, count(*) AS failures,
                 min(completed_at) AS first_seen, max(completed_at) AS last_seen_at FROM f GROUP BY 1, 2, 3, 4),
    o AS (SELECT *, row_number() OVER (PARTITION BY rule_id, dataset_id, day ORDER BY opened_at DESC, issue_id DESC) AS rn
          FROM (SELECT *, {day.format(ts='opened_at')} AS day FROM {source('open_issues')} y
                WHERE status IN ('open', 'in_progress', 'reopened')) z)
    SELECT b.rule_id, b.dataset_id, o.issue_id, CASE WHEN o.issue_id IS NULL THEN 'insert' ELSE 'update' END AS action,
           b.failures, CAST(coalesce(o.failure_count, 0) + b.added AS BIGINT) AS failure_count,
           coalesce(o.opened_at, b.first_seen) AS opened_at, b.last_seen_at
    FROM b LEFT JOIN o ON b.rule_id = o.rule_id AND b.dataset_id = o.dataset_id AND o.rn = 1
         AND b.own IS NULL AND (b.day = o.day OR (b.day IS NULL AND o.day IS NULL))"""


_NO_HOME = "rule_id IS NULL OR dataset_id IS NULL"


@query("INC-group", _group_sql("CAST(NULL AS DATE)", _NO_HOME))
def _group_rule(t):
    return incidents.group_failures(t["failures"], t["open_issues"], "one_per_rule")


# A run now and then resolves what is open for its rule and dataset; later failures open anew.
derive("resolutions", "rule_runs", ["rule_id", "dataset_id", "CASE WHEN run_id % 7 = 3 THEN completed_at END AS resolved_at"])


def _resolved_sql(day: str) -> str:
    return f"""
    WITH r AS (SELECT * FROM {source('resolutions')} x WHERE resolved_at IS NOT NULL),
    n AS (SELECT f.run_id, count(r.resolved_at) AS stretch FROM {source('failures')} f
          LEFT JOIN r ON f.rule_id = r.rule_id AND f.dataset_id = r.dataset_id AND r.resolved_at <= f.completed_at GROUP BY 1),
    f AS (SELECT x.*, stretch, {day.format(ts='completed_at')} AS day, CASE WHEN {_NO_HOME} THEN run_id END AS own
          FROM {source('failures')} x JOIN n USING (run_id)),
    b AS (SELECT rule_id, dataset_id, day, own, stretch, sum(rows_failed) AS added, count(*) AS failures,
                 min(completed_at) AS first_seen, max(completed_at) AS last_seen_at FROM f GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY rule_id, dataset_id, day ORDER BY opened_at DESC, issue_id DESC) AS rn
          FROM (SELECT *, {day.format(ts='opened_at')} AS day FROM {source('open_issues')} y
                WHERE status IN ('open', 'in_progress', 'reopened')) z),
    ends AS (SELECT rule_id, dataset_id, resolved_at, row_number() OVER (PARTITION BY rule_id, dataset_id ORDER BY resolved_at) AS nth FROM r)
    SELECT b.rule_id, b.dataset_id, o.issue_id, CASE WHEN o.issue_id IS NULL THEN 'insert' ELSE 'update' END AS action,
           b.failures, CAST(coalesce(o.failure_count, 0) + b.added AS BIGINT) AS failure_count,
           coalesce(o.opened_at, b.first_seen) AS opened_at, b.last_seen_at, e.resolved_at
    FROM b LEFT JOIN o ON b.rule_id = o.rule_id AND b.dataset_id = o.dataset_id AND o.rn = 1
         AND b.own IS NULL AND b.stretch = 0 AND (b.day = o.day OR (b.day IS NULL AND o.day IS NULL))
    LEFT JOIN ends e ON b.rule_id = e.rule_id AND b.dataset_id = e.dataset_id AND e.nth = b.stretch + 1"""


@query("INC-group.resolved", _resolved_sql("CAST(NULL AS DATE)"))
def _group_resolved(t):
    return incidents.group_failures(t["failures"], t["open_issues"], "one_per_rule", resolutions=t["resolutions"])


@query("INC-group.resolved_day", _resolved_sql("CAST({ts} + INTERVAL '5' HOUR AS DATE)"))
def _group_resolved_day(t):
    return incidents.group_failures(t["failures"], t["open_issues"], "one_per_day", "Etc/GMT-5", t["resolutions"])


# Etc/GMT-5 is five hours east of Greenwich, without daylight saving.
@query("INC-group.day", _group_sql("CAST({ts} + INTERVAL '5' HOUR AS DATE)", _NO_HOME))
def _group_day(t):
    return incidents.group_failures(t["failures"], t["open_issues"], "one_per_day", "Etc/GMT-5")


@query("INC-group.execution", _group_sql("CAST(NULL AS DATE)", "TRUE"))
def _group_execution(t):
    return incidents.group_failures(t["failures"], t["open_issues"], "one_per_execution")


ISSUES, INCIDENTS, LINKS = (source(n) for n in ("issues", "incidents", "incident_issues"))


@query("INC-auto", f"""
    SELECT issue_id, '[Auto] ' || title AS title, severity,
           CASE severity WHEN 'critical' THEN 'P1' ELSE 'P2' END AS priority, 'open' AS status
    FROM {ISSUES} i WHERE severity IN ('critical', 'major') AND failure_count >= 3
      AND issue_id NOT IN (SELECT issue_id FROM {LINKS} l WHERE issue_id IS NOT NULL)""")
def _auto(t):
    return incidents.auto_incidents(t["issues"], t["incident_issues"], recurrence=3)


def _each(column: str, values, prefix: str, only: str = "TRUE") -> str:
    return ", ".join(f"{count(f'{column} = {chr(39)}{v}{chr(39)} AND {only}')} AS {prefix}_{v.lower()}" for v in values)


_SEV = ("critical", "major", "minor", "info")


@query("INC-counts", f"""SELECT {_each('status', ('open', 'resolved', 'closed'), 'status')},
    {_each('severity', _SEV, 'severity', "status IN ('open', 'resolved', 'closed')")} FROM {ISSUES} i""")
def _issue_counts(t):
    return incidents.issue_counts(t["issues"])


@query("INC-counts.incidents", f"""SELECT {_each('status', ('open', 'acknowledged', 'resolved', 'closed'), 'status')},
    {_each('severity', _SEV, 'severity')}, {_each('priority', ('P1', 'P2', 'P3', 'P4'), 'priority')} FROM {INCIDENTS} i""")
def _incident_counts(t):
    return incidents.incident_counts(t["incidents"])


_LATE = f"(SELECT * FROM {ISSUES} i WHERE status = 'open' AND due_at < {CLOSING_SQL})"


@query("INC-overdue", f"""SELECT count(*) AS overdue_issues, (SELECT count(DISTINCT incident_id) FROM {LINKS} l
    WHERE issue_id IN (SELECT issue_id FROM {_LATE} x)) AS incidents_breached FROM {_LATE} y""")
def _overdue(t):
    return incidents.overdue_counts(t["issues"], t["incident_issues"], NOW(CLOSING))


@query("INC-restime", f"""
    SELECT round(avg(h), 2) AS avg_hours, count(*) AS total_resolved, round(quantile_cont(h, 0.5), 2) AS median_hours,
           round(max(CASE WHEN i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) THEN h END), 2) AS p95_hours
    FROM (SELECT h, row_number() OVER (ORDER BY h) - 1 AS i, count(*) OVER () AS n FROM (
      SELECT (epoch_us(resolved_at) - epoch_us(opened_at)) / 3.6e9 AS h FROM {ISSUES} i) a WHERE h >= 0) b""")
def _restime(t):
    return incidents.resolution_times(t["issues"])


_JUDGED = f"""(SELECT *, elapsed > target AS breached FROM (
    SELECT *, coalesce(severity, 'minor') AS sev, {_HOURS.format(s="coalesce(severity, 'minor')")} AS target,
           (epoch_us(coalesce(resolved_at, {CLOSING_SQL})) - epoch_us(opened_at)) / 3.6e9 AS elapsed
    FROM {INCIDENTS} i {{where}}) e)"""
_RECENT = f"WHERE opened_at >= {CLOSING_SQL} - INTERVAL '{{days}}' DAY"


@query("INC-sla", f"""
    SELECT count(*) AS total_incidents, {count('breached')} AS breaches_count,
           round(avg(CASE WHEN breached THEN elapsed - target END), 1) AS avg_breach_duration_hours,
           round(avg(CASE WHEN resolved_at IS NOT NULL THEN elapsed END), 1) AS mttr_hours,
           count(resolved_at) AS resolved_count, round(100e0 * {count('NOT breached')} / count(*), 1) AS compliance_rate,
           count(*) - count(resolved_at) AS open_count FROM {_JUDGED.format(where=_RECENT.format(days=365))} j""")
def _sla(t):
    return incidents.sla_metrics(t["incidents"], NOW(CLOSING), 365)


@query("INC-breachsev", f"""SELECT upper(sev[1]) || sev[2:] AS name, count(*) AS value
    FROM {_JUDGED.format(where=_RECENT.format(days=90))} j WHERE breached GROUP BY 1""")
def _breachsev(t):
    return incidents.breaches_by_severity(t["incidents"], NOW(CLOSING), 90)


@query("INC-slatrend", f"""
    SELECT CAST(a AS DATE) AS week_start, strftime(a, '%b %d') AS label,
           CASE WHEN count(j.incident_id) = 0 THEN 100e0 ELSE
             round(100e0 * {count('NOT breached')} / count(j.incident_id), 1) END AS compliance,
           {count('breached')} AS breaches
    FROM (SELECT {CLOSING_SQL} - INTERVAL '7' DAY * CAST(range + 1 AS INT) AS a,
                 {CLOSING_SQL} - INTERVAL '7' DAY * CAST(range AS INT) AS b FROM range(8)) w
    LEFT JOIN {_JUDGED.format(where='')} j ON j.opened_at >= w.a AND j.opened_at < w.b GROUP BY a""")
def _slatrend(t):
    return incidents.sla_trend(t["incidents"], NOW(CLOSING))


@query("INC-slalist", f"""
    SELECT incident_id, upper(sev[1]) || sev[2:] AS severity, coalesce(priority, 'P3') AS priority,
           upper(status[1]) || status[2:] AS status, CAST(target AS DOUBLE) AS sla_target_hours,
           round(elapsed, 1) AS elapsed_hours, breached FROM {_JUDGED.format(where=_RECENT.format(days=60))} j
    ORDER BY opened_at DESC, incident_id DESC LIMIT 20 OFFSET 20""")
def _slalist(t):
    return incidents.sla_list(t["incidents"], NOW(CLOSING), 60, page=2)


_COST = "CASE severity WHEN 'critical' THEN 15000e0 WHEN 'major' THEN 5000e0 WHEN 'minor' THEN 1000e0 WHEN 'info' THEN 200e0 ELSE 0e0 END"
_CAUGHT = f"(SELECT * FROM {ISSUES} i {_RECENT.format(days=90)})"


@query("INC-value", f"""
    SELECT count(*) AS issues_caught, {count(f'''severity IN ('critical', 'major') AND resolved_at IS NOT NULL
           AND issue_id NOT IN (SELECT issue_id FROM {LINKS} l WHERE issue_id IS NOT NULL)''')} AS estimated_incidents_avoided,
           round(sum({_COST}), 2) AS estimated_cost_saved_usd FROM {_CAUGHT} c""")
def _value(t):
    return incidents.value_summary(t["issues"], t["incident_issues"], NOW(CLOSING), 90)


@query("INC-value.trend", f"""
    SELECT CAST(d.day AS DATE) AS day, count(issue_id) AS issues FROM (
      SELECT unnest(generate_series({CLOSING_SQL} - INTERVAL '30' DAY, {CLOSING_SQL}, INTERVAL '1' DAY)) AS day) d
    LEFT JOIN (SELECT * FROM {ISSUES} i {_RECENT.format(days=30)}) c ON CAST(opened_at AS DATE) = CAST(d.day AS DATE)
    GROUP BY 1""")
def _value_trend(t):
    return incidents.value_trend(t["issues"], NOW(CLOSING))


@query("INC-topflows", f"""
    SELECT flow_id, count(*) AS issues_caught, {count("severity = 'critical'")} AS critical_issues,
           round(sum({_COST}), 2) AS estimated_value_usd FROM {_CAUGHT} c GROUP BY 1
    ORDER BY estimated_value_usd DESC, flow_id LIMIT 5""")
def _topflows(t):
    return incidents.top_flows(t["issues"], NOW(CLOSING), 90, limit=5)


@query("INC-escalate", f"""
    SELECT alert_rule_id, r.workspace_id, coalesce(channel, recipient) AS sent_to, overdue_issues, earliest_due
    FROM {source('alert_rules')} r JOIN (
      SELECT workspace_id, count(*) AS overdue_issues, min(due_at) AS earliest_due FROM {ISSUES} i
      WHERE status IN ('open', 'in_progress', 'reopened') AND due_at < {CLOSING_SQL} GROUP BY 1) l
      ON r.workspace_id = l.workspace_id
    WHERE enabled AND event = 'issue_overdue' AND coalesce(channel, recipient) IS NOT NULL""")
def _escalate(t):
    return incidents.escalate(t["issues"], t["alert_rules"], NOW(CLOSING))


@query("INC-escalate.issues", f"""
    SELECT alert_rule_id, r.workspace_id, coalesce(channel, recipient) AS sent_to, issue_id, severity, due_at
    FROM {source('alert_rules')} r JOIN {ISSUES} i ON r.workspace_id = i.workspace_id
    WHERE enabled AND event = 'issue_overdue' AND coalesce(channel, recipient) IS NOT NULL
      AND i.status IN ('open', 'in_progress', 'reopened') AND due_at < {CLOSING_SQL}""")
def _escalated_issues(t):
    return incidents.escalated_issues(t["issues"], t["alert_rules"], NOW(CLOSING))


_ALERT_RULES = {
    "any": None, "failed": {"status": "failed"}, "types": {"check_type": ["validity", "accuracy"], "status": {"ne": "completed"}},
    "members": {"flow_id": {"in": [1, 2, 3]}, "node_type": {"eq": "check"}}, "unknown": {"status": {"like": "f%"}},
    "missing": {"threshold_pass": None},
}


@query("INC-alertmatch", f"""
    SELECT run_id, alert_rule FROM (
      SELECT run_id, 'any' AS alert_rule FROM {RUNS} r
      UNION ALL SELECT run_id, 'failed' FROM {RUNS} r WHERE status = 'failed'
      UNION ALL SELECT run_id, 'types' FROM {RUNS} r WHERE check_type IN ('validity', 'accuracy') AND status <> 'completed'
      UNION ALL SELECT run_id, 'members' FROM {RUNS} r WHERE flow_id IN (1, 2, 3) AND node_type = 'check'
      UNION ALL SELECT run_id, 'missing' FROM {RUNS} r WHERE threshold_pass IS NULL) m""")
def _alertmatch(t):
    return incidents.match_alerts(t["runs"], _ALERT_RULES).select("run_id", "alert_rule")
