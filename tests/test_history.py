"""Sequential history rules against step-by-step simulations."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veritab.history import anomaly, coverage, dashboards, effectiveness, incidents, operations
from veritab.sources.sinks import fixed_width

START = datetime(2024, 3, 1)


def at(hours):
    return START + timedelta(hours=hours)


@pytest.mark.parametrize("seed", range(3))
def test_recovery_times(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), rng.choice(["failed", "completed", "running"]), at(rng.uniform(0, 30)))
            for i in range(200)]
    expected = {}
    for flow in range(3):
        started, spans = None, []
        for _, _, status, ts in sorted((r for r in rows if r[1] == flow), key=lambda r: r[3]):
            if status == "failed" and started is None:
                started = ts
            elif status == "completed" and started is not None:
                spans.append((ts - started).total_seconds())
                started = None
        expected[flow] = (len(spans), pytest.approx(sum(spans), abs=1e-3))
    df = spark.createDataFrame(rows, "execution_id int, flow_id int, status string, started_at timestamp")
    got = {r.flow_id: (r.recoveries, r.seconds) for r in operations.recovery_times(df).collect()}
    assert got == expected
    spans = sum(v[0] for v in expected.values())
    hours = sum(v[1].expected for v in expected.values()) / spans / 3600
    assert operations.mean_time_to_recovery(df).first()[0] == pytest.approx(hours, abs=0.006)


def test_no_recovery_is_null(spark):
    df = spark.createDataFrame([(1, 1, "failed", START)],
                               "execution_id int, flow_id int, status string, started_at timestamp")
    assert operations.mean_time_to_recovery(df).first()[0] is None


@pytest.mark.parametrize("policy", ["one_per_execution", "one_per_rule", "one_per_day"])
def test_grouping_equals_one_by_one(spark, policy):
    rng = random.Random(8)
    failures = sorted(((i, rng.choice([1, 2, None]), rng.choice([10, 11]), rng.randrange(1, 9),
                        at(rng.uniform(0, 100))) for i in range(60)), key=lambda f: f[4])
    issues = [(900, 1, 10, "open", 5, at(-3)), (901, 1, 10, "reopened", 7, at(-30)), (902, 2, 11, "closed", 1, at(-1)),
              (903, 2, 10, "in_progress", 2, at(26))]
    day = lambda ts: ts.date()
    live = [dict(id=i, rule=r, ds=d, n=n, opened=o, new=False, hits=0)
            for i, r, d, s, n, o in issues if s in incidents.OPEN_STATUSES]
    for run, rule, ds, rows, ts in failures:
        found = [x for x in live if x["rule"] == rule and x["ds"] == ds and rule is not None
                 and (policy != "one_per_day" or day(x["opened"]) == day(ts))]
        if policy == "one_per_execution" or not found:
            live.append(dict(id=None, rule=rule, ds=ds, n=rows, opened=ts, new=True, hits=1))
            if policy == "one_per_execution" or rule is None:
                live[-1]["rule"] = ("alone", run, rule)
            continue
        target = max(found, key=lambda x: x["opened"])
        target["n"] += rows
        target["hits"] += 1
    unwrap = lambda r: r[2] if isinstance(r, tuple) else r
    expected = sorted((str(x["id"]), str(unwrap(x["rule"])), x["ds"], x["n"], x["hits"]) for x in live if x["hits"])
    got = incidents.group_failures(
        spark.createDataFrame(failures, "run_id int, rule_id int, dataset_id int, rows_failed int, completed_at timestamp"),
        spark.createDataFrame(issues, "issue_id int, rule_id int, dataset_id int, status string, failure_count int, opened_at timestamp"),
        policy)
    assert sorted((str(r.issue_id), str(r.rule_id), r.dataset_id, r.failure_count, r.failures)
                  for r in got.collect()) == expected


def test_classes_of_checks(spark):
    now = at(24 * 60)
    rows, run = [], 0

    def add(node, rates, kind, column, hours=2):
        nonlocal run
        for i, rate in enumerate(rates):
            run += 1
            rows.append((run, run, 1, node, "check", "completed", kind, f"name {node}", column, float(rate), 50.0,
                         now - timedelta(hours=hours * (len(rates) - i))))

    add("steady", [90] * 12, "a", "c1")
    add("broken", [10] * 6, "b", "c2")
    add("jumpy", [90, 10] * 4, "c", "c3")
    add("useful", [90] * 6 + [10, 10], "d", "c4")
    add("older twin", [90, 90, 10, 10, 90], "d", "c4", hours=30)
    add("old streak", [10] * 50 + [90] * 30, "e", "c5")
    df = spark.createDataFrame(rows, """run_id int, execution_id int, flow_id int, node_id string, node_type string,
        status string, check_type string, check_name string, column_name string, pass_rate double,
        threshold_pass double, created_at timestamp""")
    classified = effectiveness.classify(df, F.lit(str(now)).cast("timestamp"))
    got = {r.node_id: r.classification for r in classified.collect()}
    assert got == {"steady": "always_pass", "broken": "always_fail", "jumpy": "noisy", "useful": "effective",
                   "older twin": "duplicate", "old streak": "always_pass"}
    score = effectiveness.score(classified).first()
    assert (score.effective_count, score.effectiveness_score) == (1, 16.7)
    listed = effectiveness.problematic(classified, page=1, page_size=3).collect()
    assert [r.node_id for r in listed] == ["jumpy", "old streak", "steady"]
    assert all(r.recommendation for r in listed)


def test_anomalies_and_texts(spark):
    now = F.lit(str(at(24 * 10))).cast("timestamp")
    runs = spark.createDataFrame(
        [(i, 1, "completed", 95.0 + i % 2, at(i)) for i in range(20)] + [(99, 1, "completed", 40.0, at(30))],
        "run_id int, rule_id int, status string, pass_rate double, started_at timestamp")
    executions = spark.createDataFrame(
        [(d * 10 + i, 1, "failed" if d == 9 else "completed", at(d * 24 + i)) for d in range(10) for i in range(10)],
        "execution_id int, flow_id int, status string, started_at timestamp")
    found = {r.anomaly_type: r for r in anomaly.detect(runs, executions, now).collect()}
    assert set(found) == {"pass_rate_drop", "failure_spike"}
    assert found["pass_rate_drop"].severity == "Critical"
    assert found["failure_spike"].summary == "Failure rate spike (100.0% vs avg 10.0%)"
    nothing = anomaly.detect(runs.where("run_id < 20"), executions.where("execution_id < 90"), now)
    assert [r.signal for r in anomaly.suggestions(nothing).collect()] == ["All systems nominal"]


def test_alert_conditions(spark):
    df = spark.createDataFrame([(1, "failed", None), (2, "ok", "x")], "id int, status string, note string")
    rules = {"all": {}, "eq": {"status": "failed"}, "ne": {"status": {"ne": "failed"}}, "list": {"status": ["ok", "odd"]},
             "null": {"note": None}, "in null": {"note": {"in": [None, "y"]}}, "odd": {"status": {"gt": 1}},
             "both": {"status": "ok", "note": {"eq": "x"}}}
    got = {(r.id, r.alert_rule) for r in incidents.match_alerts(df, rules).collect()}
    assert got == {(1, "all"), (2, "all"), (1, "eq"), (2, "ne"), (2, "list"), (1, "null"), (1, "in null"), (2, "both")}


def test_issue_texts_and_titles(spark):
    df = spark.createDataFrame(
        [(1, 7, "x" * 600, 3, "High", "completed", 1000, 150, 85.0, START), (2, 7, "r", 3, "odd", "completed", 10, 0, 100.0, START)],
        """run_id int, rule_id int, rule_name string, dataset_id int, severity string, status string, rows_scanned int,
        rows_failed int, pass_rate double, completed_at timestamp""")
    issue = incidents.derive_issues(df).collect()
    assert len(issue) == 1
    assert issue[0].impact_summary == "150 of 1000 rows failed (85.0% pass rate)"
    assert (issue[0].severity, len(issue[0].title), issue[0].due_at) == ("major", 608, START + timedelta(hours=8))
    stored = incidents.derive_issues(df).select(fixed_width(F.col("title")).alias("title")).first().title
    assert (len(stored), stored[-3:]) == (500, "...") and issue[0].title.startswith(stored[:497])
    opened = incidents.auto_incidents(
        incidents.derive_issues(df).withColumn("issue_id", F.lit(1)), spark.createDataFrame([(2,)], "issue_id int")).first()
    assert (opened.priority, len(opened.title)) == ("P2", 615)


def test_empty_history(spark):
    runs = spark.createDataFrame([], """run_id int, execution_id int, flow_id int, node_id string, node_type string, status string,
        check_type string, check_name string, dataset string, source_id int, column_name string, columns array<string>,
        pass_rate double, threshold_pass double, rows_scanned long, rows_failed long, duration_seconds long, created_at timestamp""")
    flows = spark.createDataFrame([], "flow_id int, status string")
    now = F.lit(str(START)).cast("timestamp")
    assert dashboards.overview(runs, flows).first().average_pass_rate == 0.0
    groups = dashboards.by_dimension_group(runs).collect()
    assert {(r.dimension, r.status) for r in groups} == {(d, "critical") for d in ("structural", "semantic", "statistical")}
    assert coverage.check_inventory(runs).first().standard_checks_pct == 0.0
    assert operations.stability_index(runs, now).first()[0] == 100.0
    assert dashboards.scorecard_total(runs, now).first().overall_score == 0.0
    sla = incidents.sla_metrics(spark.createDataFrame([], "incident_id int, severity string, opened_at timestamp, resolved_at timestamp"), now).first()
    assert (sla.compliance_rate, sla.mttr_hours) == (100.0, 0.0)


def test_deliveries_of_anomalies(spark, tmp_path):
    root, schema = str(tmp_path / "anomalies"), "fingerprint string, severity string, nth int"
    first = spark.createDataFrame([("a", "Low", 1), ("a", "High", 2), ("b", "Low", 1)], schema)
    rows = anomaly.record_anomalies(first, root, "one", at(0), order="nth")
    assert {(r.fingerprint, r.severity, r.status) for r in rows.collect()} == {("a", "High", "open"), ("b", "Low", "open")}
    assert anomaly.record_anomalies(first, root, "one", at(9), order="nth").exceptAll(rows).isEmpty()
    second = spark.createDataFrame([("a", "Critical", 1), ("c", "Low", 1)], schema)
    later = anomaly.record_anomalies(second, root, "two", at(5), order="nth")
    assert {(r.fingerprint, r.severity, r.detected_at, r.created_at) for r in later.collect()} == {
        ("a", "Critical", at(5), at(0)), ("b", "Low", at(0), at(0)), ("c", "Low", at(5), at(5))}
    third = anomaly.record_anomalies(second, root, "three", at(48), order="nth")  # too late to be updates
    assert third.count() == 5
    assert [(r.delivery, r.detected, r.inserted, r.updated) for r in anomaly.deliveries(spark, root).orderBy("version").collect()] == [
        ("one", 3, 2, 1), ("two", 2, 1, 1), ("three", 2, 2, 0)]


def test_failures_around_resolutions(spark):
    """Handled one after the other: a failure adds to the open issue, a resolution ends it."""
    rng = random.Random(11)
    fails = [(i, rng.choice([1, 2, None]), rng.choice([5, 6]), rng.randint(1, 9), at(rng.randrange(60))) for i in range(50)]
    ends = [(rng.choice([1, 2]), rng.choice([5, 6]), at(rng.randrange(60))) for _ in range(14)]
    opened = [(900, 1, 5, "open", 100, at(-5)), (901, 2, 6, "closed", 7, at(-4))]
    live, done = {(1, 5): [900, 100, at(-5), 0, None]}, []
    for when, turn, event in sorted([(e[2], 0, e) for e in ends] + [(f[4], 1, f) for f in fails], key=lambda x: x[:2]):
        if turn == 0:
            if (issue := live.pop(event[:2], None)) and issue[3]:
                done.append((*event[:2], *issue, when))
        elif event[1] is None:
            done.append((None, event[2], None, event[3], when, 1, when, None))
        else:
            issue = live.setdefault(event[1:3], [None, 0, when, 0, None])
            issue[1:] = [issue[1] + event[3], issue[2], issue[3] + 1, when]
    done += [(*home, *issue, None) for home, issue in live.items() if issue[3]]
    got = incidents.group_failures(
        spark.createDataFrame(fails, "run_id int, rule_id int, dataset_id int, rows_failed int, completed_at timestamp"),
        spark.createDataFrame(opened, "issue_id int, rule_id int, dataset_id int, status string, failure_count int, opened_at timestamp"),
        "one_per_rule", resolutions=spark.createDataFrame(ends, "rule_id int, dataset_id int, resolved_at timestamp"))
    rows = [(r.rule_id, r.dataset_id, r.issue_id, r.failure_count, r.opened_at, r.failures, r.last_seen_at, r.resolved_at) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(done, key=str)
