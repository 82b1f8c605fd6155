"""The shape of plans: scans, pushdown, bounded tasks, no Python rows."""

import glob
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from veritab import Check, run_check, run_suite, violations
from veritab.functions.quantiles import quantile_row
from veritab.history import effectiveness
from veritab.plans import profile
from veritab.plans.suite import first_by_hash, suite_evidence

COLUMNS = "id long, k int, s string, v double, ts timestamp"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t"))
    df = spark.range(5000).selectExpr(
        "id", "CAST(CASE WHEN id % 3 = 0 THEN 0 ELSE id % 700 END AS INT) AS k", "concat('s', id % 900) AS s",
        "id * 1.5D AS v", "timestamp_seconds(id * 20) AS ts")
    df.write.mode("overwrite").parquet(path)
    return {"t": spark.read.parquet(path), "u": spark.read.parquet(path)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return len(re.findall(r"FileScan parquet", plan(df)))


def some_checks(n):
    return [Check(f"c{i}", "validity", "range", "t", ("v",), {"min_value": i}) for i in range(n)]


def test_row_checks_share_scans(tables):
    assert scans(run_suite(tables, some_checks(20))) == 1
    assert scans(run_suite(tables, some_checks(21))) == 2


def test_checks_on_the_same_keys_share_a_grouping(tables):
    checks = [ALL[4], Check("x", "uniqueness", "exact", "t", ("k",)),
              Check("y", "consistency", "inter_record", "t", (), {"group_by_columns": ["k"], "comparison_columns": ["v"]})]
    df = run_suite(tables, checks)
    assert scans(df) == 1
    alone = {r.check_id: r for c in checks for r in run_check(tables, c).collect()}
    for row in df.collect():
        assert (row.total_rows, row.failed_rows) == (alone[row.check_id].total_rows, alone[row.check_id].failed_rows)


def test_only_needed_columns_and_pushed_filters(tables):
    text = plan(run_check(tables, Check("c", "validity", "range", "t", ("v",), {"min_value": 3}, filter="k = 5")))
    assert "ReadSchema: struct<k:int,v:double>" in text
    assert re.search(r"PushedFilters: \[.*EqualTo\(k,5\)", text)
    text = plan(violations(tables, Check("c", "completeness", "null", "t", ("s",))))
    assert "PushedFilters: [IsNull(s)]" in text


ALL = [
    Check("a", "uniqueness", "exact", "t", ("s",)),
    Check("b", "uniqueness", "cross_dataset", "t", ("k",), {"cross_dataset_name": "u", "cross_dataset_column": "k"}),
    Check("c", "uniqueness", "temporal", "t", ("k",), {"temporal_column": "ts", "temporal_window": "1m"}),
    Check("d", "uniqueness", "fuzzy", "t", ("s",)),
    Check("e", "consistency", "inter_record", "t", (), {"group_by_columns": ["k"], "comparison_columns": ["s"]}),
    Check("f", "consistency", "cross_table", "t", (), {
        "comparison_dataset": "u", "join_keys": ["k"], "comparison_columns": ["v"]}),
    Check("g", "accuracy", "statistical", "t", ("v",), {"statistical_method": "iqr"}),
    Check("h", "accuracy", "reference_comparison", "t", ("v",), {"reference_dataset": "u", "join_keys": ["id"]}),
    Check("i", "reconciliation", "one_to_one", "t", (), {
        "source_dataset": "t", "target_dataset": "u", "join_keys": ["k"]}),
    Check("j", "reconciliation", "tolerance", "t", ("v",), {
        "source_dataset": "t", "target_dataset": "u", "join_keys": ["k"], "tolerance_type": "absolute", "tolerance_value": 2}),
    Check("k", "validity", "reference_lookup", "t", ("k",), {"reference_dataset": "u", "reference_column": "k"}),
]


@pytest.mark.parametrize("check", ALL, ids=lambda c: c.subtype)
def test_no_cross_joins_windows_over_rows_or_python(tables, check):
    for df in (run_check(tables, check), violations(tables, check)):
        text = plan(df)
        assert "CartesianProduct" not in text
        assert not re.search(r"Python|ArrowEval|MapInPandas", text)
        assert "ObjectHashAggregate(keys=[], functions=[percentile" not in text


def test_no_pairs_are_formed_for_counts(tables):
    """A key with a third of the rows on both sides would give millions of pairs."""
    for check in (ALL[5], ALL[8]):
        assert not re.search(r"SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin", plan(run_check(tables, check)))
    row = run_check(tables, ALL[8]).first()
    n = tables["t"].groupBy("k").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert row.matched_count == n > 2_700_000


def test_temporal_duplicates_do_not_order_a_hot_key(tables):
    assert "Window" not in plan(run_check(tables, ALL[2]))


def test_ranked_results_are_limited_before_the_shuffle(tables, spark):
    assert "WindowGroupLimit" in plan(profile.top_values(tables["t"], ["s", "k"]))
    runs = tables["t"].selectExpr(
        "id AS run_id", "k AS flow_id", "s AS node_id", "'check' AS node_type", "'completed' AS status", "'x' AS check_type",
        "s AS check_name", "s AS column_name", "v AS pass_rate", "50D AS threshold_pass", "ts AS created_at")
    assert "WindowGroupLimit" in plan(effectiveness.classify(runs, F.lit("1970-01-02").cast("timestamp")))


def test_quantiles_use_no_percentile_buffer(tables):
    df = quantile_row(tables["t"], F.col("v"), [0.5])
    assert "percentile" not in plan(df) and df.first().q0 == 2499.5 * 1.5


def test_library_has_no_forbidden_calls():
    for name in glob.glob("veritab/**/*.py", recursive=True):
        with open(name) as f:
            text = f.read()
        for word in ("localCheckpoint", ".toPandas(", ".rdd", "pandas_udf", "F.udf"):
            assert word not in text, (name, word)


def test_evidence_of_a_suite_is_one_scan(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, 1, 2, 30]), rng.choice([None, "a", "bb"])) for i in range(400)]
    spark.createDataFrame(rows, "id int, n int, s string").write.parquet(str(tmp_path / "t"))
    t = {"t": spark.read.parquet(str(tmp_path / "t"))}
    checks = [Check("a", "completeness", "null", "t", ("n",)), Check("b", "validity", "range", "t", ("n",), {"max_value": 5}, filter="s = 'a'"),
              Check("c", "conformity", "length", "t", ("s",), {"max_length": 1}), Check("d", "validity", "range", "t", ("n",), {"max_value": 99}),
              Check("u", "uniqueness", "exact", "t", ("s",))]
    got = suite_evidence(t, checks, {"t": ["id"]}, 25)
    one = suite_evidence(t, checks[:4], {"t": ["id"]}, 25)._jdf.queryExecution().executedPlan().toString()
    assert one.count("FileScan") == 1 and "WindowGroupLimit" in one
    for check in checks:
        single = first_by_hash(violations(t, check), ["id"], 25).collect()
        assert sorted(json.loads(r.record)["id"] for r in got.where(F.col("check_id") == check.check_id).collect()) == sorted(r.id for r in single)
        assert len(single) == min(25, violations(t, check).count())
