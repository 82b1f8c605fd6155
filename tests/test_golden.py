import pytest

from tests import golden
from veritab import Check, run_check, run_suite, violations


@pytest.fixture(scope="module")
def tables(spark):
    return {name: spark.createDataFrame(rows, schema)
            for name, (schema, rows) in golden.TABLES.items()}


def build(i):
    dimension, subtype, columns, params, _ = golden.EXPECTED[i]
    dataset = params.get("source_dataset", dimension)
    return Check(f"c{i}", dimension, subtype, dataset, tuple(columns), params)


IDS = [f"{e[0]}-{e[1]}-{i}" for i, e in enumerate(golden.EXPECTED)]


@pytest.mark.parametrize("i", range(len(golden.EXPECTED)), ids=IDS)
def test_counts_and_violations(tables, i):
    check, expected = build(i), golden.EXPECTED[i][4]
    row = run_check(tables, check, golden.AS_OF).first()
    assert (row.total_rows, row.passed_rows, row.failed_rows) == expected
    assert row.check_status == ("PASS" if row.pass_rate == 100.0 else "FAIL")
    rows = violations(tables, check, golden.AS_OF).count()
    if (check.dimension, check.subtype) not in {
        ("reconciliation", "record_count"), ("timeliness", "heartbeat"),
    }:
        assert rows == expected[2]


def test_suite_equals_single_runs(tables):
    checks = [build(i) for i in range(len(golden.EXPECTED))]
    suite = {r.check_id: r for r in run_suite(tables, checks, golden.AS_OF).collect()}
    assert len(suite) == len(checks)
    for i, check in enumerate(checks):
        row = suite[check.check_id]
        assert (row.total_rows, row.passed_rows, row.failed_rows) == golden.EXPECTED[i][4]


def test_reference_checks_report_unverifiable_rows(tables):
    i = IDS.index(next(n for n in IDS if n.startswith("accuracy-reference_comparison")))
    row = run_check(tables, build(i), golden.AS_OF).first()
    assert (row.verified_rows, row.unverifiable_rows, row.pass_rate) == (8, 2, 75.0)


def test_one_to_one_rate_is_of_the_larger_side(tables):
    i = IDS.index(next(n for n in IDS if "one_to_one" in n))
    row = run_check(tables, build(i), golden.AS_OF).first()
    assert (row.missing_in_target, row.extra_in_target, row.pass_rate) == (1, 1, 90.0)


def test_groups(tables):
    from veritab.operators.tablelevel import group_completeness

    i = IDS.index(next(n for n in IDS if n.startswith("completeness-group")))
    got = {r.group_key: (r.total_rows, r.passed_rows, r.failed_rows)
           for r in group_completeness(build(i), tables["completeness"]).collect()}
    assert got == {"A": (3, 2, 1), "B": (3, 2, 1), "C": (4, 4, 0)}
