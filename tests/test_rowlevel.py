"""Row verdicts under every NULL policy, and the small builders behind them."""

import pytest
from pyspark.sql import functions as F

from veritab import Check, run_check, violations
from veritab.functions import patterns as P
from veritab.functions import predicates as X

SCHEMA = "n int, m int, s string, d string"
ROWS = [(1, 2, "ab", "2024-01-02"), (5, 2, " AB ", "2024-02-30"), (None, 2, "", None), (3, None, None, "x"),
        (7, 7, "Ab", "2023-12-31"), (None, None, "a1", "2024-01-01")]

# dimension, subtype, columns, params, verdict per row (None: NULL input)
CASES = [
    ("validity", "range", ["n"], {"min_value": 2, "max_value": 6}, [False, True, None, True, False, None]),
    ("validity", "cross_field", ["n"], {"comparison_column": "m", "comparison_operator": "gt"},
     [False, True, None, None, False, None]),
    ("validity", "allowed_values", ["s"], {"allowed_values": ["AB", "ab"]},
     [True, False, False, None, False, False]),
    ("validity", "allowed_values", ["s"], {"allowed_values": ["AB"], "case_sensitive": False},
     [True, False, False, None, True, False]),
    ("conformity", "charset", ["s"], {"allowed_characters": "alpha"}, [True, True, True, None, True, False]),
    ("conformity", "case", ["s"], {"case_rule": "upper"}, [False, True, True, None, False, False]),
    ("conformity", "length", ["s"], {"min_length": 1}, [True, True, False, None, True, True]),
]


@pytest.mark.parametrize("mode", ["fail", "skip", "pass"])
@pytest.mark.parametrize("case", CASES, ids=lambda c: f"{c[1]}-{c[2][0]}")
def test_null_policies(spark, case, mode):
    dimension, subtype, columns, params, verdicts = case
    t = {"t": spark.createDataFrame(ROWS, SCHEMA)}
    check = Check("c", dimension, subtype, "t", tuple(columns), {**params, "null_handling": mode})
    row = run_check(t, check).first()
    yes, no, nulls = (verdicts.count(v) for v in (True, False, None))
    if dimension == "validity":
        expected = {"fail": (6, yes, no + nulls, 0), "skip": (6, yes, no, nulls),
                    "pass": (6, yes + nulls, no, 0)}[mode]
    else:
        expected = {"fail": (6, yes, no, 0), "skip": (6 - nulls, yes, no, 0),
                    "pass": (6, yes + nulls, no, 0)}[mode]
    assert (row.total_rows, row.passed_rows, row.failed_rows, row.skipped_rows) == expected
    evaluated = expected[0] - expected[3]
    assert row.pass_rate == pytest.approx(100.0 * expected[1] / evaluated)
    assert violations(t, check).count() == expected[2]


def test_long_value_list_agrees_with_short_one(spark):
    t = {"t": spark.createDataFrame(ROWS, SCHEMA)}
    padding = list(range(100, 2000))
    for mode in ("fail", "skip", "pass"):
        short, long = (run_check(t, Check("c", "validity", "allowed_values", "t", ("n",), {
            "allowed_values": values, "null_handling": mode})).first() for values in ([1, 5], [1, 5, *padding]))
        assert short == long


def test_filter_and_empty_input(spark):
    t = {"t": spark.createDataFrame(ROWS, SCHEMA)}
    check = Check("c", "completeness", "null", "t", ("m",), filter="n >= 3")
    row = run_check(t, check).first()
    assert (row.total_rows, row.failed_rows) == (3, 1)
    assert violations(t, check).count() == 1
    empty = Check("c", "completeness", "null", "t", ("m",), filter="n > 100")
    row = run_check(t, empty).first()
    assert (row.total_rows, row.pass_rate, row.check_status) == (0, 100.0, "PASS")


def test_thresholds(spark):
    t = {"t": spark.createDataFrame(ROWS, SCHEMA)}
    def status(**kw):
        return run_check(t, Check("c", "completeness", "null", "t", ("m",), **kw)).first().check_status
    assert status(threshold_pass=60) == "PASS"
    assert status(threshold_pass=80, threshold_warn=60) == "WARN"
    assert status(threshold_pass=80, threshold_warn=70) == "FAIL"
    assert status(threshold_pass=60, max_violations=1) == "FAIL"
    assert status(threshold_pass=60, max_violations=2) == "PASS"


def test_bad_dates_are_undetermined(spark):
    t = {"t": spark.createDataFrame(ROWS, SCHEMA).withColumn("e", F.lit("2024-01-01"))}
    check = Check("c", "validity", "date_logic", "t", ("d",), {"comparison_column": "e", "comparison_operator": ">="})
    row = run_check(t, check).first()
    assert (row.passed_rows, row.failed_rows, row.undetermined_rows) == (2, 2, 2)


def test_percentage_of_zero_is_undetermined(spark):
    t = {"t": spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 1.005)], "a double, b double")}
    check = Check("c", "accuracy", "derived_value", "t", ("a",), {
        "formula": "b", "tolerance_type": "percentage", "tolerance_value": 1})
    row = run_check(t, check).first()
    assert (row.passed_rows, row.failed_rows, row.undetermined_rows) == (1, 0, 2)


@pytest.mark.parametrize("raw,seconds", [("90", 90), (15, 15), ("30m", 1800), ("1.5h", 5400), ("7D", 604800),
                                         ("2w", 1209600), ("10s", 10)])
def test_durations(raw, seconds):
    assert X.duration_seconds(raw) == seconds


def test_rejected_settings():
    for bad in ("soon", "5x"):
        with pytest.raises(ValueError):
            X.duration_seconds(bad)
    with pytest.raises(ValueError):
        X.minutes_of_day("24:00")
    with pytest.raises(ValueError):
        X.canonical_operator("roughly")
    with pytest.raises(ValueError):
        Check("c", "validity", "nonsense", "t")
    assert X.canonical_operator("on_or_after") == ">="


def test_title_case(spark):
    values = ["mary-ann o'neil", "MARY", "x1 2y", "", None, "élan vital"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(X.title_case(F.col("v"))).collect()]
    assert got == ["Mary-Ann O'Neil", "Mary", "X1 2y", "", None, "Élan Vital"]


def test_documents(spark):
    df = spark.createDataFrame([("<a>1</a>", "[1]"), ("<a>", "{"), ("plain", ""), ("", '{"a": 1}')], "x string, j string")
    got = df.select(X.is_xml(F.col("x")), X.is_json(F.col("j"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False), (False, True)]


def test_patterns(spark):
    assert P.template_regex("AA-99.") == r"^[A-Z][A-Z]\-[0-9][0-9]\.$"
    assert P.java_regex("^[[:alpha:]]+$", "i") == "(?i)^[a-zA-Z]+$"
    accepted = {"ipv4": "10.0.0.255", "ipv6": "fe80::1", "isodate": "2024-02-01", "uuid": "123e4567-e89b-12d3-a456-426614174000",
                "phone_e164": "+4915112345678", "url": "https://a.b/c?d", "iso8601": "2024-02-01T10:00Z", "email": "a.b@c.org"}
    refused = {"ipv4": "10.0.0.256", "ipv6": "fe80:1", "isodate": "2024-2-1", "uuid": "123e4567", "phone_e164": "0049", "url": "ftp://a",
               "iso8601": "10:00", "email": "a@b"}
    df = spark.range(1).select(*[F.lit(v).rlike(P.VALIDATORS[k]) for k, v in accepted.items()],
                               *[~F.lit(v).rlike(P.VALIDATORS[k]) for k, v in refused.items()])
    assert all(df.first())


def test_rule_documents():
    check = Check.from_rule({"dimension": "validity", "entity": "orders.total", "rule_id": "r1", "severity": "high",
                             "parameters": {"min_value": 0, "threshold_pass": 99, "filter_expression": "x = 1"}})
    assert (check.subtype, check.dataset, check.columns, check.filter, check.threshold_pass) == (
        "range", "orders", ("total",), "x = 1", 99.0)
    cases = [
        ("uniqueness", "columns", ["a", "b"], "composite"), ("uniqueness", "temporal_window", "1d", "temporal"),
        ("conformity", "case_rule", "upper", "case"), ("timeliness", "expected_frequency", "1h", "heartbeat"),
        ("accuracy", "formula", "a*b", "derived_value"),
        ("validity", "business_rule_expression", "a > 0", "business_rule"), ("completeness", "x", 1, "null")]
    for dimension, name, value, subtype in cases:
        rule = {"dimension": dimension, "entity": "t.c", "parameters": {name: value}}
        assert Check.from_rule(rule).subtype == subtype
    both = {"group_by_columns": ["a"], "comparison_columns": ["b"]}
    assert Check.from_rule({"dimension": "consistency", "entity": "t.c", "parameters": both}).subtype == "inter_record"


def test_compound(spark):
    t = {"t": spark.createDataFrame(ROWS, SCHEMA)}
    members = [Check("a", "validity", "range", "t", ("n",), {"min_value": 4}),
               Check("b", "completeness", "null", "t", ("m",))]
    for logic, failed in (("AND", 4), ("OR", 2)):
        check = Check("c", "generic", "compound", "t", (), {"logic": logic, "members": members})
        assert run_check(t, check).first().failed_rows == failed
        assert violations(t, check).count() == failed
