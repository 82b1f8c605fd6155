"""Join-based checks against brute force, with NULLs and repeated keys on both sides."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veritab import Check, run_check, violations
from veritab.functions import nearby, relations
from veritab.functions.relations import pair_counts

ROWS = "k1 int, k2 string, a double, b string"


def some_rows(rng, n):
    def maybe(value):
        return None if rng.random() < 0.2 else value

    return [(maybe(rng.randrange(4)), maybe(rng.choice("xy")), maybe(float(rng.choice([-3, 0, 1, 2, 2.5, 7]))),
             maybe(rng.choice("pq"))) for _ in range(n)]


def and3(values):
    if False in values:
        return False
    return None if None in values else True


def eq(x, y):
    return None if x is None or y is None else x == y


@pytest.fixture(scope="module", params=range(4))
def sides(spark, request):
    rng = random.Random(request.param)
    left, right = some_rows(rng, 40), some_rows(rng, 30)
    tables = {"l": spark.createDataFrame(left, ROWS), "r": spark.createDataFrame(right, ROWS)}
    joined = [(x, y) for x in left for y in right if and3([eq(x[0], y[0]), eq(x[1], y[1])])]
    return left, right, tables, joined


def test_pair_counts(sides):
    _, _, t, joined = sides
    for compared in ([("a", "a")], [("a", "a"), ("b", "b")]):
        at = [{"a": 2, "b": 3}[c] for c, _ in compared]
        verdicts = [and3([eq(x[i], y[i]) for i in at]) for x, y in joined]
        row = pair_counts(t["l"], t["r"], [("k1", "k1"), ("k2", "k2")], compared).first()
        assert (row.pairs, row.equal_pairs, row.differing_pairs) == (
            len(joined), verdicts.count(True), verdicts.count(False))


def test_pair_counts_are_dealt_by_size(spark, tmp_path, monkeypatch):
    """Shuffles of pair counts have tasks by the bytes of the files, not the session's few."""
    rows = spark.range(4000).selectExpr("id as k", "id % 3 as a", "id % 5 as b", "if(id % 2 = 0, id, null) as c")
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(relations, "TASK_BYTES", 1000)
    tasks = relations.tasks_by_size(df, df)
    assert tasks > 20
    for columns in (["a"], ["a", "b", "c"]):
        found = pair_counts(df, df, [("k", "k")], [(c, c) for c in columns])
        assert f"], {tasks}\n" in found._jdf.queryExecution().optimizedPlan().toString()
        row = found.first()
        assert (row.pairs, row.equal_pairs, row.differing_pairs) == (4000, 2000 if "c" in columns else 4000, 0)


def test_pair_counts_add_up_copies_from_many_tasks(spark):
    rows = spark.createDataFrame([(1, "x", None, 2)] * 50 + [(1, "y", 1, 2)] * 30, "k int, a string, b int, c int").repartition(16)
    row = pair_counts(rows, rows, [("k", "k")], [(c, c) for c in "abc"]).first()
    assert (row.pairs, row.equal_pairs, row.differing_pairs) == (6400, 900, 3000)


@pytest.mark.parametrize("kind,value", [("absolute", 1.0), ("absolute", 0.0), ("percentage", 30.0),
                                        ("percentage", 150.0), ("none", None)])
def test_tolerance(sides, kind, value):
    _, _, t, joined = sides

    def verdict(x, y):
        if x is None or y is None:
            return None
        if kind == "none":
            return x == y
        if kind == "absolute":
            return abs(x - y) <= value
        return None if y == 0 else abs(x - y) / abs(y) * 100 <= value

    verdicts = [verdict(x[2], y[2]) for x, y in joined]
    check = Check("t", "reconciliation", "tolerance", "l", ("a",), {
        "source_dataset": "l", "target_dataset": "r", "join_keys": ["k1", "k2"],
        "tolerance_type": kind, "tolerance_value": value})
    row = run_check(t, check).first()
    assert (row.total_rows, row.passed_rows, row.failed_rows) == (
        len(joined), verdicts.count(True), verdicts.count(False))
    assert row.undetermined_rows == verdicts.count(None)
    assert violations(t, check).count() == verdicts.count(False)


def test_one_to_one_and_missing_extra(sides):
    left, right, t, joined = sides
    params = {"source_dataset": "l", "target_dataset": "r", "join_keys": ["k1", "k2"]}
    lonely_l = [x for x in left if not any(x is j for j, _ in joined)]
    lonely_r = [y for y in right if not any(y is j for _, j in joined)]
    row = run_check(t, Check("o", "reconciliation", "one_to_one", "l", (), params)).first()
    assert row.matched_count == len(joined)
    assert row.missing_in_target == sum(x[0] is not None for x in lonely_l)
    assert row.extra_in_target == sum(y[0] is not None for y in lonely_r)
    check = Check("m", "reconciliation", "missing_extra", "l", (), params)
    row = run_check(t, check).first()
    assert (row.missing_in_target, row.extra_in_target) == (len(lonely_l), len(lonely_r))
    assert violations(t, check).count() == row.failed_rows


@pytest.mark.parametrize("mode", ["fail", "skip", "pass"])
def test_reference_with_copies(sides, mode):
    left, right, t, _ = sides
    kept = [x for x in left if mode != "skip" or x[2] is not None]
    total = verified = good = bad = 0
    for x in kept:
        partners = [y for y in right if eq(x[0], y[0])] or [(None,) * 4]
        for y in partners:
            total += 1
            if y[2] is None:
                continue
            verified += 1
            near = None if x[2] is None else abs(x[2] - y[2]) <= 1
            if near or (mode == "pass" and x[2] is None):
                good += 1
            elif near is False:
                bad += 1
    check = Check("a", "accuracy", "tolerated_deviation", "l", ("a",), {
        "reference_dataset": "r", "join_keys": ["k1"], "tolerance_type": "absolute",
        "tolerance_value": 1, "null_handling": mode})
    row = run_check(t, check).first()
    assert (row.total_rows, row.verified_rows, row.passed_rows, row.failed_rows) == (
        total, verified, good, bad)
    assert violations(t, check).count() == bad


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_cross_dataset_and_lookup(spark, sides, limit):
    left, right, t, _ = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        look_up(left, right, t)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def look_up(left, right, t):
    known = {y[0] for y in right if y[0] is not None}
    hits = sum(x[0] in known for x in left)
    check = Check("x", "uniqueness", "cross_dataset", "l", ("k1",), {
        "cross_dataset_name": "r", "cross_dataset_column": "k1"})
    row = run_check(t, check).first()
    assert (row.total_rows, row.failed_rows) == (len(left), hits)
    assert violations(t, check).count() == hits
    for mode, failed, skipped in (("fail", len(left) - hits, 0),
                                  ("skip", sum(x[0] is not None for x in left) - hits,
                                   sum(x[0] is None for x in left)),
                                  ("pass", sum(x[0] is not None for x in left) - hits, 0)):
        check = Check("v", "validity", "reference_lookup", "l", ("k1",), {
            "reference_dataset": "r", "reference_column": "k1", "null_handling": mode})
        row = run_check(t, check).first()
        assert (row.failed_rows, row.skipped_rows) == (failed, skipped)
        assert row.passed_rows == len(left) - failed - skipped
        assert violations(t, check).count() == failed


def within(x, y, kind, value):
    if kind == "absolute":
        return abs(x - y) <= value
    return abs(x - y) / abs(y) * 100.0 <= value


@pytest.mark.parametrize("kind,value", [
    ("absolute", 0.01), ("absolute", 0.03), ("absolute", 1e9), ("absolute", 5e-324), ("absolute", -1.0), ("percentage", 100.0),
    ("percentage", 99.99999999999), ("percentage", 150.0), ("percentage", 1e-9), ("percentage", 10.0), ("percentage", 0.0)])
def test_pairs_within(spark, kind, value):
    rng = random.Random(4)
    pool = [round(rng.uniform(-1, 1), 2) for _ in range(60)] + [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(15)]
    pool += [0.0, -0.0, 1e-20, -1e-20, 5e-324, 1.7e308, -1.7e308, 2.0 ** 52, 2.0 ** 53 + 2, 1.0, 1.1, 0.9, 2.0, 0.5, 1 + 2 ** -52]
    pool += [x * (1 + value / 100) for x in pool[:30]] + [x + value for x in pool[:30]] + [float("inf"), float("nan")]
    left = [(rng.randrange(2), rng.choice(pool)) for _ in range(300)]
    right = [(rng.randrange(3), y) for y in rng.choices(pool, k=200) if kind == "absolute" or y]
    expected = sum(k == m and math.isfinite(x) and math.isfinite(y) and within(x, y, kind, value) for k, x in left for m, y in right)
    frames = [spark.createDataFrame(rows, "k int, v double").groupBy("k", "v").agg(F.count("*").alias("n")) for rows in (left, right)]
    assert nearby.pairs_within(*frames, ["k"], kind, value).first().ok == expected


def test_digits_keep_the_order(spark):
    rng = random.Random(6)
    xs = sorted({s * m * 2.0 ** rng.randint(-1074, 1023) for s in (-1, 1) for m in (1.0, 1.5, 1 + 2 ** -52, 1.9999999999999998) for _ in range(60)}
                | {0.0, 5e-324, -5e-324, 1.7976931348623157e308, 2.2250738585072014e-308})
    xs = [x for x in xs if math.isfinite(x)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = nearby.with_digits(df, "x").select("x", *nearby.DIGITS).orderBy(*nearby.DIGITS).collect()
    assert [r.x for r in got] == xs and len({tuple(r)[1:] for r in got}) == len(xs)


@pytest.mark.parametrize("kind,value", [("percentage", 100.0), ("absolute", 1e7)])
def test_one_key_and_a_wide_tolerance(spark, kind, value):
    """Ten thousand million pairs under one key, none of which is formed."""
    n = 100_000
    side = spark.range(1, n + 1).selectExpr("1 AS k", "cast(id AS double) AS v", "1L AS n")
    got = nearby.pairs_within(side, side, ["k"], kind, value).first().ok
    if kind == "percentage":  # left values from 0 to twice the right one
        expected = sum(min(2 * r, n) for r in range(1, n + 1))
    else:
        expected = sum(min(r + int(value), n) - max(r - int(value), 1) + 1 for r in range(1, n + 1))
    assert got == expected
