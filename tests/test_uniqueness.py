"""Duplicate checks against brute force."""

import random
import re
from datetime import datetime, timedelta
from itertools import combinations

import pytest

from veritab import Check, run_check, violations
from veritab.operators import fuzzy
from veritab.operators.fuzzy import similar_pairs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def sim(a, b):
    return 1.0 - distance(a, b) / max(len(a), len(b), 1)


def variants(rng, n, size, alphabet):
    """Strings around a few stems, so that all edit distances occur."""
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, size))) for _ in range(6)]
    out = set()
    while len(out) < n:
        s = list(rng.choice(stems))
        for _ in range(rng.randint(0, max(1, len(s) // 3))):
            at = rng.randrange(len(s) + 1)
            match rng.randrange(3):
                case 0:
                    s.insert(at, rng.choice(alphabet))
                case 1 if s:
                    del s[min(at, len(s) - 1)]
                case _ if s:
                    s[min(at, len(s) - 1)] = rng.choice(alphabet)
        out.add("".join(s))
    return sorted(out)


@pytest.mark.parametrize("threshold,size,alphabet,n", [
    (0.85, 12, "abc", 60), (0.85, 45, "abcde", 90), (0.7, 25, "ab", 90), (0.5, 14, "abc", 60), (0.95, 60, "ab", 60),
    (1.0, 8, "ab", 40), (0.8, 30, "abcdef", 120), (0.85, 28, "ab", 120), (0.75, 40, "xyz ", 100)])
def test_similar_pairs(spark, threshold, size, alphabet, n):
    values = variants(random.Random(size), n, size, alphabet)
    expected = {(a, b) for a, b in combinations(values, 2) if sim(a, b) >= threshold}
    found = similar_pairs(spark.createDataFrame([(v,) for v in values], "v string"), threshold)
    assert {(r.a, r.b) for r in found.collect()} == expected


@pytest.mark.parametrize("threshold,size,alphabet,stretch", [
    (0.85, 160, "abcdefgh", 512), (0.85, 220, "ab", 64), (0.9, 200, "abc ", 32), (0.95, 240, "abcé日", 100),
    (0.7, 110, "abcdef", 512), (0.75, 90, "ab", 16), (0.98, 300, "ab", 512)])
def test_similar_long_pairs(spark, monkeypatch, threshold, size, alphabet, stretch):
    monkeypatch.setattr(fuzzy, "STRETCH", stretch)
    rng = random.Random(size)
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randint(size // 2, size))) for _ in range(4)]
    values = sorted({*stems, *[near(rng, rng.choice(stems), alphabet, int((1 - threshold) * size * 0.8)) for _ in range(22)]})
    expected = {(a, b) for a, b in combinations(values, 2) if sim(a, b) >= threshold}
    assert sum(max(map(len, p)) > fuzzy.LONG for p in expected) > 5
    found = similar_pairs(spark.createDataFrame([(v,) for v in values], "v string"), threshold)
    assert {(r.a, r.b) for r in found.collect()} == expected


def near(rng, text, alphabet, edits):
    out = list(text)
    for _ in range(rng.randint(0, edits)):
        out[rng.randrange(len(out)):][:1] = []
        out[rng.randrange(len(out) + 1): 0] = [rng.choice(alphabet)] if rng.random() < 0.5 else []
        if out and rng.random() < 0.6:
            del out[rng.randrange(len(out))]
    return "".join(out)


def test_keys_of_long_strings_grow_with_their_length(spark):
    rng = random.Random(1)
    most = {}
    for size in (400, 1600):
        text = "".join(rng.choice("abcdefghijklmnop") for _ in range(size))
        other = text[: size // 2] + "#" + text[size // 2 + 1:]
        keys = fuzzy.rare_grams(spark.createDataFrame([(text,), (other,)], "v string"), 0.85)
        most[size] = keys.groupBy("id").count().agg({"count": "max"}).first()[0]
        assert most[size] <= 4 * 0.15 * size / 0.85 + 5
    assert 3 <= most[1600] / most[400] <= 5


def test_distances_are_computed_once_and_candidates_dealt(spark):
    """Filters on the distance don't copy it; long candidates are dealt to the tasks the session asks for."""
    pairs = similar_pairs(spark.createDataFrame([("a" * 99,)], "v string"), 0.95)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("levenshtein(") == 1
    assert re.search(r"RepartitionByExpression \[x#\d+, y#\d+\], " + spark.conf.get("spark.sql.shuffle.partitions"), plan)


def test_shared_prefix_makes_no_candidates(spark):
    values = spark.range(2000).selectExpr("concat('Customer#', lpad(id * 7919 % 1000000, 9, '0')) AS v")
    assert fuzzy._by_deletion(values, 0.9).where("possible").distinct().count() < 2000 * 40


def test_fuzzy_counts(spark):
    rng = random.Random(5)
    base = variants(rng, 25, 10, "abc")
    rows = [rng.choice(base) for _ in range(80)] + [None] * 3
    pairs = [(i, j) for i, j in combinations(range(len(rows)), 2)
             if rows[i] is not None and rows[j] is not None and sim(rows[i], rows[j]) >= 0.8]
    hit = {i for p in pairs for i in p}
    t = {"t": spark.createDataFrame([(r,) for r in rows], "v string")}
    check = Check("f", "uniqueness", "fuzzy", "t", ("v",), {"fuzzy_threshold": 0.8})
    row = run_check(t, check).first()
    assert (row.total_rows, row.failed_rows, row.duplicate_pairs) == (len(rows), len(hit), len(pairs))
    assert violations(t, check).count() == len(hit)


def test_soundex(spark):
    names = ["Robert", "Rupert", "Rubin", "Ashcraft", "Ashcroft", "Tymczak", None, None, "Honeyman"]
    t = {"t": spark.createDataFrame([(n,) for n in names], "v string")}
    check = Check("s", "uniqueness", "fuzzy", "t", ("v",), {"fuzzy_algorithm": "soundex"})
    row = run_check(t, check).first()
    assert (row.total_rows, row.failed_rows, row.duplicate_pairs) == (9, 4, 2)
    assert sorted(r.v for r in violations(t, check).collect()) == [
        "Ashcraft", "Ashcroft", "Robert", "Rupert"]


@pytest.mark.parametrize("seed,window", [(1, "10s"), (2, "60s"), (3, "0s"), (4, "1h")])
def test_temporal(spark, seed, window):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "b", None]),
             None if rng.random() < 0.1 else start + timedelta(milliseconds=rng.randrange(0, 2_000_000, 250)))
            for i in range(150)]
    seconds = int(window[:-1]) * {"s": 1, "h": 3600}[window[-1]]
    hit = {i for (i, k, x), (j, m, y) in ((p, q) for p in rows for q in rows if p[0] != q[0])
           if k is not None and k == m and x is not None and y is not None
           and abs((x - y).total_seconds()) <= seconds}
    t = {"t": spark.createDataFrame(rows, "id int, k string, at timestamp")}
    check = Check("t", "uniqueness", "temporal", "t", ("k",), {
        "temporal_column": "at", "temporal_window": window})
    row = run_check(t, check).first()
    assert (row.total_rows, row.failed_rows) == (len(rows), len(hit))
    assert {r.id for r in violations(t, check).collect()} == hit


@pytest.mark.parametrize("mode", ["exclude", "include"])
@pytest.mark.parametrize("folded", [True, False])
def test_keys_with_nulls(spark, mode, folded):
    rng = random.Random(9)
    rows = [(rng.choice(["A", "a", "b", None]), rng.choice([1, 2, None])) for _ in range(14)]
    t = {"t": spark.createDataFrame(rows, "k string, s int")}
    check = Check("u", "uniqueness", "scoped", "t", ("k",), {
        "scope_columns": ["s"], "null_handling": mode, "case_sensitive": not folded})
    keyed = [(s, k.lower() if folded and k else k) for k, s in rows
             if mode == "include" or k is not None]
    expected = sum(keyed.count(x) > 1 for x in keyed)
    row = run_check(t, check).first()
    assert (row.total_rows, row.failed_rows) == (len(keyed), expected)
    assert row.max_group_size == max((keyed.count(x) for x in keyed if keyed.count(x) > 1), default=0)
    assert violations(t, check).count() == expected


def test_inter_record(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["x", "y", None])) for _ in range(12)]
    t = {"t": spark.createDataFrame(rows, "g int, v string")}
    check = Check("i", "consistency", "inter_record", "t", (), {
        "group_by_columns": ["g"], "comparison_columns": ["v"]})
    expected = sum(len({v for h, v in rows if h == g and v is not None}) > 1 for g, _ in rows)
    assert run_check(t, check).first().failed_rows == expected
    assert violations(t, check).count() == expected
