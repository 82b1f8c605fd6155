"""Running checks: one check, a whole suite, or the rows a check rejects."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.relations import sum_where
from veritab.model import SUMMARY_COLUMNS, Check, RowRule, TablePlan, Tables, rate, summarise
from veritab.operators import fuzzy, reconciliation, tablelevel, uniqueness
from veritab.operators.rowlevel import is_row_level, row_rule

# Checks per scan; with more the generated code gets too long to be compiled well
# and stops sharing the common parts of conditions.
CHECKS_PER_SCAN = 20


def moment(as_of: Column | str | None) -> Column:
    """The instant ages are measured from; the current time unless given."""
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp")


def _scope(check: Check, rule: RowRule) -> Column | None:
    """Rows that count for a check: its filter and its population."""
    parts = [F.expr(check.filter)] if check.filter else []
    if rule.population is not None:
        parts.append(rule.population)
    return reduce(and_, parts) if parts else None


def _fused(df: DataFrame, checks: Sequence[Check], as_of: Column) -> DataFrame:
    """Summary rows of row-level checks on one table from a single scan."""
    rules = [(c, row_rule(c, as_of)) for c in checks]
    if all(c.filter for c in checks):
        # Let the scan see the union of the filters.
        wanted = dict.fromkeys(c.filter for c in checks)
        df = df.where(reduce(or_, [F.expr(w) for w in wanted]))
    none = F.lit(0).cast("long")
    counts = []
    for check, rule in rules:
        scope = _scope(check, rule)
        counts.append((
            F.count("*") if scope is None else _count(scope),
            _count(rule.passed if scope is None else scope & rule.passed),
            _count(rule.failed if scope is None else scope & rule.failed),
            none if rule.skipped is None else _count(
                rule.skipped if scope is None else scope & rule.skipped),
        ))
    one_row = df.agg(*[F.array(*column).alias(name) for name, column in zip(
        ("total_rows", "passed_rows", "failed_rows", "skipped_rows"), zip(*counts))])
    return _verdicts(one_row, checks)


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _verdicts(one_row: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row of count arrays to one summary row per check."""
    def constants(values, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")

    zipped = F.arrays_zip(
        constants([c.check_id for c in checks], "string").alias("check_id"),
        constants([c.dimension for c in checks], "string").alias("dimension"),
        constants([c.subtype for c in checks], "string").alias("subtype"),
        constants([c.dataset for c in checks], "string").alias("dataset"),
        "total_rows", "passed_rows", "failed_rows", "skipped_rows",
        constants([c.threshold_pass for c in checks], "double").alias("at_least"),
        constants([c.threshold_warn for c in checks], "double").alias("warn_at"),
        constants([c.max_violations for c in checks], "bigint").alias("at_most"),
    )
    rows = one_row.select(F.inline(zipped)).toDF(
        "check_id", "dimension", "subtype", "dataset", "total_rows", "passed_rows", "failed_rows",
        "skipped_rows", "at_least", "warn_at", "at_most")
    total, passed, failed, skipped = (
        F.col(c) for c in ("total_rows", "passed_rows", "failed_rows", "skipped_rows"))
    rated = rows.withColumn("pass_rate", rate(passed, total - skipped)).withColumn(
        "undetermined_rows", total - passed - failed - skipped)
    verdict = (
        F.when(failed > F.col("at_most"), "FAIL")
        .when(F.col("pass_rate") >= F.col("at_least"), "PASS")
        .when(F.col("pass_rate") >= F.col("warn_at"), "WARN").otherwise("FAIL"))
    return rated.withColumn("check_status", verdict).select(*SUMMARY_COLUMNS)


def _group_keys(check: Check) -> tuple[str, ...] | None:
    """Columns a check groups on, when another check may share the grouping."""
    if check.dimension == "uniqueness" and check.param("case_sensitive", True):
        if check.subtype in ("exact", "composite"):
            return check.columns
        if check.subtype == "scoped":
            return (*check.need("scope_columns"), *check.columns)
    if check.subtype == "inter_record" and check.param("null_handling", "fail") == "fail":
        return tuple(check.need("group_by_columns"))
    return None


def _share_grouping(df: DataFrame, keys: Sequence[str], checks: Sequence[Check]) -> DataFrame:
    """Uniqueness and inter-record checks on the same keys from a single group-by."""
    columns = dict.fromkeys(c.need("comparison_columns")[0] for c in checks
                            if c.subtype == "inter_record")
    spread = {c: i for i, c in enumerate(columns)}
    groups = df.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(
        F.count("*").alias("n"),
        *[F.min(c).alias(f"lo{i}") for c, i in spread.items()],
        *[F.max(c).alias(f"hi{i}") for c, i in spread.items()])
    n, zero = F.col("n"), F.lit(0).cast("long")
    counts = []
    for check in checks:
        wanted = F.lit(True)
        if check.subtype == "inter_record":
            i = spread[check.need("comparison_columns")[0]]
            bad = F.coalesce(F.col(f"lo{i}") != F.col(f"hi{i}"), F.lit(False))
        else:
            bad = n > 1
            if check.param("null_handling", "exclude") == "exclude":
                wanted = reduce(and_, [F.col(f"k{keys.index(c)}").isNotNull() for c in check.columns])
        counts.append((sum_where(wanted, n), sum_where(wanted & ~bad, n), sum_where(wanted & bad, n), zero))
    one_row = groups.agg(*[F.array(*column).alias(name) for name, column in zip(
        ("total_rows", "passed_rows", "failed_rows", "skipped_rows"), zip(*counts))])
    return _verdicts(one_row, checks)


def table_plan(tables: Tables, check: Check, as_of: Column) -> TablePlan:
    """The plan of a check that is not row-level."""
    if check.dimension == "reconciliation":
        return reconciliation.plan(check, tables)
    df = tables[check.dataset]
    if check.filter:
        df = df.where(check.filter)
    if check.dimension != "uniqueness":
        return tablelevel.plan(check, df, tables, as_of)
    if check.subtype == "cross_dataset":
        return uniqueness.cross_dataset(check, df, tables[check.need("cross_dataset_name")])
    if check.subtype == "temporal":
        return uniqueness.temporal(check, df)
    if check.subtype == "fuzzy":
        return fuzzy.fuzzy(check, df)
    return uniqueness.exact(check, df)


def run_check(tables: Tables, check: Check, as_of: Column | str | None = None) -> DataFrame:
    """The summary row of one check, with the extra counts of its kind."""
    now = moment(as_of)
    if is_row_level(check):
        return _fused(tables[check.dataset], [check], now)
    plan = table_plan(tables, check, now)
    return summarise(plan.counts, check, plan.extras)


def run_suite(tables: Tables, checks: Iterable[Check],
              as_of: Column | str | None = None) -> DataFrame:
    """Summary rows of all checks.

    Row-level checks on a table share scans, checks that group on the same keys
    share the grouping, the others add a plan each.
    """
    now = moment(as_of)
    per_table: dict[str, list[Check]] = {}
    per_keys: dict[tuple, list[Check]] = {}
    single: list[Check] = []
    for check in checks:
        if is_row_level(check):
            per_table.setdefault(check.dataset, []).append(check)
        elif keys := _group_keys(check):
            per_keys.setdefault((check.dataset, check.filter, keys), []).append(check)
        else:
            single.append(check)
    parts: list[DataFrame] = []
    for (name, wanted, keys), group in per_keys.items():
        if len(group) == 1:
            single += group
        else:
            df = tables[name].where(wanted) if wanted else tables[name]
            parts.append(_share_grouping(df, keys, group))
    parts += [run_check(tables, check, now).select(*SUMMARY_COLUMNS) for check in single]
    for name, group in per_table.items():
        # Checks of the same columns end up in the same scan, so that several scans
        # of a table read mostly different columns.
        group.sort(key=lambda c: (c.filter or "", c.columns))
        for start in range(0, len(group), CHECKS_PER_SCAN):
            parts.append(_fused(tables[name], group[start:start + CHECKS_PER_SCAN], now))
    if not parts:
        raise ValueError("the suite has no checks")
    return reduce(DataFrame.unionByName, parts)


def violations(tables: Tables, check: Check, as_of: Column | str | None = None) -> DataFrame:
    """Exactly the rows the check counts as failed (all of them, unordered)."""
    now = moment(as_of)
    if is_row_level(check):
        rule = row_rule(check, now)
        scope = _scope(check, rule)
        return tables[check.dataset].where(rule.failed if scope is None else scope & rule.failed)
    return table_plan(tables, check, now).violations()


def first_by_hash(rows: DataFrame, key: Sequence[str], limit: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``limit`` rows (of each value of ``by``) whose key has the smallest hash: a restart takes the same rows."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    order = Window.partitionBy(*by).orderBy("__place", *key)
    placed = rows.withColumn("__place", F.md5(text))
    if not by:
        return placed.orderBy("__place", *key).limit(limit).drop("__place")
    return placed.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= limit).drop("__place", "__nth")


def suite_evidence(tables: Tables, checks: Iterable[Check], keys: dict[str, Sequence[str]], limit: int = 100,
                   as_of: Column | str | None = None) -> DataFrame:
    """Failing rows of many checks: ``check_id, dataset, record`` (the row as JSON), ``limit`` of each check.

    Row-level checks of a table are told apart in one scan, which tags each row with the checks it
    fails; tasks keep their first rows of each check before the shuffle. The rows are those that
    ``first_by_hash`` takes of each check's ``violations``. Checks of other kinds have a plan each.
    """
    now = moment(as_of)
    per_table: dict[str, list[Check]] = {}
    parts: list[DataFrame] = []
    for check in checks:
        if is_row_level(check):
            per_table.setdefault(check.dataset, []).append(check)
        else:
            rows = violations(tables, check, now)
            key = [c for c in keys[check.dataset] if c in rows.columns] or rows.columns
            parts.append(first_by_hash(rows, key, limit).select(
                F.lit(check.check_id).alias("check_id"), F.lit(check.dataset).alias("dataset"), F.to_json(F.struct(*rows.columns)).alias("record")))
    for name, group in per_table.items():
        df, tags = tables[name], []
        for check in group:
            rule = row_rule(check, now)
            scope = _scope(check, rule)
            tags.append(F.when(rule.failed if scope is None else scope & rule.failed, F.lit(check.check_id)))
        tagged = df.withColumn("__checks", F.array_compact(F.array(*tags))).where(F.size("__checks") > 0)
        each = tagged.select(F.explode("__checks").alias("__check"), *df.columns)
        parts.append(first_by_hash(each, keys[name], limit, ["__check"]).select(
            F.col("__check").alias("check_id"), F.lit(name).alias("dataset"), F.to_json(F.struct(*df.columns)).alias("record")))
    return reduce(DataFrame.unionByName, parts)


def independent(members: Sequence[Check], group_id: str) -> list[tuple[Check, str]]:
    """An INDEPENDENT group: its members run as separate checks under one id."""
    return [(member, group_id) for member in members]
