"""Checks that need a second table, a grouping, or a statistic of the whole column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions import predicates as X
from veritab.functions.nearby import pairs_within
from veritab.functions.quantiles import quantile_row
from veritab.functions.relations import (
    attach_one_row, conjunction, count_rows, key_pairs, key_tallies, match_keys, pair_counts,
    small_enough_to_broadcast, sum_where,
)
from veritab.model import Check, RowRule, TablePlan, Tables, rate, status, worst_status
from veritab.operators.rowlevel import count_nulls_as, drop_nulls_or

_AGGREGATES = {"SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def aggregate(name: str, column: str) -> Column:
    if name.upper() not in _AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}")
    return _AGGREGATES[name.upper()](F.col(column))


def count_rule(df: DataFrame, rule: RowRule) -> DataFrame:
    """Counts of a row verdict computed on ``df`` (after its join or statistic)."""
    if rule.population is not None:
        df = df.where(rule.population)
    skipped = count_rows(rule.skipped) if rule.skipped is not None else F.lit(0).cast("long")
    counted = df.agg(
        F.count("*").alias("total_rows"),
        count_rows(rule.passed).alias("passed_rows"),
        count_rows(rule.failed).alias("failed_rows"),
        skipped.alias("skipped_rows"),
    )
    return counted.withColumn("evaluated_rows", F.col("total_rows") - F.col("skipped_rows"))


def failing(df: DataFrame, rule: RowRule) -> DataFrame:
    if rule.population is not None:
        df = df.where(rule.population)
    return df.where(rule.failed)


# --- completeness by group -------------------------------------------------

def group_completeness(check: Check, df: DataFrame) -> DataFrame:
    """One row per group, worst rate first in the reference's reports."""
    groups = list(check.need("group_by_columns"))
    present = F.count("*") if check.columns in ((), ("*",)) else F.count(F.col(check.column))
    per_group = df.groupBy(*groups).agg(
        F.count("*").alias("total_rows"), present.alias("passed_rows"))
    counted = per_group.withColumn("failed_rows", F.col("total_rows") - F.col("passed_rows"))
    counted = counted.withColumn("pass_rate", rate(F.col("passed_rows"), F.col("total_rows")))
    return counted.withColumn(
        "check_status", status(F.col("pass_rate"), check.threshold_pass, check.threshold_warn))


def completeness_by_group(check: Check, df: DataFrame) -> TablePlan:
    per_group = group_completeness(check, df)
    total = F.coalesce(F.sum("total_rows"), F.lit(0))
    counts = per_group.agg(
        total.alias("total_rows"),
        F.coalesce(F.sum("passed_rows"), F.lit(0)).alias("passed_rows"),
        F.coalesce(F.sum("failed_rows"), F.lit(0)).alias("failed_rows"),
        F.lit(0).cast("long").alias("skipped_rows"),
        total.alias("evaluated_rows"),
        F.coalesce(worst_status(F.col("check_status")), F.lit("PASS")).alias("check_status"),
        F.count("*").alias("group_count"),
    )
    column = None if check.columns in ((), ("*",)) else check.column

    def violations() -> DataFrame:
        return df.where(F.col(column).isNull() if column else F.lit(False))

    return TablePlan(counts, violations, ("group_count",))


# --- lookups ---------------------------------------------------------------

def _among(check: Check, df: DataFrame, value: Column, allowed: DataFrame) -> TablePlan:
    """Rows whose value is among the values of ``allowed.__k0``; copies there do not count.

    A reference known to be small is joined by broadcast. Otherwise both sides
    are tallied by value, so a value that fills a third of the table is one row
    per task before anything is shuffled.
    """
    missing = value.isNull()
    known = allowed.where(F.col("__k0").isNotNull()).distinct().select(
        F.col("__k0").alias("__known"))

    def flagged() -> DataFrame:
        return df.join(known, value == F.col("__known"), "left")

    rule = count_nulls_as(check, F.col("__known").isNotNull(), missing)
    if small_enough_to_broadcast(known):
        counts = count_rule(flagged(), rule)
    else:
        tallies = key_tallies(df.select(value.alias("__k0")), allowed, [("__k0", "__k0")])
        found = F.col("keyed") & (F.col("n_right") > 0)
        per_value = count_nulls_as(check, found, ~F.col("keyed"))
        n = F.col("n_left")
        skipped = F.lit(False) if per_value.skipped is None else per_value.skipped
        counts = tallies.agg(
            F.coalesce(F.sum(n), F.lit(0)).alias("total_rows"),
            sum_where(per_value.passed, n).alias("passed_rows"),
            sum_where(per_value.failed, n).alias("failed_rows"),
            sum_where(skipped, n).alias("skipped_rows"),
        ).withColumn("evaluated_rows", F.col("total_rows") - F.col("skipped_rows"))
    return TablePlan(counts, lambda: failing(flagged(), rule).drop("__known"))


def lookup(check: Check, df: DataFrame, reference: DataFrame) -> TablePlan:
    allowed = reference.select(F.col(check.need("reference_column")).alias("__k0"))
    return _among(check, df, F.col(check.column), allowed)


def custom_sql(check: Check, df: DataFrame) -> TablePlan:
    """A SELECT returning ``total`` and ``failed``; ``{dataset}`` names the data.

    Violations are the rows of ``violations_sql``, a second SELECT; without it, the identifiers
    of a third column ``sample`` (a JSON array, as text in ``row_id``). A statement that has
    neither lists no rows, and asking for them is an error.
    """
    answer = df.sparkSession.sql(check.need("sql"), dataset=df)
    counts = answer.select(
        F.col("total").cast("long").alias("total_rows"),
        (F.col("total") - F.col("failed")).cast("long").alias("passed_rows"),
        F.col("failed").cast("long").alias("failed_rows"),
        F.lit(0).cast("long").alias("skipped_rows"),
        F.col("total").cast("long").alias("evaluated_rows"),
    )

    def violations() -> DataFrame:
        if check.param("violations_sql"):
            return df.sparkSession.sql(check.need("violations_sql"), dataset=df)
        if "sample" in answer.columns:
            return answer.select(F.explode(F.from_json(F.col("sample").cast("string"), "array<string>")).alias("row_id"))
        raise ValueError(f"{check.check_id}: its statement lists no rows; name violations_sql or return a column sample")

    return TablePlan(counts, violations)


# --- consistency -----------------------------------------------------------

def inter_record(check: Check, df: DataFrame) -> TablePlan:
    """All rows of a group are inconsistent when the group holds two values.

    Two distinct values exist exactly when the least differs from the greatest,
    so no distinct count is needed.
    """
    groups = list(check.need("group_by_columns"))
    value = F.col(check.need("comparison_columns")[0])
    if check.param("null_handling", "fail") == "skip":
        df = df.where(value.isNotNull())
    rows = df.withColumns({f"__k{i}": F.col(c) for i, c in enumerate(groups)})
    names = [f"__k{i}" for i in range(len(groups))]
    stats = rows.groupBy(*names).agg(
        F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    mixed = F.coalesce(F.col("least") != F.col("greatest"), F.lit(False))
    total = F.coalesce(F.sum("n"), F.lit(0))
    counts = stats.agg(
        total.alias("total_rows"), sum_where(~mixed, F.col("n")).alias("passed_rows"),
        sum_where(mixed, F.col("n")).alias("failed_rows"),
        F.lit(0).cast("long").alias("skipped_rows"), total.alias("evaluated_rows"),
        count_rows(mixed).alias("inconsistent_groups"),
    )

    def violations() -> DataFrame:
        return match_keys(rows, stats.where(mixed), "left_semi", names, null_safe=True).drop(*names)

    return TablePlan(counts, violations, ("inconsistent_groups",))


def joined_pairs(left: DataFrame, right: DataFrame, keys, compared) -> DataFrame:
    """Inner join with both sides' compared columns as ``__l*`` and ``__r*``."""
    a = left.withColumns({
        **{f"__k{i}": F.col(s) for i, (s, _) in enumerate(keys)},
        **{f"__l{i}": F.col(s) for i, (s, _) in enumerate(compared)}})
    b = right.select(*[F.col(t).alias(f"__k{i}") for i, (_, t) in enumerate(keys)],
                     *[F.col(t).alias(f"__r{i}") for i, (_, t) in enumerate(compared)])
    return match_keys_keep(a, b, [f"__k{i}" for i in range(len(keys))])


def match_keys_keep(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    renamed = b.withColumnsRenamed({n: f"{n}__r" for n in names})
    on = conjunction([F.col(n) == F.col(f"{n}__r") for n in names])
    return a.join(renamed, on).drop(*[f"{n}__r" for n in names])


def columns_equal(check: Check, left: DataFrame, right: DataFrame, keys, compared) -> TablePlan:
    """Inner join on the keys, all compared columns equal (consistency, reconciliation)."""
    found = pair_counts(left, right, keys, compared)
    counts = found.select(
        F.col("pairs").alias("total_rows"), F.col("equal_pairs").alias("passed_rows"),
        F.col("differing_pairs").alias("failed_rows"),
        F.lit(0).cast("long").alias("skipped_rows"), F.col("pairs").alias("evaluated_rows"))

    def violations() -> DataFrame:
        pairs = joined_pairs(left, right, keys, compared)
        same = conjunction([F.col(f"__l{i}") == F.col(f"__r{i}") for i in range(len(compared))])
        shown = pairs.where(~same).drop(
            *[f"__k{i}" for i in range(len(keys))], *[f"__l{i}" for i in range(len(compared))])
        return shown.withColumnsRenamed(
            {f"__r{i}": f"target_{t}" for i, (_, t) in enumerate(compared)})

    return TablePlan(counts, violations)


def aggregation(check: Check, df: DataFrame, header_source: DataFrame) -> TablePlan:
    """An aggregate per group against the header values recorded for the group."""
    groups = list(check.need("group_by_columns"))
    expected = check.need("expected_column")
    computed = df.groupBy(*groups).agg(
        aggregate(check.need("aggregation_function"), check.column).alias("computed_value"))
    header = header_source.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        F.col(expected).alias("expected_value")).distinct()
    on = conjunction([F.col(g) == F.col(f"__g{i}") for i, g in enumerate(groups)])
    compared = computed.join(header, on).drop(*[f"__g{i}" for i in range(len(groups))])
    ok = X.within_tolerance(F.col("computed_value"), F.col("expected_value"),
                            check.param("tolerance_type", "absolute"),
                            check.param("tolerance_value"))
    rule = RowRule(ok, ~ok)
    return TablePlan(count_rule(compared, rule), lambda: failing(compared, rule))


# --- accuracy and statistics ------------------------------------------------

def _reference_counts(check: Check, df: DataFrame, ref: DataFrame, keys, kind: str, value) -> DataFrame:
    """Counts of ``against_reference`` from weighted values; no joined rows.

    Per key the pairs are products of counts; only the pairs within tolerance are counted
    value by value, equal values without a join and others among their neighbours.
    """
    names, v = [f"__k{i}" for i in range(len(keys))], F.col("v")
    policy = check.param("null_handling", "fail")
    own = df.select(*[F.col(s).alias(n) for n, (s, _) in zip(names, keys)], F.col(check.column).alias("v"))
    own = (own.where(v.isNotNull()) if policy == "skip" else own).groupBy(*names, "v").agg(F.count("*").alias("n"))
    trusted = ref.select(*[F.col(f"__r{i}").alias(n) for i, n in enumerate(names)], F.col("__trusted").alias("v"),
                         F.col("__copies").alias("n")).where(conjunction([F.col(n).isNotNull() for n in names]))
    usable = v.isNotNull() & (v != 0) if kind == "percentage" else v.isNotNull()
    zero = F.lit(0).cast("long")

    def some(cond: Column) -> Column:
        return F.when(cond, F.col("n")).otherwise(zero)

    sides = own.select(*names, F.col("n").alias("l"), some(v.isNotNull()).alias("l_val"), zero.alias("r"), zero.alias("r_val"), zero.alias("r_use"))
    sides = sides.unionByName(trusted.select(
        *names, zero.alias("l"), zero.alias("l_val"), F.col("n").alias("r"), some(v.isNotNull()).alias("r_val"), some(usable).alias("r_use")))
    per_key = sides.groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("l", "l_val", "r", "r_val", "r_use")])

    def total(product: Column) -> Column:
        return F.coalesce(F.sum(product), F.lit(0)).cast("long")

    sums = per_key.agg(
        total(F.col("l") * F.greatest("r", F.lit(1))).alias("total_rows"), total(F.col("l") * F.col("r_val")).alias("verified_rows"),
        total(F.col("l_val") * F.col("r_use")).alias("comparable"), total((F.col("l") - F.col("l_val")) * F.col("r_val")).alias("missing"))
    near = pairs_within(own.where(v.isNotNull()), trusted.where(usable), names, kind, value)
    passed = F.col("ok") + F.col("missing") if policy == "pass" else F.col("ok")
    return attach_one_row(sums, near).select(
        "total_rows", passed.alias("passed_rows"), (F.col("comparable") - F.col("ok")).alias("failed_rows"),
        F.lit(0).cast("long").alias("skipped_rows"), "verified_rows",
        (F.col("total_rows") - F.col("verified_rows")).alias("unverifiable_rows"), F.col("verified_rows").alias("evaluated_rows"))


def against_reference(check: Check, df: DataFrame, reference: DataFrame) -> TablePlan:
    """Left join to trusted values; rows without one are unverifiable."""
    column = check.column
    keys = key_pairs(check.need("join_keys"))
    kind, value = check.param("tolerance_type", "none"), check.params.get("tolerance_value")
    if check.subtype == "tolerated_deviation" and (kind == "none" or value is None):
        raise ValueError(f"{check.check_id}: needs tolerance_type and tolerance_value")
    # Copies of a reference row collapse to a weight and are not joined one by one.
    ref = reference.groupBy(
        F.col(check.param("reference_column", column)).alias("__trusted"),
        *[F.col(t).alias(f"__r{i}") for i, (_, t) in enumerate(keys)],
    ).agg(F.count("*").alias("__copies"))
    on = conjunction([F.col(s) == F.col(f"__r{i}") for i, (s, _) in enumerate(keys)])
    joined = df.join(ref, on, "left").drop(*[f"__r{i}" for i in range(len(keys))])
    trusted, copies = F.col("__trusted"), F.coalesce(F.col("__copies"), F.lit(1))
    verdict = drop_nulls_or(check, X.within_tolerance(F.col(column), trusted, kind, value),
                            F.col(column).isNull(), "fail")
    verified = trusted.isNotNull()
    rule = RowRule(verified & verdict.passed, verified & verdict.failed, verdict.population)
    judged = joined if rule.population is None else joined.where(rule.population)
    types = df.schema[column].dataType, reference.schema[check.param("reference_column", column)].dataType
    if types[0] != types[1] and T.StringType() in types:  # text against a number: as the comparison casts it
        counts = judged.agg(
            F.coalesce(F.sum(copies), F.lit(0)).alias("total_rows"),
            sum_where(rule.passed, copies).alias("passed_rows"),
            sum_where(rule.failed, copies).alias("failed_rows"),
            F.lit(0).cast("long").alias("skipped_rows"),
            sum_where(verified, copies).alias("verified_rows"),
            sum_where(~verified, copies).alias("unverifiable_rows"),
        ).withColumn("evaluated_rows", F.col("verified_rows"))
    else:
        counts = _reference_counts(check, df, ref, keys, kind, value)

    def violations() -> DataFrame:
        repeated = failing(joined, rule).withColumn(
            "__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
        return repeated.drop("__nth", "__copies").withColumnRenamed("__trusted", "reference_value")

    return TablePlan(counts, violations, ("verified_rows", "unverifiable_rows"))


def statistical(check: Check, df: DataFrame) -> TablePlan:
    """z-score or interquartile bounds, from statistics of the filtered rows."""
    column = F.col(check.column)
    if check.param("statistical_method", "zscore") == "zscore":
        limit = float(check.param("statistical_threshold", 3.0))
        stats = df.agg(F.avg(column).alias("__mu"), F.stddev_samp(column).alias("__sigma"))
        spread = F.nullif(F.col("__sigma"), F.lit(0.0))
        ok = F.abs(column - F.col("__mu")) / spread <= limit
        names = ("__mu", "__sigma")
    else:
        k = float(check.param("statistical_threshold", 1.5))
        stats = quantile_row(df, column, [0.25, 0.75]).select(
            F.col("q0").alias("__q1"), F.col("q1").alias("__q3"))
        reach = F.lit(k) * (F.col("__q3") - F.col("__q1"))
        ok = (column >= F.col("__q1") - reach) & (column <= F.col("__q3") + reach)
        names = ("__q1", "__q3")
    judged = attach_one_row(df, stats)
    rule = drop_nulls_or(check, ok, column.isNull(), "fail")
    return TablePlan(count_rule(judged, rule), lambda: failing(judged, rule).drop(*names))


def outliers(check: Check, df: DataFrame) -> TablePlan:
    """Rows outside mean ± 3 standard deviations."""
    column = F.col(check.column)
    stats = df.agg(F.avg(column).alias("__mu"), F.stddev_samp(column).alias("__sigma"))
    judged = attach_one_row(df, stats)
    far = ((column < F.col("__mu") - F.lit(3) * F.col("__sigma"))
           | (column > F.col("__mu") + F.lit(3) * F.col("__sigma")))
    far = F.coalesce(far, F.lit(False))
    rule = RowRule(~far, far)
    return TablePlan(count_rule(judged, rule), lambda: failing(judged, rule).drop("__mu", "__sigma"))


def column_statistics(df: DataFrame, column: str, where: str | None = None) -> DataFrame:
    """Row count and mean, standard deviation, least and greatest non-NULL value."""
    if where:
        df = df.where(where)
    col = F.col(column)
    return df.agg(
        F.count("*").alias("total_rows"), F.avg(col).alias("mean_value"),
        F.stddev_samp(col).alias("stddev_value"), F.min(col).alias("min_value"),
        F.max(col).alias("max_value"))


# --- timeliness of a whole table --------------------------------------------

def _age(ts: Column, as_of: Column) -> Column:
    return X.epoch_micros(as_of) - X.epoch_micros(F.max(ts))


def table_timeliness(check: Check, df: DataFrame, as_of: Column) -> TablePlan:
    ts = F.col(check.param("timestamp_column") or check.column)
    if check.subtype == "delay_metric":
        return delay_metric(check, df, ts)
    limit_name = "expected_frequency" if check.subtype == "heartbeat" else "max_age"
    limit = X.duration_seconds(check.need(limit_name)) * 1_000_000
    seen = df.agg(F.count("*").alias("n"), F.max(ts).alias("most_recent"),
                  _age(ts, as_of).alias("age"))
    fresh = F.coalesce(F.col("age") <= limit, F.lit(False))
    stale = F.coalesce(F.col("age") > limit, F.lit(False))
    weight = F.col("n")
    if check.subtype == "heartbeat":
        weight, stale = F.lit(1).cast("long"), stale | (F.col("n") == 0)
    none = F.lit(0).cast("long")
    counts = seen.select(
        weight.alias("total_rows"),
        F.when(fresh, weight).otherwise(none).alias("passed_rows"),
        F.when(stale, weight).otherwise(none).alias("failed_rows"),
        none.alias("skipped_rows"), weight.alias("evaluated_rows"),
        "most_recent", (F.col("age") / 1e6).alias("age_seconds"),
    )

    def violations() -> DataFrame:
        """A stale table has no failing rows of its own: all of them are."""
        return attach_one_row(df, seen.where(stale).select("age")).drop("age")

    return TablePlan(counts, violations, ("most_recent", "age_seconds"))


def delay_metric(check: Check, df: DataFrame, ts: Column) -> TablePlan:
    """One number over all delays (max, avg, p95 or p99) against the limit."""
    other = F.col(check.need("comparison_timestamp"))
    limit = float(X.duration_seconds(check.need("max_age")))
    delay = F.abs(X.epoch_micros(other) - X.epoch_micros(ts)) / 1e6
    metric = check.param("metric_type", "max")
    if metric in ("p95", "p99"):
        value = quantile_row(df, delay, [float(metric[1:]) / 100]).select(
            F.col("q0").alias("delay_seconds"))
    else:
        value = df.agg({"max": F.max, "avg": F.avg}[metric](delay).alias("delay_seconds"))
    ok = F.coalesce(F.col("delay_seconds") <= limit, F.lit(False)).cast("long")
    bad = F.coalesce(F.col("delay_seconds") > limit, F.lit(False)).cast("long")
    one = F.lit(1).cast("long")
    counts = value.select(one.alias("total_rows"), ok.alias("passed_rows"),
                          bad.alias("failed_rows"), F.lit(0).cast("long").alias("skipped_rows"),
                          one.alias("evaluated_rows"), "delay_seconds")
    return TablePlan(counts, lambda: df.where(delay > limit), ("delay_seconds",))


def plan(check: Check, df: DataFrame, tables: Tables, as_of: Column) -> TablePlan:
    """Dispatch for the table-level checks of this module."""
    def other(name: str) -> DataFrame:
        return tables[check.need(name)]

    match check.dimension, check.subtype:
        case "completeness", "group":
            return completeness_by_group(check, df)
        case "validity", "reference_lookup":
            return lookup(check, df, other("reference_dataset"))
        case "validity", "custom_sql":
            return custom_sql(check, df)
        case "consistency", "inter_record":
            return inter_record(check, df)
        case "consistency", "cross_table":
            compared = [(c, c) for c in check.need("comparison_columns")]
            return columns_equal(check, df, other("comparison_dataset"),
                                 key_pairs(check.need("join_keys")), compared)
        case "consistency", "aggregation":
            # Headers are read unfiltered, also from the checked table itself.
            header = tables[check.param("comparison_dataset", check.dataset)]
            return aggregation(check, df, header)
        case "timeliness", _:
            return table_timeliness(check, df, as_of)
        case "accuracy", "statistical":
            return statistical(check, df)
        case "accuracy", _:
            return against_reference(check, df, other("reference_dataset"))
        case "statistical", _:
            return outliers(check, df)
    raise ValueError(f"no table-level plan for {check.dimension} {check.subtype}")
