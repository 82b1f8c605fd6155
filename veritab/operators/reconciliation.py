"""Comparing a source with a target dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import predicates as X
from veritab.functions.nearby import pairs_within
from veritab.functions.relations import (
    conjunction, count_rows, key_pairs, key_tallies, match_keys, sum_where,
)
from veritab.model import Check, TablePlan, Tables
from veritab.operators.tablelevel import aggregate, columns_equal, joined_pairs


def sides(check: Check, tables: Tables) -> tuple[DataFrame, DataFrame]:
    source, target = tables[check.need("source_dataset")], tables[check.need("target_dataset")]
    if check.param("source_filter"):
        source = source.where(check.params["source_filter"])
    if check.param("target_filter"):
        target = target.where(check.params["target_filter"])
    return source, target


def _counts(df: DataFrame, total: Column, passed: Column, failed: Column,
            *extras: str) -> DataFrame:
    return df.select(
        total.cast("long").alias("total_rows"), passed.cast("long").alias("passed_rows"),
        failed.cast("long").alias("failed_rows"), F.lit(0).cast("long").alias("skipped_rows"),
        total.cast("long").alias("evaluated_rows"), *extras)


def record_count(source: DataFrame, target: DataFrame) -> TablePlan:
    stacked = source.select(F.lit("source").alias("side")).unionByName(
        target.select(F.lit("target").alias("side")))
    seen = stacked.agg(count_rows(F.col("side") == "source").alias("source_count"),
                       count_rows(F.col("side") == "target").alias("target_count"))
    s, t = F.col("source_count"), F.col("target_count")
    counts = _counts(seen, F.greatest(s, t), F.least(s, t), F.abs(s - t),
                     "source_count", "target_count")
    return TablePlan(counts, lambda: stacked.groupBy("side").agg(F.count("*").alias("row_count")),
                     ("source_count", "target_count"))


def unmatched(source: DataFrame, target: DataFrame, pairs) -> DataFrame:
    """Rows without partner on either side, tagged with where they are missing."""
    names = [f"__k{i}" for i in range(len(pairs))]
    a = source.withColumns({n: F.col(s) for n, (s, _) in zip(names, pairs)})
    b = target.withColumns({n: F.col(t) for n, (_, t) in zip(names, pairs)})
    missing = match_keys(a, b.select(*names), "left_anti", names).drop(*names)
    extra = match_keys(b, a.select(*names), "left_anti", names).drop(*names)
    return missing.withColumn("recon_status", F.lit("missing_in_target")).unionByName(
        extra.withColumn("recon_status", F.lit("extra_in_target")), allowMissingColumns=True)


def _sizes() -> list[Column]:
    return [F.coalesce(F.sum("n_left"), F.lit(0)).alias("source_count"),
            F.coalesce(F.sum("n_right"), F.lit(0)).alias("target_count")]


def one_to_one(source: DataFrame, target: DataFrame, pairs) -> TablePlan:
    """Full outer join counts: duplicates multiply, as joined rows would."""
    tallies = key_tallies(source, target, pairs)
    l, r, keyed = F.col("n_left"), F.col("n_right"), F.col("keyed")
    both = keyed & (l > 0) & (r > 0)
    known = F.col("__k0").isNotNull()
    seen = tallies.agg(
        *_sizes(),
        sum_where(both, l * r).alias("matched_count"),
        sum_where(~both & known, l).alias("missing_in_target"),
        sum_where(~both & known, r).alias("extra_in_target"),
    )
    extras = ("source_count", "target_count", "matched_count", "missing_in_target",
              "extra_in_target")
    counts = _counts(seen, F.greatest("source_count", "target_count"), F.col("matched_count"),
                     F.col("missing_in_target") + F.col("extra_in_target"), *extras)
    return TablePlan(counts, lambda: unmatched(source, target, pairs), extras)


def missing_extra(source: DataFrame, target: DataFrame, pairs) -> TablePlan:
    """Anti-joins both ways; the slots are the source rows plus the extra ones."""
    tallies = key_tallies(source, target, pairs)
    l, r, keyed = F.col("n_left"), F.col("n_right"), F.col("keyed")
    seen = tallies.agg(
        *_sizes(),
        sum_where(~(keyed & (r > 0)), l).alias("missing_in_target"),
        sum_where(~(keyed & (l > 0)), r).alias("extra_in_target"),
    )
    slots = F.col("source_count") + F.col("extra_in_target")
    lost = F.col("missing_in_target") + F.col("extra_in_target")
    extras = ("source_count", "target_count", "missing_in_target", "extra_in_target")
    return TablePlan(_counts(seen, slots, slots - lost, lost, *extras),
                     lambda: unmatched(source, target, pairs), extras)


def _aggregates_match(s: Column, t: Column, kind: str, value: float | None) -> Column:
    """Compare two aggregates; a missing one is 0, a percentage is of the source."""
    s, t = F.coalesce(s, F.lit(0)), F.coalesce(t, F.lit(0))
    if kind == "absolute" and value is not None:
        return F.abs(s - t) <= value
    if kind == "percentage" and value is not None:
        share = F.abs(s - t) / F.nullif(F.abs(s), F.lit(0)) * 100
        return F.when(s == 0, s == t).otherwise(share <= value)
    return s == t


def grouped_aggregates(check: Check, source: DataFrame, target: DataFrame) -> DataFrame:
    """Per group: both aggregates and whether they match (full outer)."""
    groups = list(check.need("group_by_columns"))
    fn, column = check.param("aggregate_function", "SUM"), check.need("aggregate_column")
    a = source.groupBy(*groups).agg(aggregate(fn, column).alias("source_agg"))
    b = target.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]).agg(
        aggregate(fn, column).alias("target_agg"))
    on = [F.col(g) == F.col(f"__g{i}") for i, g in enumerate(groups)]
    match = _aggregates_match(F.col("source_agg"), F.col("target_agg"),
                              check.param("tolerance_type", "none"),
                              check.params.get("tolerance_value"))
    return a.join(b, on, "full_outer").select(
        *[F.coalesce(F.col(g), F.col(f"__g{i}")).alias(g) for i, g in enumerate(groups)],
        "source_agg", "target_agg", match.alias("matches"))


def aggregates(check: Check, source: DataFrame, target: DataFrame) -> TablePlan:
    if check.param("group_by_columns"):
        compared = grouped_aggregates(check, source, target)
        seen = compared.agg(F.count("*").alias("n"), count_rows(F.col("matches")).alias("ok"))
        counts = _counts(seen, F.col("n"), F.col("ok"), F.col("n") - F.col("ok"))
        return TablePlan(counts, lambda: compared.where(~F.col("matches")).drop("matches"))
    fn, column = check.param("aggregate_function", "SUM"), check.need("aggregate_column")
    both = source.agg(aggregate(fn, column).alias("source_agg")).crossJoin(
        F.broadcast(target.agg(aggregate(fn, column).alias("target_agg"))))
    match = _aggregates_match(F.col("source_agg"), F.col("target_agg"),
                              check.param("tolerance_type", "none"),
                              check.params.get("tolerance_value"))
    ok = F.coalesce(match, F.lit(False))
    counts = _counts(both, F.lit(1), ok.cast("int"), (~ok).cast("int"),
                     "source_agg", "target_agg")
    return TablePlan(counts, lambda: both.where(~ok), ("source_agg", "target_agg"))


def tolerance(check: Check, source: DataFrame, target: DataFrame, pairs) -> TablePlan:
    """Inner join on the keys, one column within tolerance.

    Copies of (key, value) collapse to a weight first. The number of pairs per key
    is a product of counts; only pairs of nearby values are formed and compared,
    so a key that repeats on both sides does not multiply out.
    """
    column = check.param("compare_column") or check.column
    kind, value = check.param("tolerance_type", "absolute"), check.params.get("tolerance_value")
    if kind != "none" and value is None:
        raise ValueError(f"{check.check_id}: {kind} tolerance needs tolerance_value")
    if kind == "none":
        return columns_equal(check, source, target, pairs, [(column, column)])
    names = [f"__k{i}" for i in range(len(pairs))]

    def weighted(df: DataFrame, which: int) -> DataFrame:
        keyed = df.select(*[F.col(p[which]).alias(n) for n, p in zip(names, pairs)],
                          F.col(column).alias("v"))
        keyed = keyed.where(conjunction([F.col(n).isNotNull() for n in names]))
        return keyed.groupBy(*names, "v").agg(F.count("*").alias("n"))

    a, b = weighted(source, 0), weighted(target, 1)
    # A pair is comparable when both values are there and the percentage is defined.
    usable = [F.col("v").isNotNull(), F.col("v").isNotNull()]
    if kind == "percentage":
        usable[1] = usable[1] & (F.col("v") != 0)
    zero = F.lit(0).cast("long")
    stacked = [
        df.select(*names, *[c.alias(x) for c, x in zip(
            (F.col("n"), zero, F.when(ok, F.col("n")).otherwise(zero), zero) if side == 0 else
            (zero, F.col("n"), zero, F.when(ok, F.col("n")).otherwise(zero)),
            ("l", "r", "l_ok", "r_ok"))])
        for side, (df, ok) in enumerate(zip((a, b), usable))]
    per_key = stacked[0].unionByName(stacked[1]).groupBy(*names).agg(
        *[F.sum(c).alias(c) for c in ("l", "r", "l_ok", "r_ok")])
    totals = per_key.agg(
        F.coalesce(F.sum(F.col("l") * F.col("r")), zero).alias("pairs"),
        F.coalesce(F.sum(F.col("l_ok") * F.col("r_ok")), zero).alias("comparable"))

    near = pairs_within(a.where(usable[0]), b.where(usable[1]), names, kind, value)
    seen = totals.crossJoin(F.broadcast(near))

    def violations() -> DataFrame:
        within = X.within_tolerance(F.col("__l0"), F.col("__r0"), kind, value)
        pairs_out = joined_pairs(source, target, pairs, [(column, column)])
        return pairs_out.where(~within).drop(*names, "__l0").withColumnRenamed(
            "__r0", f"target_{column}")

    return TablePlan(
        _counts(seen, F.col("pairs"), F.col("ok"), F.col("comparable") - F.col("ok")), violations)


def plan(check: Check, tables: Tables) -> TablePlan:
    source, target = sides(check, tables)
    if check.subtype == "record_count":
        return record_count(source, target)
    if check.subtype == "aggregate":
        return aggregates(check, source, target)
    pairs = key_pairs(check.need("join_keys"))
    if check.subtype == "one_to_one":
        return one_to_one(source, target, pairs)
    if check.subtype == "missing_extra":
        return missing_extra(source, target, pairs)
    if check.subtype == "tolerance":
        return tolerance(check, source, target, pairs)
    return columns_equal(check, source, target, pairs,
                         [(c, c) for c in check.need("compare_columns")])
