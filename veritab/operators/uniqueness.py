"""Duplicate detection: exact keys, across datasets, and within a time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import predicates as X
from veritab.functions.relations import (
    conjunction, count_rows, key_tallies, match_keys, sum_where,
)
from veritab.model import Check, TablePlan

_GROUP_EXTRAS = ("duplicate_groups", "max_group_size", "avg_group_size")


def _key(check: Check, name: str) -> Column:
    col = F.col(name)
    return col if check.param("case_sensitive", True) else F.lower(col.cast("string"))


def duplicate_counts(groups: DataFrame) -> DataFrame:
    """Fold ``n`` rows per key into the uniqueness counts."""
    many = F.col("n") > 1
    counts = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        sum_where(many, F.col("n")).alias("failed_rows"),
        count_rows(many).alias("duplicate_groups"),
        F.coalesce(F.max(F.when(many, F.col("n"))), F.lit(0)).alias("max_group_size"),
    )
    return _complete(counts).withColumn(
        "avg_group_size",
        F.when(F.col("duplicate_groups") > 0, F.round(F.try_divide(
            F.col("failed_rows").cast("double"), F.col("duplicate_groups")), 2)).otherwise(0.0))


def _complete(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "passed_rows": F.col("total_rows") - F.col("failed_rows"),
        "skipped_rows": F.lit(0).cast("long"),
        "evaluated_rows": F.col("total_rows"),
    })


def keyed(check: Check, df: DataFrame) -> DataFrame:
    """Exact, composite and scoped: one group-by on the keys serves all counts."""
    scope = list(check.need("scope_columns")) if check.subtype == "scoped" else []
    keep_nulls = check.param("null_handling", "exclude") == "include"
    if not keep_nulls:
        df = df.where(conjunction([F.col(c).isNotNull() for c in check.columns]))
    names = {f"__k{i}": F.col(c) for i, c in enumerate(scope)}
    for i, c in enumerate(check.columns, start=len(scope)):
        names[f"__k{i}"] = _key(check, c)
    return df.withColumns(names)


def exact(check: Check, df: DataFrame) -> TablePlan:
    rows = keyed(check, df)
    names = [c for c in rows.columns if c.startswith("__k")]
    groups = rows.groupBy(*names).agg(F.count("*").alias("n"))

    def violations() -> DataFrame:
        repeated = groups.where(F.col("n") > 1)
        return match_keys(rows, repeated, "left_semi", names, null_safe=True).drop(*names)

    return TablePlan(duplicate_counts(groups), violations, _GROUP_EXTRAS)


def cross_dataset(check: Check, df: DataFrame, other: DataFrame) -> TablePlan:
    other_col = check.need("cross_dataset_column")
    left = df.withColumn("__k0", _key(check, check.column))
    right = other.select(_key(check, other_col).alias("__k0")).where(F.col("__k0").isNotNull())
    tallies = key_tallies(left, right, [("__k0", "__k0")])
    shared = F.col("keyed") & (F.col("n_left") > 0) & (F.col("n_right") > 0)
    counts = _complete(tallies.agg(
        F.coalesce(F.sum("n_left"), F.lit(0)).alias("total_rows"),
        sum_where(shared, F.col("n_left")).alias("failed_rows"),
        count_rows(shared).alias("duplicate_groups"),
    ))

    def violations() -> DataFrame:
        return match_keys(left, right.distinct(), "left_semi", ["__k0"]).drop("__k0")

    return TablePlan(counts, violations, ("duplicate_groups",))


def temporal(check: Check, df: DataFrame) -> TablePlan:
    """Rows with another row of the same key at most a window away.

    Time is cut into cells as wide as the window. Two rows in one cell are always
    close enough, so only a row alone in its cell has to look further, and then
    only at the latest row of the cell before and the earliest of the cell after.
    Everything is a group-by on (key, cell): a hot key spreads over its cells.
    """
    ts = F.col(check.need("temporal_column"))
    width = X.duration_seconds(check.need("temporal_window")) * 1_000_000
    cell_width = max(width, 1)
    at = X.epoch_micros(ts)
    names = {f"__k{i}": _key(check, c) for i, c in enumerate(check.columns)}
    rows = df.withColumns({**names, "__at": at}).withColumn(
        "__cell", ((F.col("__at") - F.pmod("__at", F.lit(cell_width))) / cell_width).cast("long"))
    keys = [*names, "__cell"]
    comparable = rows.where(conjunction([F.col(c).isNotNull() for c in keys]))
    cells = comparable.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("__at").alias("lo"), F.max("__at").alias("hi"))
    none = F.lit(None).cast("long")

    def shifted(step: int, n: Column, own: Column, before: Column, after: Column) -> Column:
        return F.struct((F.col("__cell") + step).alias("__cell"), n.alias("n"),
                        own.alias("own"), before.alias("before"), after.alias("after"))

    seen = (
        cells.select(*names, F.inline(F.array(
            shifted(0, F.col("n"), F.col("lo"), none, none),
            shifted(1, none, none, F.col("hi"), none),
            shifted(-1, none, none, none, F.col("lo")),
        )))
        .groupBy(*keys)
        .agg(F.max("n").alias("n"), F.max("own").alias("own"),
             F.max("before").alias("before"), F.min("after").alias("after"))
    )
    near = (F.col("own") - F.col("before") <= width) | (F.col("after") - F.col("own") <= width)
    close = seen.where((F.col("n") > 1) | ((F.col("n") == 1) & near))
    counts = _complete(
        df.agg(F.count("*").alias("total_rows")).crossJoin(
            F.broadcast(close.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failed_rows")))))

    def violations() -> DataFrame:
        return match_keys(comparable, close, "left_semi", keys).drop(*keys, "__at")

    return TablePlan(counts, violations)
