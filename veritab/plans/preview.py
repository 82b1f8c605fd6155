"""Dry run of a simple condition: counts and example rows, before a check is saved."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import predicates as X
from veritab.functions.patterns import java_regex
from veritab.functions.relations import count_rows
from veritab.model import rate


def violating(subtype: str, config: Mapping[str, Any]) -> Column:
    """Condition that is true for violating rows, of the subtypes a preview knows."""
    columns = config.get("columns") or []
    if not columns:
        raise ValueError(f"{subtype} needs a column")
    col = F.col(columns[0])
    value, other = config.get("value"), config.get("compare_column")

    def fails(left: Column, default: str, right: Column) -> Column:
        op = X.canonical_operator(config.get("operator"), default)
        return X.compare(left, X.INVERSE[op], right)

    if subtype == "null":
        return col.isNull()
    if subtype == "not_null":
        return col.isNotNull()
    if subtype == "range" and value is not None:
        return fails(col, ">", F.lit(value))
    if subtype == "allowed_values" and config.get("value_list"):
        return ~col.isin(list(config["value_list"]))
    if subtype == "regex" and config.get("regex_pattern"):
        return ~col.rlike(java_regex(config["regex_pattern"]))
    if subtype == "length" and value is not None:
        return fails(F.char_length(col), "<=", F.lit(value))
    if subtype == "date_comparison" and other:
        return fails(col, ">", F.col(other))
    if subtype == "date_comparison" and value is not None:
        return fails(col, ">", F.lit(value).cast("timestamp"))
    if subtype == "column_comparison" and other:
        return fails(col, "=", F.col(other))
    raise ValueError(f"no preview for {subtype} with these settings")


def _repeated(df: DataFrame, column: str) -> DataFrame:
    """Rows flagged ``__bad`` where the value of ``column`` occurs more than once."""
    many = (df.groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
            .where((F.col("__n") > 1) & F.col("__v").isNotNull()).select("__v"))
    return df.join(many, F.col(column) == F.col("__v"), "left").withColumn(
        "__bad", F.col("__v").isNotNull()).drop("__v")


def _judged(df: DataFrame, subtype: str, config: Mapping[str, Any]) -> DataFrame:
    if subtype in ("unique", "uniqueness"):
        return _repeated(df, config["columns"][0])
    return df.withColumn("__bad", F.coalesce(violating(subtype, config), F.lit(False)))


def preview_counts(df: DataFrame, subtype: str, config: Mapping[str, Any]) -> DataFrame:
    judged = _judged(df, subtype, config)
    bad = F.col("__bad")
    counted = judged.agg(F.count("*").alias("total_rows"), count_rows(~bad).alias("pass_rows"),
                         count_rows(bad).alias("fail_rows"))
    return counted.withColumn("pass_rate", rate(F.col("pass_rows"), F.col("total_rows")))


def preview_violations(df: DataFrame, subtype: str, config: Mapping[str, Any]) -> DataFrame:
    return _judged(df, subtype, config).where("__bad").drop("__bad")
