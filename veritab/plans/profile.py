"""Column profiles: one row per column, and the checks a profile suggests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.quantiles import exact_quantiles

TOP_VALUES = 5
DISTINCT_VALUES = 10

# A bare number is never a date, though it casts to a year.
DATE_START = r"^\s*\d{4}-\d{1,2}-\d{1,2}"
WHOLE = r"^\s*[+-]?[0-9]+(\.0*)?\s*$"
# The texts that count as booleans when a text column is typed.
BOOLEAN_TEXTS = ("true", "false", "True", "False", "TRUE", "FALSE", "1", "0")


def column_kind(field: T.StructField) -> str:
    kind = field.dataType
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string"


def _of_kind(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if column_kind(f) in kinds]


def _unpivot(one_row: DataFrame, names: Sequence[str], **fields: str) -> DataFrame:
    """``{field}{i}`` columns of a single row as one row per name."""
    cells = [
        F.struct(F.lit(name).alias("column_name"),
                 *[F.col(f"{prefix}{i}").alias(out) for out, prefix in fields.items()])
        for i, name in enumerate(names)
    ]
    return one_row.select(F.inline(F.array(*cells)))


def as_text(df: DataFrame, name: str) -> Column:
    """A value as text; both zeros of a fraction are one value."""
    fraction = isinstance(df.schema[name].dataType, T.FractionalType) and not isinstance(
        df.schema[name].dataType, T.DecimalType)
    return (F.col(name) + F.lit(0.0) if fraction else F.col(name)).cast("string")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, value, n`` for every distinct value, NULL included.

    One stacked group-by serves all columns; copies collapse before the shuffle.
    """
    names = list(columns or df.columns)
    cells = [F.struct(F.lit(c).alias("column_name"), as_text(df, c).alias("value")) for c in names]
    return df.select(F.inline(F.array(*cells))).groupBy("column_name", "value").agg(
        F.count("*").alias("n"))


def profile_basic(df: DataFrame, columns: Sequence[str] | None = None,
                  relative_error: float | None = None) -> DataFrame:
    """Total, NULLs, distinct values and cardinality per column.

    Distinct counts are exact unless ``relative_error`` asks for sketches, which
    need a single pass and no shuffle of values.
    """
    names = list(columns or df.columns)
    if relative_error is not None:
        one_row = df.agg(
            F.count("*").alias("total"),
            *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(names)],
            *[F.approx_count_distinct(F.col(c), relative_error).alias(f"u{i}")
              for i, c in enumerate(names)])
        shaped = one_row.select(
            *[F.col("total").alias(f"t{i}") for i in range(len(names))],
            *[(F.col("total") - F.col(f"c{i}")).alias(f"m{i}") for i in range(len(names))],
            *[F.col(f"u{i}") for i in range(len(names))])
        base = _unpivot(shaped, names, total_count="t", null_count="m", unique_count="u")
    else:
        base = value_counts(df, names).groupBy("column_name").agg(
            F.sum("n").alias("total_count"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
            .alias("null_count"),
            F.count("value").alias("unique_count"))
    total = F.col("total_count").cast("double")
    return base.select(
        "column_name", "total_count", "null_count",
        F.coalesce(F.try_divide(F.lit(100.0) * F.col("null_count"), total), F.lit(0.0))
        .alias("null_percentage"),
        "unique_count",
        F.coalesce(F.try_divide(F.col("unique_count").cast("double"), total), F.lit(0.0))
        .alias("cardinality"))


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Least, greatest, mean, exact median and sample deviation of numeric columns."""
    names = list(columns or _of_kind(df, "integer", "float"))
    number = [F.col(c).cast("double") for c in names]
    one_row = df.agg(*[
        agg(v).alias(f"{p}{i}") for i, v in enumerate(number)
        for p, agg in (("lo", F.min), ("hi", F.max), ("mu", F.avg), ("sd", F.stddev_samp))])
    moments = _unpivot(one_row, names, min_value="lo", max_value="hi", mean="mu", std_dev="sd")
    label = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("cid") + 1)
    medians = exact_quantiles(df, number, [0.5]).select(
        label.alias("column_name"), F.col("q0").alias("median"))
    return moments.join(medians, "column_name", "left").select(
        "column_name", "min_value", "max_value", "mean", "median", "std_dev")


def _ranked(counts: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` values per column; each task keeps only its own first ``k``."""
    w = Window.partitionBy("column_name").orderBy(*order)
    return (counts.where(F.col("value").isNotNull())
            .withColumn("position", F.row_number().over(w)).where(F.col("position") <= k))


def top_values(df: DataFrame, columns: Sequence[str] | None = None,
               k: int = TOP_VALUES) -> DataFrame:
    """The most frequent values per column, ties in value order."""
    return _ranked(value_counts(df, columns), [F.desc("n"), F.asc("value")], k).select(
        "column_name", F.col("position").cast("long").alias("position"), "value",
        F.col("n").alias("value_count"))


def profile_string(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Lengths and the first distinct values (in value order) of text columns."""
    names = list(columns or _of_kind(df, "string"))
    one_row = df.agg(*[
        agg(F.char_length(F.col(c).cast("string"))).alias(f"{p}{i}")
        for i, c in enumerate(names) for p, agg in (("lo", F.min), ("hi", F.max), ("mu", F.avg))])
    lengths = _unpivot(one_row, names, min_length="lo", max_length="hi", avg_length="mu")
    firsts = _ranked(value_counts(df, names), [F.asc("value")], DISTINCT_VALUES).groupBy(
        "column_name").agg(F.array_sort(F.collect_list("value")).alias("distinct_values"))
    return lengths.join(firsts, "column_name", "left")


def profile_datetime(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or _of_kind(df, "datetime"))
    one_row = df.agg(*[agg(F.col(c).cast("timestamp")).alias(f"{p}{i}")
                       for i, c in enumerate(names) for p, agg in (("lo", F.min), ("hi", F.max))])
    return _unpivot(one_row, names, min_value="lo", max_value="hi")


def profile_boolean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or _of_kind(df, "boolean"))
    return value_counts(df, names).where(F.col("value").isNotNull()).select(
        "column_name", F.col("value").cast("boolean").alias("value"),
        F.col("n").alias("value_count"))


def suggest_checks(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Checks worth adding, per column, in a fixed order."""
    names = list(columns or df.columns)
    kinds = {f.name: column_kind(f) for f in df.schema.fields}
    numbers = [c for c in names if kinds[c] in ("integer", "float")]
    basic = profile_basic(df, names)
    kind_map = F.create_map(*[F.lit(x) for c in names for x in (c, kinds[c])])
    typed = basic.withColumn("data_type", kind_map[F.col("column_name")])
    if numbers:
        least = _unpivot(
            df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo{i}")
                     for i, c in enumerate(numbers)]),
            numbers, least="lo")
        typed = typed.join(F.broadcast(least), "column_name", "left")
    else:
        typed = typed.withColumn("least", F.lit(None).cast("double"))
    nulls, unique, total = F.col("null_count"), F.col("unique_count"), F.col("total_count")
    kind, share = F.col("data_type"), F.col("cardinality")
    number = kind.isin("integer", "float")
    # Names of the suggested checks.
    rules = [
        (F.col("null_percentage") > 50, "high_null_rate"),
        (nulls > 0, "null_check"),
        (nulls == 0, "not_null_check"),
        (unique == total, "unique_check"),
        ((unique != total) & (share > 0.9), "high_cardinality"),
        ((unique != total) & (share < 0.01), "low_cardinality"),
        (number, "range_check"),
        (number & (F.col("least") >= 0), "positive_check"),
        (kind == "string", "length_check"),
        ((kind == "string") & (unique <= 20), "allowed_values_check"),
        (kind == "datetime", "date_range_check"),
        (kind == "datetime", "future_date_check"),
    ]
    picked = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))
    empty = F.array(F.lit("null_check"), F.lit("completeness_check"))
    return typed.select("column_name", "data_type",
                        F.when(nulls == total, empty).otherwise(picked).alias("suggested_checks"))


def profile(df: DataFrame) -> DataFrame:
    """The whole profile; parts that do not apply to a column are NULL."""
    basic = profile_basic(df).join(suggest_checks(df), "column_name")
    text = F.col
    parts = [basic]
    if _of_kind(df, "integer", "float"):
        parts.append(profile_numeric(df).select(
            "column_name", text("min_value").cast("string").alias("number_min"),
            text("max_value").cast("string").alias("number_max"), "mean", "median", "std_dev"))
    if _of_kind(df, "string"):
        parts.append(profile_string(df))
    if _of_kind(df, "datetime"):
        parts.append(profile_datetime(df).select(
            "column_name", text("min_value").alias("time_min"), text("max_value").alias("time_max")))
    tops = top_values(df).groupBy("column_name").agg(F.array_sort(F.collect_list(
        F.struct("position", "value", "value_count"))).alias("top_values"))
    parts.append(tops)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.join(F.broadcast(part), "column_name", "left")
    return whole


def infer_types(df: DataFrame, columns: Sequence[str] | None = None,
                boolean_step: bool = True) -> DataFrame:
    """Type of text columns, judged on every value: datetime, boolean-like, integer,

    decimal (whole numbers beyond bigint), float (also NaN and infinities), else string. The profiler's variant has no boolean step.
    """
    names = list(columns or _of_kind(df, "string"))

    def every(c: str, test: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(F.col(c).isNotNull(), F.coalesce(test, F.lit(False)))),
                          F.lit(False))

    aggs = []
    for i, c in enumerate(names):
        col, number = F.col(c), F.col(c).try_cast("double")
        exact = col.try_cast("decimal(38,0)")
        digits = col.rlike(WHOLE) | ((F.abs(number) < 2.0 ** 53) & (number == F.floor(number)))
        fits = digits & exact.try_cast("bigint").isNotNull()
        kind = F.when(F.count(col) == 0, "string").when(
            every(c, col.rlike(DATE_START) & col.try_cast("timestamp").isNotNull()), "datetime")
        if boolean_step:
            kind = kind.when(every(c, col.isin(*BOOLEAN_TEXTS)), "boolean")
        # Numbers beyond bigint stay exact as decimals, beyond 38 digits as text.
        kind = (kind.when(every(c, fits), "integer").when(every(c, digits & exact.isNotNull()), "decimal")
                .when(every(c, digits), "string").when(every(c, number.isNotNull()), "float"))
        aggs.append(kind.otherwise("string").alias(f"k{i}"))
    return _unpivot(df.agg(*aggs), names, inferred_type="k")


def column_metadata(df: DataFrame, samples: int = 5) -> DataFrame:
    """NULLs, nullability, distinct count and the first sample values per column."""
    counts = value_counts(df)
    basic = profile_basic(df)
    shown = _ranked(counts, [F.asc("value")], samples).groupBy("column_name").agg(
        F.array_sort(F.collect_list("value")).alias("sample_values"))
    return basic.join(F.broadcast(shown), "column_name", "left").select(
        "column_name", "null_count", (F.col("null_count") > 0).alias("nullable"), "unique_count",
        "sample_values")
