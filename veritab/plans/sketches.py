"""Column statistics that are stored by part of a table and merged without reading it again.

Counts, NULLs, least and greatest value merge exactly. Distinct values are HyperLogLog sketches of 2**LOG_K
registers; the estimate's relative standard error is 1.04 / sqrt(2**LOG_K), 1.6 percent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_K = 12
ERROR = 1.04 / 2 ** (LOG_K / 2)
_HASHED = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)


def _hashable(df: DataFrame, name: str) -> Column:
    return F.col(name) if isinstance(df.schema[name].dataType, _HASHED) else F.col(name).cast("string")


def _typed(schema: T.StructType) -> list[T.StructField]:
    return [f for f in schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]


def column_sketches(df: DataFrame, part: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per part and column: ``part, column_name, n_rows, n_nulls, least, greatest, distinct_sketch``.

    One scan with sums and sketches added up before the shuffle; least and greatest are texts of
    the typed extremes, so they merge for one column by its type (``merged_sketches``).
    """
    names = list(columns or [f.name for f in _typed(df.schema)])
    stats = df.groupBy(part.alias("part")).agg(F.count("*").alias("n_rows"), *[a for i, c in enumerate(names) for a in (
        F.count(c).alias(f"n{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}"),
        F.hll_sketch_agg(_hashable(df, c), LOG_K).alias(f"d{i}"))])
    return stats.select("part", F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col("n_rows").alias("n_rows"), (F.col("n_rows") - F.col(f"n{i}")).alias("n_nulls"),
        F.col(f"lo{i}").alias("least"), F.col(f"hi{i}").alias("greatest"), F.col(f"d{i}").alias("distinct_sketch"))
        for i, c in enumerate(names)])))


def merged_sketches(sketches: DataFrame, schema: T.StructType) -> DataFrame:
    """Statistics per column from the rows of any parts, without the table: ``column_name, n_rows, n_nulls, least, greatest, n_distinct``."""
    typed = _typed(schema)

    def extreme(agg, column: str) -> Column:
        # Compared as values of the column's own type.
        choices = [F.when(F.first("column_name") == f.name, agg(F.when(F.col("column_name") == f.name, F.col(column)).cast(f.dataType)).cast("string"))
                   for f in typed]
        return F.coalesce(*choices)

    return sketches.where(F.col("column_name").isin([f.name for f in typed])).groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), extreme(F.min, "least").alias("least"),
        extreme(F.max, "greatest").alias("greatest"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"))
