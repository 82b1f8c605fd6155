"""Where results go: partitioned result tables, evidence files, CSV exports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.plans.evidence import mask

RETENTION_DAYS = 90
# Width of a title in the stores that cut it.
TITLE_WIDTH = 500


def append_results(summaries: DataFrame, path: str, run_date: date) -> None:
    """Append summary (or violation) rows under their run date."""
    summaries.withColumn("run_date", F.lit(run_date)).write.mode("append").partitionBy(
        "run_date").parquet(path)


def write_evidence(rows: DataFrame, path: str, sensitivity: dict[str, str] | None = None,
                   limit: int | None = None, order: Sequence[str] = ()) -> None:
    """Masked failing rows as JSON documents: all, or the first ``limit`` in ``order``."""
    if limit is not None and not order:
        raise ValueError("a limit needs an order")
    chosen = rows if limit is None else rows.orderBy(*order).limit(limit)
    mask(chosen, sensitivity or {}).write.mode("overwrite").json(path)


def fixed_width(col: Column, width: int = TITLE_WIDTH) -> Column:
    """Text for a column of fixed width; longer text ends in dots."""
    return F.when(F.char_length(col) > width, F.concat(F.substring(col, 1, width - 3), F.lit("..."))).otherwise(col)


def spreadsheet_safe(col: Column) -> Column:
    """Defuse text a spreadsheet would run as a formula."""
    return F.when(col.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), col)).otherwise(col)


def export_frame(df: DataFrame) -> DataFrame:
    """Values as they appear in an export: text made safe, NULL empty, ISO times."""
    out = []
    for f in df.schema.fields:
        col = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            text = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        else:
            text = spreadsheet_safe(col.cast("string"))
        out.append(F.coalesce(text, F.lit("")).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    export_frame(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def retained(df: DataFrame, as_of: date, days: int = RETENTION_DAYS,
             column: str = "run_date") -> DataFrame:
    """Rows young enough to keep; on a date partition this prunes whole folders."""
    return df.where(F.col(column) >= F.lit(as_of - timedelta(days=days)))


def drop_expired(spark: SparkSession, path: str, as_of: date, days: int = RETENTION_DAYS,
                 column: str = "run_date") -> list[str]:
    """Delete the date partitions that are too old, without touching any other file."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    cutoff = as_of - timedelta(days=days)
    expired = []
    for entry in files.listStatus(root):
        name = entry.getPath().getName()
        if entry.isDirectory() and name.startswith(f"{column}="):
            day = name.split("=", 1)[1]
            if date.fromisoformat(day) < cutoff:
                files.delete(entry.getPath(), True)
                expired.append(day)
    return sorted(expired)
