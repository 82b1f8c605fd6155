"""Datasets from files, tables and databases."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.plans.profile import infer_types

# Delimiters a CSV file may use.
DELIMITERS = (",", ";", "\t", "|")
FORMATS = {"parquet": "parquet", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json",
           "ndjson": "json", "orc": "orc"}
_KEEP_EMPTY = "\u0001"
_CAST = {"datetime": "timestamp", "decimal": "decimal(38,0)", "float": "double", "boolean": "boolean"}


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                 limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df if limit is None else df.limit(limit)


def sniff_delimiter(lines: Sequence[str]) -> str:
    """The candidate that splits the most lines evenly into the most fields."""
    def score(delimiter: str) -> tuple[int, int]:
        fields = [line.count(delimiter) for line in lines if line.strip()]
        usual = max(set(fields), key=fields.count) if fields else 0
        return (fields.count(usual) if usual else 0, usual)

    best = max(DELIMITERS, key=score)
    return best if score(best)[1] else ","


def normalise_text(df: DataFrame) -> DataFrame:
    """Strip text and turn empty text into NULL, so that completeness sees it."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    stripped = {c: F.regexp_replace(F.col(c), r"^\s+|\s+$", "") for c in texts}
    return df.withColumns({c: F.when(v != "", v) for c, v in stripped.items()})


def apply_types(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Cast text columns to the types found for them."""
    casts = {}
    for name, kind in kinds.items():
        if kind == "boolean":
            casts[name] = F.col(name).isin("true", "True", "TRUE", "1")
            casts[name] = F.when(F.col(name).isNotNull(), casts[name])
        elif kind == "integer":
            casts[name] = F.col(name).try_cast("decimal(38,0)").try_cast("bigint")
        elif kind in _CAST:
            casts[name] = F.col(name).try_cast(_CAST[kind])
    return df.withColumns(casts) if casts else df


def _csv_lines(spark: SparkSession, path: str, delimiter: str | None, encoding: str,
               multi_line: bool) -> DataFrame:
    """Fields as text; only a line with too many fields fills ``__too_long``."""
    if delimiter is None:
        head = spark.read.option("encoding", encoding).text(path).limit(20).collect()
        delimiter = sniff_delimiter([r[0] for r in head])
    reader = (spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding)
              .option("multiLine", multi_line).option("escape", '"')
              .option("nullValue", _KEEP_EMPTY).option("columnPruning", False))
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "__too_long"]])
    return reader.option("enforceSchema", True).schema(schema).csv(path)


def csv_lines_skipped(spark: SparkSession, path: str, delimiter: str | None = None,
                      encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """How many lines ``read_csv`` reads and how many it skips for too many fields."""
    too_long = F.col("__too_long").isNotNull()
    return _csv_lines(spark, path, delimiter, encoding, multi_line).agg(
        F.count(F.when(~too_long, 1)).alias("read_lines"), F.count(F.when(too_long, 1)).alias("skipped_lines"))


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None,
             encoding: str = "UTF-8", infer: bool = True, multi_line: bool = False) -> DataFrame:
    """CSV or TSV with a header.

    Lines with too many fields are skipped (``csv_lines_skipped`` counts them), short
    ones padded with NULL. Whole numbers become bigint, or decimal(38,0) where one
    does not fit; columns with NaN or infinities are double.
    """
    raw = _csv_lines(spark, path, delimiter, encoding, multi_line)
    df = normalise_text(raw.where(F.col("__too_long").isNull()).drop("__too_long"))
    if not infer:
        return df
    kinds = {r.column_name: r.inferred_type for r in infer_types(df).collect()}
    return apply_types(df, kinds)


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """A JSON array, JSON lines, or an object whose first list holds the rows.

    Each file is a document of its own: its first list of objects gives its rows,
    whatever other files hold; an object without such a list is one row. Rows of
    differently shaped documents have all columns, NULL where a document has none.
    """
    if lines is None:
        lines = bool(re.search(r"\.(jsonl|ndjson)$", path))
    if lines:
        return spark.read.json(path)
    reader = spark.read.option("multiLine", True)
    # Spark opens many small files one by one in the driver to infer from them; texts are read by tasks.
    texts = getattr(spark.read.text(path, wholetext=True)._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    inferred = DataFrame(spark.read._jreader.json(texts), spark).schema
    readable = inferred.names and "_corrupt_record" not in inferred.names  # UTF-16 and broken files are Spark's to tell
    df = (reader.schema(inferred) if readable else reader).json(path)
    lists = [f.name for f in df.schema.fields
             if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if not lists:
        return df
    keys = F.json_object_keys("value")
    filled = F.filter(keys, lambda k: k.isin(lists) & F.col("value").isNotNull())
    documents = spark.read.text(path, wholetext=True).select(
        "value", keys.isNull().alias("array"), F.get(filled, F.lit(0)).alias("first"))
    kinds = documents.select("array", "first").distinct().collect()  # at most one row per list name
    parts = []
    for array, first in sorted(((r.array, r.first) for r in kinds), key=str):
        own = documents.where((F.col("array") == array) & F.col("first").eqNullSafe(F.lit(first)))
        if array:
            parts.append(own.select(F.inline(F.from_json("value", T.ArrayType(df.schema)))))
        else:
            row = own.select(F.from_json("value", df.schema).alias("d"))
            parts.append(row.select("d.*") if first is None else row.select(F.inline(F.col("d")[first])))
    if len(parts) == 1 and (kinds[0].array or kinds[0].first is None):
        return df
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def read_jdbc(spark: SparkSession, url: str, table: str, properties: Mapping[str, str] | None = None,
              partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, num_partitions: int = 4,
              predicates: Sequence[str] | None = None, single_task: bool = False) -> DataFrame:
    """A table or ``(subquery) alias``, read by several tasks.

    They share the rows by ranges of a partition column, whose ends are asked of the
    database unless given, or by ``predicates``, one for each task. A read in one task
    has to be asked for.
    """
    options = dict(properties or {})
    if predicates:
        return spark.read.jdbc(url, table, predicates=list(predicates), properties=options)
    if partition_column is None:
        if not single_task:
            raise ValueError("name a partition column or predicates, or set single_task")
        return spark.read.jdbc(url, table, properties=options)
    if (lower is None) != (upper is None):
        raise ValueError("give both lower and upper bounds, or neither")
    if lower is None:
        ends = f"(SELECT min({partition_column}) AS lo, max({partition_column}) AS hi FROM {table}) ends"
        found = spark.read.jdbc(url, ends, properties=options).first()
        lower, upper = (0, 0) if found is None or found[0] is None else (int(found[0]), int(found[1]) + 1)
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=num_partitions, properties=options)


# URL shape and driver class per database.
JDBC = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver"),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}",
                  "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
}


def jdbc_target(kind: str, host: str, port: int, database: str) -> tuple[str, dict[str, str]]:
    """URL and driver property of a supported database."""
    if kind not in JDBC:
        raise ValueError(f"unsupported database {kind!r}; one of {', '.join(JDBC)}")
    url, driver = JDBC[kind]
    return url.format(host=host, port=port, database=database), {"driver": driver}


def read_files(spark: SparkSession, location: str, fmt: str | None = None,
               pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """Files under a prefix (``s3a://``, ``abfss://``, ``gs://`` or a path) in one format."""
    if fmt is None:
        suffix = (pattern or location).rsplit(".", 1)[-1].lower()
        if suffix not in FORMATS:
            raise ValueError(f"cannot tell the format of {pattern or location!r}")
        fmt = FORMATS[suffix]
    reader = spark.read.format(fmt).option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(location)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Any catalog table: Hive, Iceberg, warehouse connectors."""
    return spark.table(name)


def preview(df: DataFrame, rows: int = 100, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The first rows (in an order, if given), and the total count as a one-row frame."""
    return (df.orderBy(*order) if order else df).limit(rows), df.agg(F.count("*").alias("total_rows"))


def schema_listing(df: DataFrame) -> DataFrame:
    fields = [(i, f.name, f.dataType.simpleString(), f.nullable)
              for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        fields, "position int, column_name string, data_type string, nullable boolean")
