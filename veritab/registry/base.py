"""Registered queries: a Spark callable per name, and the same question in plain SQL.

The given tables are clean, so checks run on *derived* tables: select lists over a
given table that add NULLs, blanks, broken codes and late timestamps by rule. The
lists use the dialect Spark and DuckDB share and serve both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritab.model import Check
from veritab.plans.suite import run_check

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-31 00:00:00"

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# name -> (given table, select list)
DERIVED: dict[str, tuple[str, list[str]]] = {
    "cust": ("customer", [
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
        """CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN ''
           WHEN c_custkey % 17 = 0 THEN '   ' WHEN c_custkey % 19 = 0 THEN ' N/A'
           WHEN c_custkey % 23 = 0 THEN 'tbd' ELSE c_mktsegment END AS segment""",
        """CASE WHEN c_custkey % 9 = 0 THEN NULL
           WHEN c_custkey % 8 = 0 THEN 'user' || CAST(c_custkey AS STRING)
           WHEN c_custkey % 7 = 0 THEN ' Test' || CAST(c_custkey AS STRING) || '@mail.com '
           ELSE 'user' || CAST(c_custkey % 400 AS STRING) || '@mail' || CAST(c_nationkey AS STRING) || '.com'
           END AS email""",
        """CASE WHEN c_custkey % 10 = 0 THEN 'n/a' WHEN c_custkey % 21 = 0 THEN NULL
           ELSE '+1' || lpad(CAST(c_custkey AS STRING), 9, '5') END AS phone""",
        """CASE WHEN c_custkey % 12 = 0 THEN 'ab-' || CAST(c_custkey AS STRING)
           WHEN c_custkey % 31 = 0 THEN NULL
           ELSE chr(CAST(65 + c_custkey % 26 AS INT)) || chr(CAST(65 + c_nationkey AS INT)) || '-'
                || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') END AS code""",
        "CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE c_acctbal END AS credit",
        """CASE c_custkey % 5 WHEN 0 THEN 'mary-ann o''neil' WHEN 1 THEN 'Mary-Ann O''Neil'
           WHEN 2 THEN 'MARY Ann' WHEN 3 THEN 'Mary Ann 3rd' ELSE NULL END AS title""",
        """CASE WHEN c_custkey % 6 = 0 THEN '<c id="' || CAST(c_custkey AS STRING) || '"><n>' || c_name || '</c>'
           WHEN c_custkey % 25 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 'plain text'
           ELSE '<c id="' || CAST(c_custkey AS STRING) || '"><n>' || c_name || '</n></c>' END AS xml""",
        """CASE WHEN c_custkey % 14 = 0 THEN '{"k": ' || CAST(c_custkey AS STRING)
           WHEN c_custkey % 15 = 0 THEN NULL WHEN c_custkey % 16 = 0 THEN '[1, 2, ' || CAST(c_custkey AS STRING) || ']'
           ELSE '{"k": ' || CAST(c_custkey AS STRING) || ', "s": "' || c_mktsegment || '"}' END AS json""",
    ]),
    "flagged": ("cust", [
        "c_custkey", "email", "credit > 5000 AS rich", "CAST(c_nationkey AS DOUBLE) AS ratio",
    ]),
    "ords": ("orders", [
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        "nullif(o_orderstatus, 'P') AS status",
        """CASE WHEN o_orderkey % 10 = 0 THEN NULL
           ELSE o_orderdate + INTERVAL '1' DAY * CAST((o_orderkey % 9) - 1 AS INT) END AS shipped_at""",
        """CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 50 = 0 THEN 0.0
           ELSE o_totalprice * (1 + ((o_orderkey % 7) - 3) / 100e0) END AS booked""",
        """CASE WHEN o_orderkey % 40 = 0 THEN NULL WHEN o_orderkey % 33 = 0 THEN -o_custkey
           ELSE o_custkey END AS buyer""",
        """CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 100 = 0 THEN 'EUR'
           ELSE 'C' || CAST(o_custkey % 4 AS STRING) END AS currency""",
    ]),
    "li": ("lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        "nullif(l_returnflag, 'N') AS flag",
        """CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN l_extendedprice
           ELSE l_extendedprice * (1 - l_discount) END AS net""",
    ]),
    "evt": ("events", [
        "event_id", "ts", "user_id", "event_type", "value", "props",
        """CASE WHEN event_id % 37 = 0 THEN NULL
           ELSE ts + INTERVAL '1' SECOND * CAST(event_id % 5400 AS INT) END AS loaded_at""",
        "CASE WHEN event_id % 29 = 0 THEN NULL ELSE value END AS reading",
        "CASE WHEN event_id % 23 = 0 THEN NULL ELSE user_id END AS device",
    ]),
}


def derive(name: str, given: str, select: list[str]) -> None:
    DERIVED[name] = (given, select)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    given, select = DERIVED[name]
    return table(spark, sf_dir, given).selectExpr(*select)


def source(name: str) -> str:
    """The derived table as an SQL subquery."""
    if name not in DERIVED:
        return name
    given, select = DERIVED[name]
    return f"(SELECT {', '.join(select)} FROM {source(given)} AS given_{given})"


class Catalog(dict):
    """Tables by name, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._at = (spark, sf_dir)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = table(*self._at, name)
        return self[name]


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Catalog(spark, sf_dir)


def register(name: str, run: Callable[[Catalog], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: run(catalog(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = sql


def query(name: str, sql: str | None = None):
    def wrap(run: Callable[[Catalog], DataFrame]):
        register(name, run, sql)
        return run
    return wrap


def summary_sql(check: Check, counts: str, extras: tuple[str, ...] = (),
                status: str | None = None) -> str:
    """Wrap SQL yielding total/passed/failed/skipped/evaluated into a summary row."""
    warn = "" if check.threshold_warn is None else (
        f"WHEN pass_rate >= {check.threshold_warn} THEN 'WARN' ")
    broken = "" if check.max_violations is None else (
        f"WHEN failed_rows > {check.max_violations} THEN 'FAIL' ")
    verdict = status or (f"CASE {broken}WHEN pass_rate >= {check.threshold_pass} THEN 'PASS' "
                         f"{warn}ELSE 'FAIL' END")
    more = "".join(f", {e}" for e in extras)
    return f"""
    SELECT '{check.check_id}' AS check_id, '{check.dimension}' AS dimension,
           '{check.subtype}' AS subtype, '{check.dataset}' AS dataset,
           CAST(total_rows AS BIGINT) AS total_rows, CAST(passed_rows AS BIGINT) AS passed_rows,
           CAST(failed_rows AS BIGINT) AS failed_rows, CAST(skipped_rows AS BIGINT) AS skipped_rows,
           CAST(total_rows - passed_rows - failed_rows - skipped_rows AS BIGINT) AS undetermined_rows,
           pass_rate, {verdict} AS check_status{more}
    FROM (SELECT *, CASE WHEN evaluated_rows = 0 THEN 100e0
                         ELSE 100e0 * passed_rows / evaluated_rows END AS pass_rate
          FROM ({counts}) counts) rated"""


def check_query(name: str, check: Check, counts: str | None, extras: tuple[str, ...] = (),
                status: str | None = None) -> None:
    """Register a check with SQL for its counts."""
    register(name, lambda t: run_check(t, check, AS_OF),
             None if counts is None else summary_sql(check, counts, extras, status))


def row_query(name: str, dimension: str, subtype: str, dataset: str, columns: list[str],
              params: dict, passed: str, failed: str, where: str | None = None,
              skipped: str = "FALSE", **options) -> Check:
    """Register a row-level check; ``passed``/``failed`` are its SQL conditions."""
    check = Check(name, dimension, subtype, dataset, tuple(columns), params, **options)
    conditions = [f"({c})" for c in (where, check.filter) if c]
    clause = "WHERE " + " AND ".join(conditions) if conditions else ""
    check_query(name, check, f"""
        SELECT total_rows, passed_rows, failed_rows, skipped_rows,
               total_rows - skipped_rows AS evaluated_rows
        FROM (SELECT count(*) AS total_rows,
                     count(CASE WHEN {passed} THEN 1 END) AS passed_rows,
                     count(CASE WHEN {failed} THEN 1 END) AS failed_rows,
                     count(CASE WHEN {skipped} THEN 1 END) AS skipped_rows
              FROM {source(dataset)} t {clause}) c""")
    return check
