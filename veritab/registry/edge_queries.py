"""Variants at the edges: wide numbers, mixed documents, unknown verdicts, hidden columns, undated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.model import Check
from veritab.plans import evidence, profile
from veritab.plans.suite import run_check
from veritab.registry.base import AS_OF, check_query, query, row_query, source, summary_sql
from veritab.registry.data_queries import spark_of
from veritab.sources import readers
from veritab.sources.scratch import scratch_path
from veritab.streaming import checks as streaming

# --- sources ---
_WIDE = {
    "id": "CAST(o_orderkey AS {s})",
    "past_double": "CAST(9007199254740993 + o_orderkey AS {s})",
    "past_bigint": "CASE WHEN o_orderkey % 7 = 0 THEN '12345678901234567890' ELSE CAST(o_orderkey AS {s}) END",
    "ratio": "CASE WHEN o_orderkey % 5 = 0 THEN 'NaN' ELSE '1.5' END",
}


def _wide(t):
    return t["orders"].selectExpr(*[f"{e.format(s='STRING')} AS {c}" for c, e in _WIDE.items()])


@query("SRC-csv.wide", """SELECT o_orderkey AS id, 9007199254740993 + o_orderkey AS past_double,
    CASE WHEN o_orderkey % 7 = 0 THEN '12345678901234567890' ELSE CAST(o_orderkey AS VARCHAR) END AS past_bigint,
    CASE WHEN o_orderkey % 5 = 0 THEN 'NaN' ELSE '1.5' END AS ratio FROM orders""")
def _csv_wide(t):
    path = scratch_path(spark_of(t), "csv")
    _wide(t).write.option("header", True).csv(path)
    read = readers.read_csv(spark_of(t), path)
    return read.withColumns({c: F.col(c).cast("string") for c in ("past_bigint", "ratio")})


@query("SRC-infer.edge", """SELECT * FROM (VALUES ('id', 'integer'), ('past_double', 'integer'), ('past_bigint', 'decimal'),
    ('ratio', 'float')) v(column_name, inferred_type)""")
def _infer_edge(t):
    return profile.infer_types(_wide(t))


@query("SRC-json.mixed", """SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS even, CASE WHEN c_custkey % 2 = 1 THEN c_custkey END AS odd,
    CASE WHEN c_custkey % 2 = 1 THEN c_name END AS c_name FROM customer""")
def _json_mixed(t):
    """Two kinds of documents, whose lists have other names and other fields."""
    path = scratch_path(spark_of(t), "json")
    part = F.floor(F.col("c_custkey") / 100)
    even = t["customer"].where("c_custkey % 2 = 0").groupBy(part.alias("part")).agg(
        F.to_json(F.struct(F.collect_list(F.struct(F.col("c_custkey").alias("even"))).alias("rows"))).alias("value"))
    odd = t["customer"].where("c_custkey % 2 = 1").groupBy((part + 1_000_000).alias("part")).agg(
        F.to_json(F.struct(F.collect_list(F.struct(F.col("c_custkey").alias("odd"), "c_name")).alias("items"))).alias("value"))
    even.unionByName(odd).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_json(spark_of(t), path).select("even", "odd", "c_name")


@query("SRC-preview.rows", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100")
def _preview_rows(t):
    return readers.preview(t["lineitem"], order=["l_orderkey", "l_linenumber"])[0].select("l_orderkey", "l_linenumber", "l_quantity")


# --- null and type semantics ---
row_query("CMP-conditional.boolean", "completeness", "conditional", "flagged", ["email"],
          {"condition_column": "rich", "condition_value": [True]}, "email IS NOT NULL", "email IS NULL", where="rich")
row_query("CMP-conditional.number", "completeness", "conditional", "flagged", ["email"],
          {"condition_column": "ratio", "condition_value": [1, "2"]}, "email IS NOT NULL", "email IS NULL", where="ratio IN (1, 2)")
for _size in (1000, 1001):
    _list = [None, *range(0, 3 * (_size - 1), 3)]
    row_query(f"VAL-allowed.null_in_list_{_size}", "validity", "allowed_values", "ords", ["buyer"], {"allowed_values": _list},
              f"buyer % 3 = 0 AND buyer >= 0 AND buyer < {3 * (_size - 1)}", "buyer IS NULL")
_UNKNOWN = [Check("a", "generic", "condition", "cust", (), {"expression": "credit < 3000"}),
            Check("b", "generic", "condition", "cust", (), {"expression": "c_nationkey < 20"})]
for _logic, _ok in (("AND", "credit < 3000 AND c_nationkey < 20"), ("OR", "credit < 3000 OR c_nationkey < 20")):
    _name = "GEN-compound.unknown" if _logic == "AND" else "GEN-compound.unknown_or"
    check_query(_name, Check(_name, "generic", "compound", "cust", (), {"logic": _logic, "members": _UNKNOWN}), f"""
        SELECT count(*) AS total_rows, count(CASE WHEN {_ok} THEN 1 END) AS passed_rows,
               count(CASE WHEN NOT ({_ok}) THEN 1 END) AS failed_rows, 0 AS skipped_rows, count(*) AS evaluated_rows
        FROM {source('cust')} t""")

# --- samples by content ---
_SAMPLED = Check("sample", "completeness", "null", "li", ("flag",))


@query("EVD-sample", summary_sql(_SAMPLED, f"""
    SELECT count(*) AS total_rows, count(flag) AS passed_rows, count(*) - count(flag) AS failed_rows, 0 AS skipped_rows,
           count(*) AS evaluated_rows FROM {source('li')} t
    WHERE CAST('0x' || substr(md5('7|' || l_orderkey || '|' || l_linenumber), 1, 8) AS BIGINT) < {int(0.1 * 2**32)}"""))
def _sample(t):
    return run_check({"li": evidence.run_on_sample(t["li"], 0.1, ["l_orderkey", "l_linenumber"], seed=7)}, _SAMPLED)


# --- hidden columns ---
_SHOWN = ["check_id", "business_key", "observed_value", "expected_value", "issue_reason", "masking_applied"]
_HIDDEN = [
    (Check("h1", "accuracy", "reference_comparison", "orders", ("o_totalprice",), {
        "reference_dataset": "ords", "reference_column": "booked", "join_keys": ["o_orderkey"]}),
     "Value deviates from reference", f"""SELECT a.o_orderkey FROM orders a JOIN {source('ords')} b ON a.o_orderkey = b.o_orderkey
        WHERE a.o_totalprice <> b.booked""", "'[MASKED]'"),
    (Check("h2", "timeliness", "record_age", "ords", ("o_orderdate",), {"max_age": "9000d"}),
     "Record exceeds maximum allowed age", f"SELECT o_orderkey FROM {source('ords')} a WHERE o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL '9000' DAY",
     "'9000d'"),
]
_CLASSES = {"o_totalprice": "confidential", "o_orderdate": "restricted", "o_orderkey": "restricted"}


@query("EVD-canonical.hidden", " UNION ALL ".join(f"""
    SELECT '{c.check_id}' AS check_id, sha256('{c.dataset}|' || o_orderkey) AS business_key, '[MASKED]' AS observed_value,
           {expected} AS expected_value, '{reason}' AS issue_reason, TRUE AS masking_applied FROM ({rows}) r"""
                                                  for c, reason, rows, expected in _HIDDEN))
def _canonical_hidden(t):
    parts = [evidence.canonical_violations(t, c, AS_OF, "o_orderkey", _CLASSES).select(*_SHOWN) for c, *_ in _HIDDEN]
    return parts[0].unionByName(parts[1])


# --- numbers that are none, rows without a date ---
_NAN = "CASE WHEN o_orderkey % 10 < 6 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 10 = 6 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END"


@query("PRF-numeric.nan", f"""SELECT 'x' AS column_name, CAST(median(x) AS VARCHAR) = 'nan' AS median_is_nan, isnan(max(x)) AS max_is_nan,
    round(min(x), 4) AS min_value FROM (SELECT {_NAN} AS x FROM orders) o""")
def _numeric_nan(t):
    return profile.profile_numeric(t["orders"].selectExpr(f"{_NAN} AS x")).select(
        "column_name", F.isnan("median").alias("median_is_nan"), F.isnan("max_value").alias("max_is_nan"), F.round("min_value", 4).alias("min_value"))


@query("PRF-basic.zeros", """SELECT 'x' AS column_name, count(*) AS total_count, count(DISTINCT x) AS unique_count
    FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN CAST('-0.0' AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x FROM orders) o""")
def _zeros(t):
    zeros = t["orders"].selectExpr("CASE WHEN o_orderkey % 2 = 0 THEN CAST('-0.0' AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x")
    return profile.profile_basic(zeros).select("column_name", "total_count", "unique_count")


@query("STR-windowed.undated", """SELECT CASE WHEN event_id % 4 > 0 THEN epoch_us(date_trunc('day', ts)) END AS start_us, count(*) AS total_rows,
    count(CASE WHEN value > 100 THEN 1 END) AS failed_rows FROM events GROUP BY 1""")
def _undated(t):
    undated = t["events"].withColumn("ts", F.when(F.col("event_id") % 4 > 0, F.col("ts")))
    check = Check("big", "validity", "range", "events", ("value",), {"max_value": 100})
    return streaming.windowed_counts(undated, check, "ts", "1 day").select(
        F.unix_micros("window_start").alias("start_us"), "total_rows", "failed_rows")


# --- pairs on patterns of NULLs and on tolerances ---
_MANY = [f"c{i}" for i in range(12)]


def _holes(side: int) -> str:
    return ", ".join(f"CASE WHEN (o_orderkey * {7 + 2 * i} + {side}) % 4 > 0 THEN o_custkey + {i} END AS c{i}" for i in range(12))


_MANY_EQUAL = " AND ".join(f"a.{c} = b.{c}" for c in _MANY)
_MANY_DIFFER = " OR ".join(f"a.{c} <> b.{c}" for c in _MANY)


@query("REC-field.many_nulls", f"""SELECT count(*) AS total_rows, count(CASE WHEN {_MANY_EQUAL} THEN 1 END) AS passed_rows,
    count(CASE WHEN {_MANY_DIFFER} THEN 1 END) AS failed_rows
    FROM (SELECT o_orderkey, {_holes(0)} FROM orders) a JOIN
         (SELECT o_orderkey, {_holes(1).replace("o_custkey + 3", "o_custkey + 4")} FROM orders) b USING (o_orderkey)""")
def _many_nulls(t):
    tables = {"s": t["orders"].selectExpr("o_orderkey", *[x + f" AS c{i}" for i, x in enumerate(
                  p.rsplit(" AS ", 1)[0] for p in _holes(0).split(", "))]),
              "t": t["orders"].selectExpr("o_orderkey", *[x + f" AS c{i}" for i, x in enumerate(
                  p.rsplit(" AS ", 1)[0] for p in _holes(1).replace("o_custkey + 3", "o_custkey + 4").split(", "))])}
    check = Check("many", "reconciliation", "field_level", "s", (), {
        "source_dataset": "s", "target_dataset": "t", "join_keys": ["o_orderkey"], "compare_columns": _MANY})
    return run_check(tables, check).select("total_rows", "passed_rows", "failed_rows")


for _name, _tolerance, _scale in (("zero", 0, 1), ("tiny", 1e-9, 1_000_000)):
    def _close(t, value=_tolerance, scale=_scale):
        tables = {"s": t["orders"].selectExpr("o_custkey", f"CAST(o_totalprice * {scale} AS DOUBLE) AS v"),
                  "t": t["orders"].selectExpr("o_custkey", f"CAST((CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END) * {scale} AS DOUBLE) AS v")}
        check = Check("close", "reconciliation", "tolerance", "s", ("v",), {
            "source_dataset": "s", "target_dataset": "t", "join_keys": ["o_custkey"], "tolerance_type": "absolute", "tolerance_value": value})
        return run_check(tables, check).select("total_rows", "passed_rows", "failed_rows")

    query(f"REC-tolerance.{_name}", f"""SELECT count(*) AS total_rows, count(CASE WHEN abs(a.v - b.v) <= {_tolerance} THEN 1 END) AS passed_rows,
        count(CASE WHEN abs(a.v - b.v) > {_tolerance} THEN 1 END) AS failed_rows
        FROM (SELECT o_custkey, CAST(o_totalprice * {_scale} AS DOUBLE) AS v FROM orders) a JOIN
             (SELECT o_custkey, CAST((CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END) * {_scale} AS DOUBLE) AS v FROM orders) b USING (o_custkey)""")(_close)


_REPEATED = Check("ACC-deviation.repeated", "accuracy", "tolerated_deviation", "orders", ("o_totalprice",), {
    "reference_dataset": "ords", "reference_column": "booked", "join_keys": ["o_custkey"], "tolerance_type": "absolute", "tolerance_value": 5000})
check_query(_REPEATED.check_id, _REPEATED, f"""
    SELECT count(*) AS total_rows, count(CASE WHEN abs(a.o_totalprice - b.booked) <= 5000 THEN 1 END) AS passed_rows,
           count(CASE WHEN abs(a.o_totalprice - b.booked) > 5000 THEN 1 END) AS failed_rows, 0 AS skipped_rows,
           count(b.booked) AS evaluated_rows, count(b.booked) AS verified_rows, count(*) - count(b.booked) AS unverifiable_rows
    FROM orders a LEFT JOIN {source('ords')} b ON a.o_custkey = b.o_custkey""", ("verified_rows", "unverifiable_rows"))
