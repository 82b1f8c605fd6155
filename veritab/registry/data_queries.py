"""Sources, sinks, evidence, previews and profiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from veritab.model import Check
from veritab.plans import evidence, preview, profile, sketches
from veritab.plans.suite import run_check, run_suite, suite_evidence, violations
from veritab.registry.base import AS_OF, Catalog, query, source, summary_sql
from veritab.sources import readers, sinks
from veritab.sources.scratch import scratch_path


def spark_of(t: Catalog):
    return t["nation"].sparkSession


def path_of(t: Catalog, name: str) -> str:
    return f"{t._at[1]}/{name}.parquet"


# --- sources ---


@query("SRC-parquet", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _parquet(t):
    return readers.read_parquet(spark_of(t), path_of(t, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice"])


_CSV_COLUMNS = ["c_custkey", "segment", "email", "credit"]


@query("SRC-csv", f"""SELECT c_custkey, nullif(trim(segment), '') AS segment, nullif(trim(email), '') AS email, credit
    FROM {source('cust')} c""")
def _csv(t):
    path = scratch_path(spark_of(t), "csv")
    t["cust"].select(*_CSV_COLUMNS).write.option("header", True).option("sep", ";").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv(spark_of(t), path)


@query("SRC-json", "SELECT event_id, event_type, user_id, value FROM events")
def _json(t):
    path = scratch_path(spark_of(t), "jsonl")
    t["events"].select("event_id", "event_type", "user_id", "value").write.json(path)
    return readers.read_json(spark_of(t), path, lines=True)


@query("SRC-json.object", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _json_object(t):
    """One document per hundred customers, whose list holds the rows."""
    path = scratch_path(spark_of(t), "json")
    row = F.struct(F.col("c_custkey").alias("c_custkey"), "c_name", "c_nationkey")
    documents = t["customer"].groupBy(F.floor(F.col("c_custkey") / 100).alias("part")).agg(
        F.collect_list(row).alias("rows"))
    # a file for each document, all in one folder: a folder for each is listed one by one
    documents.select(F.to_json(F.struct(
        F.lit("customers").alias("label"), "rows")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_json(spark_of(t), path).select(
        "c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"))


@query("SRC-object", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _object(t):
    return readers.read_files(spark_of(t), t._at[1], pattern="supplier.parquet")


@query("SRC-table", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def _table(t):
    t["part"].createOrReplaceTempView("veritab_part")
    return readers.read_table(spark_of(t), "veritab_part").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SRC-preview", "SELECT count(*) AS total_rows FROM lineitem")
def _preview_count(t):
    return readers.preview(t["lineitem"])[1]


@query("SRC-schema", """SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name,
    CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
         WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS data_type, TRUE AS nullable
    FROM (DESCRIBE SELECT * FROM orders)""")
def _schema(t):
    return readers.schema_listing(t["orders"])


_TEXTS = {
    "as_date": "CAST(CAST(o_orderdate AS DATE) AS STRING)", "as_flag": "CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE '0' END",
    "as_int": "CAST(o_orderkey + 100000 AS STRING)", "as_float": "CAST(o_totalprice AS STRING)",
    "as_text": "o_orderstatus", "as_null": "CAST(NULL AS STRING)",
}


@query("SRC-infer", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CASE WHEN count(x) = 0 THEN 'string'
        WHEN count(x) = count(try_cast(x AS TIMESTAMP)) THEN 'datetime'
        WHEN bool_and(x IN ('true', 'false', 'True', 'False', 'TRUE', 'FALSE', '1', '0')) THEN 'boolean'
        WHEN bool_and(coalesce(try_cast(x AS DOUBLE) % 1 = 0, FALSE)) THEN 'integer'
        WHEN count(x) = count(try_cast(x AS DOUBLE)) THEN 'float' ELSE 'string' END AS inferred_type
        FROM (SELECT {e} AS x FROM orders) o""" for c, e in _TEXTS.items()))
def _infer(t):
    return profile.infer_types(t["orders"].selectExpr(*[f"{e} AS {c}" for c, e in _TEXTS.items()]))


_META = ["segment", "code", "c_nationkey"]


@query("SRC-colmeta", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, count(*) > count({c}) AS nullable,
        count(DISTINCT {c}) AS unique_count,
        (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {source('cust')} d
         WHERE {c} IS NOT NULL ORDER BY v LIMIT 5) s) AS sample_values FROM {source('cust')} c""" for c in _META))
def _colmeta(t):
    return profile.column_metadata(t["cust"].select(*_META)).withColumn(
        "sample_values", F.array_join("sample_values", "|"))


_SKETCHED = ["o_orderkey", "o_custkey", "o_orderpriority", "currency"]


# Sketches of seven parts, stored and merged; the estimate has to be within five standard errors.
@query("SRC-colmeta.sketches", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, CAST(min({c}) AS VARCHAR) AS least,
        CAST(max({c}) AS VARCHAR) AS greatest, TRUE AS close FROM {source('ords')} t""" for c in _SKETCHED))
def _sketches(t):
    df = t["ords"].select(*_SKETCHED)
    path = scratch_path(spark_of(t), "sketches")
    sketches.column_sketches(df, F.col("o_orderkey") % 7).write.parquet(path)
    merged = sketches.merged_sketches(spark_of(t).read.parquet(path), df.schema)
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in _SKETCHED]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("exact")) for c in _SKETCHED])))
    close = F.abs(F.col("n_distinct") - F.col("exact")) <= 5 * sketches.ERROR * F.col("exact")
    return merged.join(exact, "column_name").withColumn("close", close).drop("n_distinct", "exact")


# --- sinks ---
_SINK_CHECKS = [Check("k1", "completeness", "null", "ords", ("status",)),
                Check("k2", "validity", "range", "ords", ("o_totalprice",), {"min_value": 5000})]
_SINK_SQL = " UNION ALL ".join(summary_sql(c, f"""SELECT count(*) AS total_rows,
    count(CASE WHEN {ok} THEN 1 END) AS passed_rows, count(CASE WHEN {bad} THEN 1 END) AS failed_rows,
    0 AS skipped_rows, count(*) AS evaluated_rows FROM {source('ords')} t""") for c, ok, bad in (
    (_SINK_CHECKS[0], "status IS NOT NULL", "status IS NULL"),
    (_SINK_CHECKS[1], "o_totalprice >= 5000", "NOT (o_totalprice >= 5000)")))


@query("SNK-results", f"""SELECT s.*, d.run_date FROM ({_SINK_SQL}) s
    CROSS JOIN (SELECT DATE '2024-01-30' AS run_date UNION ALL SELECT DATE '2024-01-31') d""")
def _results(t):
    path = scratch_path(spark_of(t), "results")
    for day in (date(2024, 1, 30), date(2024, 1, 31)):
        sinks.append_results(run_suite(t, _SINK_CHECKS, AS_OF), path, day)
    return spark_of(t).read.parquet(path)


@query("SNK-retention", _SINK_SQL)
def _retention(t):
    path = scratch_path(spark_of(t), "expiring")
    for day in (date(2023, 10, 1), date(2024, 1, 31)):
        sinks.append_results(run_suite(t, _SINK_CHECKS, AS_OF), path, day)
    sinks.drop_expired(spark_of(t), path, date(2024, 2, 1))
    return sinks.retained(spark_of(t).read.parquet(path), date(2024, 2, 1)).drop("run_date")


_BAD_ORDERS = Check("e1", "validity", "cross_field", "ords", ("booked",),
                    {"comparison_column": "o_totalprice", "comparison_operator": "<="}, severity="high")
_BAD_SQL = f"SELECT * FROM {source('ords')} o WHERE booked IS NULL OR NOT (booked <= o_totalprice)"


@query("SNK-evidence", f"""SELECT o_orderkey, '[MASKED]' AS o_custkey, o_orderstatus, TRUE AS masking_applied
    FROM ({_BAD_SQL}) b""")
def _evidence_file(t):
    path = scratch_path(spark_of(t), "evidence")
    rows = violations(t, _BAD_ORDERS, AS_OF).select("o_orderkey", "o_custkey", "o_orderstatus")
    sinks.write_evidence(rows, path, {"o_custkey": "restricted", "o_orderstatus": "internal"}, limit=None)
    return spark_of(t).read.json(path)


@query("SNK-csv", f"""SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(CASE WHEN regexp_matches(phone, '^[=+@-]')
    THEN '''' || phone ELSE phone END, '') AS phone, CASE WHEN c_acctbal < 0 THEN 'x' ELSE '' END AS debt
    FROM {source('cust')} c""")
def _csv_export(t):
    path = scratch_path(spark_of(t), "export")
    sinks.write_csv(t["cust"].select(F.col("c_custkey").alias("id"), "phone",
                                     F.expr("CASE WHEN c_acctbal < 0 THEN 'x' END").alias("debt")), path)
    return spark_of(t).read.option("header", True).option("escape", '"').option("nullValue", "\u0001").csv(path)


# --- evidence ---


@query("EVD-rows", f"SELECT o_orderkey, booked, o_totalprice FROM ({_BAD_SQL}) b")
def _rows(t):
    return violations(t, _BAD_ORDERS, AS_OF).select("o_orderkey", "booked", "o_totalprice")


@query("EVD-rows.page", f"SELECT o_orderkey, booked FROM ({_BAD_SQL}) b ORDER BY o_orderkey LIMIT 100")
def _page(t):
    return evidence.evidence_page(violations(t, _BAD_ORDERS, AS_OF), ["o_orderkey"]).select("o_orderkey", "booked")


_MANY = [Check("e1", "completeness", "null", "ords", ("status",)), Check("e2", "validity", "range", "ords", ("o_totalprice",), {"min_value": 50000}),
         Check("e3", "completeness", "null", "ords", ("booked",), filter="o_orderstatus = 'F'"),
         Check("e4", "completeness", "null", "cust", ("email",))]
_MANY_SQL = " UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS check_id, CAST({k} AS VARCHAR) AS id FROM {source(n)} t WHERE {w}
    ORDER BY md5(CAST({k} AS VARCHAR)), {k} LIMIT 40) {c}""" for c, n, k, w in (
    ("e1", "ords", "o_orderkey", "status IS NULL"), ("e2", "ords", "o_orderkey", "NOT (o_totalprice >= 50000) OR o_totalprice IS NULL"),
    ("e3", "ords", "o_orderkey", "booked IS NULL AND o_orderstatus = 'F'"), ("e4", "cust", "c_custkey", "email IS NULL")))


@query("EVD-rows.suite", _MANY_SQL)
def _suite_rows(t):
    """Up to 40 rows for each of four checks, a scan a table."""
    found = suite_evidence(t, _MANY, {"ords": ["o_orderkey"], "cust": ["c_custkey"]}, 40, AS_OF)
    return found.select("check_id", F.coalesce(F.get_json_object("record", "$.o_orderkey"), F.get_json_object("record", "$.c_custkey")).alias("id"))


_DUPLICATE_ROWS = """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (
    SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"""


@query("EVD-rows.duplicates", _DUPLICATE_ROWS)
def _duplicate_rows(t):
    check = Check("d", "uniqueness", "composite", "lineitem", ("l_orderkey", "l_linenumber"))
    return violations(t, check).select("l_orderkey", "l_linenumber", "l_partkey")


@query("EVD-rows.temporal", f"""SELECT event_id FROM (
    SELECT event_id, device, least(epoch_us(ts) - epoch_us(lag(ts) OVER w), epoch_us(lead(ts) OVER w) - epoch_us(ts)) AS gap
    FROM {source('evt')} t WINDOW w AS (PARTITION BY device, event_type ORDER BY ts)) g
    WHERE device IS NOT NULL AND gap <= 600000000""")
def _temporal_rows(t):
    check = Check("d", "uniqueness", "temporal", "evt", ("device", "event_type"),
                  {"temporal_column": "ts", "temporal_window": "600s"})
    return violations(t, check).select("event_id")


_CANON = ["check_id", "dimension", "subtype", "dataset", "column_name", "business_key", "check_status",
          "observed_value", "expected_value", "issue_reason", "severity"]


def _canon_sql(check, rows, key, observed, expected, reason, deviation="NULL"):
    column = f"'{check.columns[0]}'" if len(check.columns) == 1 else "NULL"
    return f"""SELECT '{check.check_id}' AS check_id, '{check.dimension}' AS dimension, '{check.subtype}' AS subtype,
        '{check.dataset}' AS dataset, CAST({column} AS VARCHAR) AS column_name, CAST({key} AS VARCHAR) AS business_key,
        'FAIL' AS check_status, CAST({observed} AS VARCHAR) AS observed_value, CAST({expected} AS VARCHAR) AS expected_value,
        '{reason}' AS issue_reason, '{check.severity}' AS severity, CAST({deviation} AS DOUBLE) AS deviation FROM ({rows}) r"""


_CANON_CHECKS = [
    (Check("v1", "completeness", "placeholder", "cust", ("segment",), {"placeholder_values": ["tbd"]}), "c_custkey", {},
     (f"SELECT * FROM {source('cust')} c WHERE segment IS NULL OR trim(segment) = '' OR lower(trim(segment)) = 'tbd'",
      "c_custkey", "'NULL'", "'NOT NULL'", "Column ''segment'' contains a placeholder value")),
    (Check("v2", "conformity", "standard", "cust", ("email",), {"standard_name": "email"}, severity="low"), "c_custkey", {"email": "confidential"},
     (f"SELECT * FROM {source('cust')} c WHERE NOT regexp_matches(trim(email), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$')",
      "c_custkey", "'[MASKED]'", "'conforming to format'", "Value does not conform to standard format")),
    (Check("v3", "consistency", "intra_record", "ords", ("buyer",), {"reference_column": "o_custkey", "comparison_column": "o_custkey"}),
     "o_orderkey", {},
     (f"SELECT * FROM {source('ords')} o WHERE buyer <> o_custkey", "o_orderkey", "buyer", "o_custkey",
      "Inconsistent value detected", "CAST(buyer AS DOUBLE) - o_custkey")),
    (Check("v4", "uniqueness", "exact", "cust", ("email",)), "c_custkey", {},
     (f"""SELECT * FROM {source('cust')} c WHERE email IN (SELECT email FROM {source('cust')} d
          GROUP BY email HAVING count(*) > 1)""", "c_custkey", "email", "'unique'", "Duplicate value found")),
    (Check("v5", "validity", "reference_lookup", "ords", ("buyer",), {
        "reference_dataset": "customer", "reference_column": "c_custkey"}), "o_orderkey", {},
     (f"SELECT * FROM {source('ords')} o WHERE buyer IS NULL OR buyer NOT IN (SELECT c_custkey FROM customer)",
      "o_orderkey", "buyer", "'valid per rule'", "Value does not satisfy reference_lookup validation")),
]


@query("EVD-canonical", " UNION ALL ".join(_canon_sql(c, *sql) for c, _, _, sql in _CANON_CHECKS))
def _canonical(t):
    parts = [evidence.canonical_violations(t, c, AS_OF, key, mask).select(*_CANON, "deviation")
             for c, key, mask, _ in _CANON_CHECKS]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("EVD-mask", f"""SELECT c_custkey, c_name, CAST(CASE WHEN TRUE THEN '[MASKED]' END AS VARCHAR) AS email,
    '[MASKED]' AS phone, TRUE AS masking_applied FROM {source('cust')} c""")
def _mask(t):
    return evidence.mask(t["cust"].select("c_custkey", "c_name", "email", "phone"),
                         {"email": "confidential", "phone": "restricted", "c_name": "internal"})


_JSON = """'{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"' || coalesce(',"email":"' || email || '"', '') || '}'"""


@query("EVD-rowref", f"""SELECT c_custkey, sha256({_JSON}) AS row_hash, coalesce(email, sha256({_JSON})) AS row_reference
    FROM {source('cust')} c""")
def _rowref(t):
    rows = t["cust"].select("c_custkey", "c_name", "email")
    return rows.select("c_custkey", evidence.row_reference(rows).alias("row_hash"),
                       evidence.row_reference(rows, "email").alias("row_reference"))


# --- previews ---
_PREVIEWS = [
    ("null", {"columns": ["segment"]}, "cust", "segment IS NULL"),
    ("not_null", {"columns": ["segment"]}, "cust", "segment IS NOT NULL"),
    ("range", {"columns": ["c_acctbal"], "operator": ">=", "value": 0}, "cust", "c_acctbal < 0"),
    ("allowed_values", {"columns": ["segment"], "value_list": ["BUILDING", ""]}, "cust", "segment NOT IN ('BUILDING', '')"),
    ("regex", {"columns": ["email"], "regex_pattern": "^user"}, "cust", "NOT regexp_matches(email, '^user')"),
    ("length", {"columns": ["email"], "operator": "<=", "value": 15}, "cust", "length(email) > 15"),
    ("unique", {"columns": ["email"]}, "cust",
     f"email IN (SELECT email FROM {source('cust')} d GROUP BY email HAVING count(*) > 1)"),
    ("date_comparison", {"columns": ["shipped_at"], "operator": ">=", "compare_column": "o_orderdate"}, "ords",
     "shipped_at < o_orderdate"),
    ("date_comparison", {"columns": ["o_orderdate"], "operator": "<", "value": "1998-01-01"}, "ords",
     "o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'"),
    ("column_comparison", {"columns": ["buyer"], "operator": "=", "compare_column": "o_custkey"}, "ords", "buyer <> o_custkey"),
]


@query("GEN-preview", " UNION ALL ".join(f"""
    SELECT {i} AS n, total_rows, total_rows - fail_rows AS pass_rows, fail_rows,
           100e0 * (total_rows - fail_rows) / total_rows AS pass_rate
    FROM (SELECT count(*) AS total_rows, count(CASE WHEN {bad} THEN 1 END) AS fail_rows FROM {source(table)} t) c"""
    for i, (_, _, table, bad) in enumerate(_PREVIEWS)))
def _previews(t):
    parts = [preview.preview_counts(t[table], subtype, config).select(F.lit(i).alias("n"), "*")
             for i, (subtype, config, table, _) in enumerate(_PREVIEWS)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("GEN-preview.rows", f"SELECT o_orderkey FROM {source('ords')} o WHERE shipped_at < o_orderdate")
def _preview_rows(t):
    return preview.preview_violations(t["ords"], *_PREVIEWS[7][:2]).select("o_orderkey")


# --- profiles ---
_ALL = ["c_custkey", "c_name", "c_nationkey", "segment", "email", "phone", "code", "title"]


def _basic_sql(c):
    return f"""SELECT '{c}' AS column_name, count(*) AS total_count, count(*) - count({c}) AS null_count,
        100e0 * (count(*) - count({c})) / count(*) AS null_percentage, count(DISTINCT {c}) AS unique_count,
        CAST(count(DISTINCT {c}) AS DOUBLE) / count(*) AS cardinality FROM {source('cust')} t"""


@query("PRF-basic", " UNION ALL ".join(map(_basic_sql, _ALL)))
def _basic(t):
    return profile.profile_basic(t["cust"], _ALL)


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "net", "l_linenumber"]


@query("PRF-numeric", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value,
           round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std_dev
    FROM {source('li')} t""" for c in _NUMBERS))
def _numeric(t):
    return profile.profile_numeric(t["li"], _NUMBERS).withColumns(
        {c: F.round(c, 4) for c in ("mean", "median", "std_dev")})


_STRINGS = ["segment", "email", "title", "code"]


@query("PRF-string", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, CAST(min(length({c})) AS INTEGER) AS min_length, CAST(max(length({c})) AS INTEGER) AS max_length,
           round(avg(length({c})), 4) AS avg_length,
           (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {source('cust')} d
            WHERE {c} IS NOT NULL ORDER BY v LIMIT 10) s) AS distinct_values FROM {source('cust')} t""" for c in _STRINGS))
def _string(t):
    return profile.profile_string(t["cust"], _STRINGS).withColumns({
        "avg_length": F.round("avg_length", 4), "distinct_values": F.array_join("distinct_values", "|")})


@query("PRF-datetime", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, min({c}) AS min_value, max({c}) AS max_value
    FROM {source('ords')} t""" for c in ("o_orderdate", "shipped_at")))
def _datetime(t):
    return profile.profile_datetime(t["ords"], ["o_orderdate", "shipped_at"]).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("min_value", "max_value")})


@query("PRF-boolean", f"""SELECT 'in_debt' AS column_name, credit < 0 AS value, count(*) AS value_count
    FROM {source('cust')} t WHERE credit IS NOT NULL GROUP BY 2""")
def _boolean(t):
    return profile.profile_boolean(t["cust"].selectExpr("credit < 0 AS in_debt"))


_TOP = ["segment", "email", "c_nationkey", "title"]


@query("PRF-top", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, position, value, value_count FROM (
      SELECT CAST({c} AS VARCHAR) AS value, count(*) AS value_count,
             row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS position
      FROM {source('cust')} t WHERE {c} IS NOT NULL GROUP BY 1) x WHERE position <= 5""" for c in _TOP))
def _top(t):
    return profile.top_values(t["cust"], _TOP)


_SUGGESTED = ["c_custkey", "c_nationkey", "c_acctbal", "credit", "segment", "email", "c_mktsegment", "c_name"]
_SUGGESTED_KIND = dict.fromkeys(_SUGGESTED, "string") | {
    "c_custkey": "integer", "c_nationkey": "integer", "c_acctbal": "float", "credit": "float"}


def _suggest_sql(c):
    kind = _SUGGESTED_KIND[c]
    number = kind in ("integer", "float")
    return f"""SELECT '{c}' AS column_name, '{kind}' AS data_type, concat_ws(',',
        CASE WHEN m > n * 0.5 THEN 'high_null_rate' END, CASE WHEN m > 0 THEN 'null_check' ELSE 'not_null_check' END,
        CASE WHEN u = n THEN 'unique_check' WHEN CAST(u AS DOUBLE) / n > 0.9 THEN 'high_cardinality'
             WHEN CAST(u AS DOUBLE) / n < 0.01 THEN 'low_cardinality' END,
        {"'range_check', CASE WHEN least >= 0 THEN 'positive_check' END" if number else
         "'length_check', CASE WHEN u <= 20 THEN 'allowed_values_check' END"}) AS suggested_checks
        FROM (SELECT count(*) AS n, count(*) - count({c}) AS m, count(DISTINCT {c}) AS u,
                     {f'min({c})' if number else '0'} AS least FROM {source('cust')} t) s"""


@query("PRF-suggest", " UNION ALL ".join(map(_suggest_sql, _SUGGESTED)))
def _suggest(t):
    return profile.suggest_checks(t["cust"].select(*_SUGGESTED)).withColumn(
        "suggested_checks", F.array_join("suggested_checks", ","))


@query("PRF-full")
def _full(t):
    return profile.profile(t["documents"].select("doc_id", "lang", "source", "n_chars"))
