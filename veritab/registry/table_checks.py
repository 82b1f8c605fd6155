"""Checks that join, group or use column statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.functions import patterns as P
from veritab.functions import predicates as X
from veritab.model import Check
from veritab.operators.reconciliation import grouped_aggregates, unmatched
from veritab.operators.tablelevel import column_statistics, group_completeness
from veritab.plans.preview import violating
from veritab.plans.suite import run_suite, violations
from veritab.registry.base import AS_OF, check_query, query, register, source, summary_sql

_NOW = f"TIMESTAMP '{AS_OF}'"


def _plain(total: str, passed: str, failed: str, frm: str, extras: str = "") -> str:
    return f"""SELECT total_rows, passed_rows, failed_rows, 0 AS skipped_rows,
                      total_rows AS evaluated_rows{extras}
               FROM (SELECT {total} AS total_rows, {passed} AS passed_rows,
                            {failed} AS failed_rows{extras} FROM {frm}) c"""


def _count(cond: str) -> str:
    return f"count(CASE WHEN {cond} THEN 1 END)"


# --- completeness by group ---
_group = Check("CMP-group", "completeness", "group", "cust", ("segment",),
               {"group_by_columns": ["c_nationkey"]}, threshold_pass=95, threshold_warn=88)
check_query("CMP-group", _group, f"""
    SELECT sum(n) AS total_rows, sum(k) AS passed_rows, sum(n) - sum(k) AS failed_rows,
           0 AS skipped_rows, sum(n) AS evaluated_rows, count(*) AS group_count,
           max(CASE WHEN 100e0 * k / n >= 95 THEN 0 WHEN 100e0 * k / n >= 88 THEN 1 ELSE 2 END) AS worst
    FROM (SELECT c_nationkey, count(*) AS n, count(segment) AS k FROM {source('cust')} t
          GROUP BY c_nationkey) g""", ("group_count",),
    "CASE worst WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'FAIL' END")
register("CMP-group.groups", lambda t: group_completeness(_group, t["cust"]).orderBy("pass_rate"), f"""
    SELECT c_nationkey, n AS total_rows, k AS passed_rows, n - k AS failed_rows,
           100e0 * k / n AS pass_rate,
           CASE WHEN 100e0 * k / n >= 95 THEN 'PASS' WHEN 100e0 * k / n >= 88 THEN 'WARN'
                ELSE 'FAIL' END AS check_status
    FROM (SELECT c_nationkey, count(*) AS n, count(segment) AS k FROM {source('cust')} t
          GROUP BY c_nationkey) g""")

# --- validity with a second table ---
for _mode in ("fail", "skip", "pass"):
    _known = "buyer IN (SELECT c_custkey FROM customer)"
    _ok, _bad, _skip = {
        "fail": (_known, f"buyer IS NULL OR NOT ({_known})", "FALSE"),
        "skip": (_known, f"buyer IS NOT NULL AND NOT ({_known})", "buyer IS NULL"),
        "pass": (f"buyer IS NULL OR {_known}", f"buyer IS NOT NULL AND NOT ({_known})", "FALSE"),
    }[_mode]
    _name = "VAL-lookup" if _mode == "fail" else f"VAL-lookup.{_mode}"
    check_query(_name, Check(_name, "validity", "reference_lookup", "ords", ("buyer",), {
        "reference_dataset": "customer", "reference_column": "c_custkey", "null_handling": _mode}), f"""
        SELECT *, total_rows - skipped_rows AS evaluated_rows FROM (
        SELECT count(*) AS total_rows, {_count(_ok)} AS passed_rows, {_count(_bad)} AS failed_rows,
               {_count(_skip)} AS skipped_rows FROM {source('ords')} t) c""")
check_query("CNS-doc-in", Check("CNS-doc-in", "validity", "reference_lookup", "cust", ("c_custkey",), {
    "reference_dataset": "ords", "reference_column": "buyer", "null_handling": "skip"}),
    f"""SELECT *, total_rows AS evaluated_rows FROM (
        SELECT count(*) AS total_rows, {_count('k IS NOT NULL')} AS passed_rows,
               {_count('k IS NULL')} AS failed_rows, 0 AS skipped_rows
        FROM customer LEFT JOIN (SELECT DISTINCT buyer AS k FROM {source('ords')} o) r
          ON c_custkey = k) c""")
_LONG_LIST = list(range(0, 4000, 3))
check_query("VAL-allowed.long_list", Check(
    "VAL-allowed.long_list", "validity", "allowed_values", "ords", ("buyer",),
    {"allowed_values": _LONG_LIST}), f"""
    SELECT *, total_rows AS evaluated_rows FROM (
    SELECT count(*) AS total_rows,
           {_count('buyer IN (SELECT range FROM range(0, 4000, 3))')} AS passed_rows,
           {_count('buyer IS NULL OR buyer NOT IN (SELECT range FROM range(0, 4000, 3))')} AS failed_rows,
           0 AS skipped_rows FROM {source('ords')} t) c""")
check_query("VAL-customsql", Check("VAL-customsql", "validity", "custom_sql", "ords", (), {
    "sql": "SELECT count(*) AS total, count_if(shipped_at < o_orderdate) AS failed FROM {dataset}"}),
    _plain("count(*)", f"count(*) - {_count('shipped_at < o_orderdate')}",
           _count("shipped_at < o_orderdate"), f"{source('ords')} t"))
_LATE = Check("late", "validity", "custom_sql", "ords", (), {
    "sql": "SELECT count(*) AS total, count_if(shipped_at < o_orderdate) AS failed FROM {dataset}",
    "violations_sql": "SELECT o_orderkey, o_custkey FROM {dataset} WHERE shipped_at < o_orderdate"})
register("VAL-customsql.violations", lambda t: violations(t, _LATE),
         f"SELECT o_orderkey, o_custkey FROM {source('ords')} t WHERE shipped_at < o_orderdate")

# --- uniqueness ---
_DUP_EXTRAS = ("CAST(duplicate_groups AS BIGINT) AS duplicate_groups",
               "CAST(max_group_size AS BIGINT) AS max_group_size",
               "CASE WHEN duplicate_groups > 0 THEN round(CAST(failed_rows AS DOUBLE) / duplicate_groups, 2) "
               "ELSE 0e0 END AS avg_group_size")


def _duplicates(keys: str, frm: str, where: str) -> str:
    return f"""
    SELECT total_rows, total_rows - failed_rows AS passed_rows, failed_rows, 0 AS skipped_rows,
           total_rows AS evaluated_rows, duplicate_groups, max_group_size
    FROM (SELECT coalesce(sum(n), 0) AS total_rows,
                 coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS failed_rows,
                 {_count('n > 1')} AS duplicate_groups,
                 coalesce(max(CASE WHEN n > 1 THEN n END), 0) AS max_group_size
          FROM (SELECT count(*) AS n FROM {frm} t {where} GROUP BY {keys}) g) c"""


check_query("UNQ-exact", Check("UNQ-exact", "uniqueness", "exact", "cust", ("email",)),
            _duplicates("email", source("cust"), "WHERE email IS NOT NULL"), _DUP_EXTRAS)
check_query("UNQ-exact.include_nulls", Check(
    "UNQ-exact.include_nulls", "uniqueness", "exact", "cust", ("segment",),
    {"null_handling": "include", "case_sensitive": False}),
    _duplicates("lower(segment)", source("cust"), ""), _DUP_EXTRAS)
check_query("UNQ-composite", Check(
    "UNQ-composite", "uniqueness", "composite", "lineitem", ("l_orderkey", "l_linenumber")),
    _duplicates("l_orderkey, l_linenumber", "lineitem", ""), _DUP_EXTRAS)
check_query("UNQ-scoped", Check(
    "UNQ-scoped", "uniqueness", "scoped", "ords", ("buyer",),
    {"scope_columns": ["status", "o_orderpriority"]}, filter="o_totalprice > 1000"),
    _duplicates("status, o_orderpriority, buyer", source("ords"),
                "WHERE buyer IS NOT NULL AND o_totalprice > 1000"), _DUP_EXTRAS)
check_query("UNQ-cross", Check(
    "UNQ-cross", "uniqueness", "cross_dataset", "ords", ("buyer",),
    {"cross_dataset_name": "cust", "cross_dataset_column": "c_custkey"}, filter="o_orderstatus <> 'F'"), f"""
    SELECT count(*) AS total_rows, {_count('k IS NULL')} AS passed_rows,
           {_count('k IS NOT NULL')} AS failed_rows, 0 AS skipped_rows,
           count(*) AS evaluated_rows, count(DISTINCT k) AS duplicate_groups
    FROM (SELECT * FROM {source('ords')} o WHERE o_orderstatus <> 'F') o
    LEFT JOIN (SELECT DISTINCT c_custkey AS k FROM customer) c ON o.buyer = c.k""", ("duplicate_groups",))
for _name, _dataset, _column in (("UNQ-fuzzy-lev", "part", "p_name"), ("UNQ-fuzzy-lev.segments", "cust", "segment")):
    _t = 0.7
    check_query(_name, Check(_name, "uniqueness", "fuzzy", _dataset, (_column,),
                             {"fuzzy_threshold": _t}), f"""
    WITH v AS (SELECT {_column} AS x, count(*) AS n FROM {source(_dataset)} t GROUP BY 1),
         p AS (SELECT a.x AS ax, b.x AS bx, a.n AS an, b.n AS bn FROM v a JOIN v b ON a.x <> b.x
               WHERE 1e0 - levenshtein(a.x, b.x) / greatest(length(a.x), length(b.x), 1) >= {_t}e0),
         near AS (SELECT ax, sum(bn) AS m FROM p GROUP BY ax)
    SELECT total_rows, total_rows - failed_rows AS passed_rows, failed_rows, 0 AS skipped_rows,
           total_rows AS evaluated_rows, duplicate_pairs
    FROM (SELECT sum(n) AS total_rows,
                 coalesce(sum(CASE WHEN x IS NOT NULL AND (n > 1 OR m > 0) THEN n END), 0) AS failed_rows,
                 CAST(sum(CASE WHEN x IS NOT NULL THEN n * (n - 1) + n * coalesce(m, 0) ELSE 0 END) / 2 AS BIGINT)
                   AS duplicate_pairs
          FROM v LEFT JOIN near ON x = ax) c""", ("duplicate_pairs",))
# Whole texts. One edit changes the bag of words by three at most, which spares SQL most distances.
# SQL's distance counts bytes: accented letters become unused control characters.
_t, _text, _accents = 0.95, "regexp_split_to_array(x, ' ')", "äöüßéèêçñóíÄÖÜÉÈÊÇÑÓÍ"
_marks = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 32)][:len(_accents)])
check_query("UNQ-fuzzy-lev.texts", Check("UNQ-fuzzy-lev.texts", "uniqueness", "fuzzy", "documents", ("text",), {"fuzzy_threshold": _t}), f"""
    WITH v AS (SELECT row_number() OVER () AS id, translate(x, '{_accents}', {_marks}) AS x, n, length(x) AS size
                   FROM (SELECT text AS x, count(*) AS n FROM documents GROUP BY 1) g),
         w AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest({_text}) AS w FROM v) u WHERE w <> '' GROUP BY 1, 2),
         words AS (SELECT v.id, x, n, size, coalesce(s, 0) AS s FROM v LEFT JOIN (SELECT id, sum(c) AS s FROM w GROUP BY 1) k USING (id)
                   WHERE x IS NOT NULL),
         shared AS (SELECT a.id AS a, b.id AS b, sum(least(a.c, b.c)) AS o FROM w a JOIN w b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2),
         cand AS (SELECT a.id AS a, b.id AS b FROM shared s JOIN words a ON a.id = s.a JOIN words b ON b.id = s.b
                  WHERE abs(a.size - b.size) <= {1 - _t} * greatest(a.size, b.size) + 1
                    AND a.s + b.s - 2 * o <= 3 * ({1 - _t} * greatest(a.size, b.size) + 1)
                  UNION SELECT a.id, b.id FROM words a JOIN words b ON a.id < b.id
                  WHERE a.s + b.s <= 3 * ({1 - _t} * greatest(a.size, b.size) + 1)),
         p AS (SELECT a.id AS ax, b.id AS bx, a.n AS an, b.n AS bn FROM cand c JOIN words a ON a.id = c.a JOIN words b ON b.id = c.b
               WHERE 1e0 - levenshtein(a.x, b.x) / greatest(a.size, b.size, 1) >= {_t}e0),
         near AS (SELECT x, sum(m) AS m FROM (SELECT ax AS x, bn AS m FROM p UNION ALL SELECT bx, an FROM p) u GROUP BY 1)
    SELECT total_rows, total_rows - failed_rows AS passed_rows, failed_rows, 0 AS skipped_rows,
           total_rows AS evaluated_rows, duplicate_pairs
    FROM (SELECT sum(n) AS total_rows,
                 coalesce(sum(CASE WHEN v.x IS NOT NULL AND (n > 1 OR m > 0) THEN n END), 0) AS failed_rows,
                 CAST(sum(CASE WHEN v.x IS NOT NULL THEN n * (n - 1) + n * coalesce(m, 0) ELSE 0 END) / 2 AS BIGINT) AS duplicate_pairs
          FROM v LEFT JOIN near ON v.id = near.x) c""", ("duplicate_pairs",))
_FROM, _TO = "aeiouybfpvcgjkqsxzdtlmnr ", "0000001111222222223345560"
_CODES = (f"translate(lower(p_name[1]), '{_FROM}', '{_TO}') || "
          f"regexp_replace(translate(lower(p_name[2:]), '{_FROM}', '{_TO}'), '[hw]', '', 'g')")
for _digit in "123456":
    _CODES = f"regexp_replace({_CODES}, '{_digit}+', '{_digit}', 'g')"
check_query("UNQ-fuzzy-sdx", Check("UNQ-fuzzy-sdx", "uniqueness", "fuzzy", "part", ("p_name",),
                                   {"fuzzy_algorithm": "soundex"}), f"""
    SELECT total_rows, total_rows - failed_rows AS passed_rows, failed_rows, 0 AS skipped_rows,
           total_rows AS evaluated_rows, CAST(duplicate_pairs AS BIGINT) AS duplicate_pairs
    FROM (SELECT sum(n) AS total_rows, coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS failed_rows,
                 sum(n * (n - 1)) / 2 AS duplicate_pairs
          FROM (SELECT upper(p_name[1]) || rpad(replace(substr({_CODES}, 2), '0', ''), 3, '0') AS code, count(*) AS n
                FROM part GROUP BY 1) g) c""", ("duplicate_pairs",))
for _name, _window, _seconds in (("UNQ-temporal", "10m", 600), ("UNQ-temporal.hours", "6h", 21600)):
    check_query(_name, Check(_name, "uniqueness", "temporal", "evt", ("device", "event_type"),
                             {"temporal_column": "ts", "temporal_window": _window}), f"""
    SELECT count(*) AS total_rows, {_count('NOT coalesce(gap <= lim, FALSE)')} AS passed_rows,
           {_count('gap <= lim')} AS failed_rows, 0 AS skipped_rows, count(*) AS evaluated_rows
    FROM (SELECT {_seconds * 1_000_000} AS lim, CASE WHEN device IS NOT NULL THEN least(
                 epoch_us(ts) - epoch_us(lag(ts) OVER w), epoch_us(lead(ts) OVER w) - epoch_us(ts)) END AS gap
          FROM {source('evt')} t WINDOW w AS (PARTITION BY device, event_type ORDER BY ts)) g""")

# --- consistency ---
check_query("CNS-interrecord", Check(
    "CNS-interrecord", "consistency", "inter_record", "ords", (),
    {"group_by_columns": ["o_custkey"], "comparison_columns": ["currency"]}), f"""
    SELECT sum(n) AS total_rows, sum(CASE WHEN d <= 1 THEN n ELSE 0 END) AS passed_rows,
           sum(CASE WHEN d > 1 THEN n ELSE 0 END) AS failed_rows, 0 AS skipped_rows,
           sum(n) AS evaluated_rows, {_count('d > 1')} AS inconsistent_groups
    FROM (SELECT o_custkey, count(*) AS n, count(DISTINCT currency) AS d FROM {source('ords')} t
          GROUP BY o_custkey) g""", ("inconsistent_groups",))


def _pairs(left: str, right: str, on: str, same: str) -> str:
    return _plain("count(*)", _count(same), _count(f"NOT ({same})"),
                  f"{left} a JOIN {right} b ON {on}")


# Lines per order against the order: the key repeats on the checked side, ``flag`` has NULLs.
check_query("CNS-crosstable", Check(
    "CNS-crosstable", "consistency", "cross_table", "li", (),
    {"comparison_dataset": "li", "join_keys": ["l_orderkey"],
     "comparison_columns": ["flag", "l_linestatus"]}),
    f"""SELECT count(*) AS total_rows, {_count('a.flag = b.flag AND a.l_linestatus = b.l_linestatus')} AS passed_rows,
        {_count('NOT (a.flag = b.flag AND a.l_linestatus = b.l_linestatus)')} AS failed_rows,
        0 AS skipped_rows, count(*) AS evaluated_rows
        FROM {source('li')} a JOIN {source('li')} b ON a.l_orderkey = b.l_orderkey""")
check_query("CNS-aggregation", Check(
    "CNS-aggregation", "consistency", "aggregation", "li", ("l_quantity",),
    {"group_by_columns": ["l_orderkey"], "aggregation_function": "SUM", "expected_column": "l_linenumber",
     "tolerance_type": "absolute", "tolerance_value": 50}), _plain(
    "count(*)", _count("abs(s - e) <= 50"), _count("abs(s - e) > 50"),
    """(SELECT l_orderkey AS k, sum(l_quantity) AS s FROM lineitem GROUP BY 1) a
       JOIN (SELECT DISTINCT l_orderkey AS h, l_linenumber AS e FROM lineitem) b ON a.k = b.h"""))

# --- timeliness of the table ---


def _table_age(check_id, subtype, limit_param, limit, weight):
    seconds = limit[1]
    check = Check(check_id, "timeliness", subtype, "evt", ("loaded_at",), {limit_param: limit[0]})
    stale = f"age > {seconds}e6" + (" OR n = 0" if subtype == "heartbeat" else "")
    check_query(check_id, check, f"""
    SELECT {weight} AS total_rows, CASE WHEN n > 0 AND age <= {seconds}e6 THEN {weight} ELSE 0 END AS passed_rows,
           CASE WHEN {stale} THEN {weight} ELSE 0 END AS failed_rows, 0 AS skipped_rows,
           {weight} AS evaluated_rows, most_recent, age / 1e6 AS age_seconds
    FROM (SELECT count(*) AS n, max(loaded_at) AS most_recent,
                 epoch_us({_NOW}) - epoch_us(max(loaded_at)) AS age FROM {source('evt')} t) s""",
        ("most_recent", "age_seconds"))


_table_age("TML-freshness", "freshness", "max_age", ("36h", 129600), "n")
_table_age("GEN-freshness-doc", "freshness", "max_age", ("30m", 1800), "n")
_table_age("TML-heartbeat", "heartbeat", "expected_frequency", ("12h", 43200), "1")
for _metric, _sql in (("max", "max(d)"), ("avg", "avg(d)"), ("p95", "quantile_cont(d, 0.95)"),
                      ("p99", "quantile_cont(d, 0.99)")):
    _name = "TML-metric" if _metric == "p95" else f"TML-metric.{_metric}"
    check_query(_name, Check(_name, "timeliness", "delay_metric", "evt", ("ts",), {
        "comparison_timestamp": "loaded_at", "max_age": "88m", "metric_type": _metric}), f"""
    SELECT 1 AS total_rows, CASE WHEN v <= 5280 THEN 1 ELSE 0 END AS passed_rows,
           CASE WHEN v > 5280 THEN 1 ELSE 0 END AS failed_rows, 0 AS skipped_rows,
           1 AS evaluated_rows, v AS delay_seconds
    FROM (SELECT {_sql} AS v FROM (SELECT abs(epoch_us(loaded_at) - epoch_us(ts)) / 1e6 AS d
                                   FROM {source('evt')} t) x) m""", ("delay_seconds",))

# --- accuracy ---
_REF = {"reference_dataset": "ords", "reference_column": "booked", "join_keys": ["o_orderkey"]}


def _accuracy(name, subtype, params, match, mismatch):
    check_query(name, Check(name, "accuracy", subtype, "orders", ("o_totalprice",), {**_REF, **params}), f"""
    SELECT count(*) AS total_rows, {_count(f'b.booked IS NOT NULL AND {match}')} AS passed_rows,
           {_count(f'b.booked IS NOT NULL AND {mismatch}')} AS failed_rows, 0 AS skipped_rows,
           count(b.booked) AS evaluated_rows, count(b.booked) AS verified_rows,
           count(*) - count(b.booked) AS unverifiable_rows
    FROM orders a LEFT JOIN {source('ords')} b ON a.o_orderkey = b.o_orderkey""",
                ("verified_rows", "unverifiable_rows"))


_GAP = "abs(a.o_totalprice - b.booked)"
_accuracy("ACC-reference", "reference_comparison", {}, "a.o_totalprice = b.booked", "a.o_totalprice <> b.booked")
_accuracy("ACC-trusted", "trusted_source", {"tolerance_type": "absolute", "tolerance_value": 2000},
          f"{_GAP} <= 2000", f"{_GAP} > 2000")
_SHARE = f"{_GAP} / nullif(abs(b.booked), 0) * 100"
_accuracy("ACC-deviation", "tolerated_deviation", {"tolerance_type": "percentage", "tolerance_value": 2.5},
          f"{_SHARE} <= 2.5e0", f"{_SHARE} > 2.5e0")
check_query("PRED-tol", Check(
    "PRED-tol", "accuracy", "tolerated_deviation", "orders", ("o_totalprice",),
    {**_REF, "tolerance_type": "absolute", "tolerance_value": 1000, "null_handling": "skip"}), f"""
    SELECT count(*) AS total_rows, {_count(f'{_GAP} <= 1000')} AS passed_rows, {_count(f'{_GAP} > 1000')} AS failed_rows,
           0 AS skipped_rows, count(b.booked) AS evaluated_rows, count(b.booked) AS verified_rows,
           count(*) - count(b.booked) AS unverifiable_rows
    FROM orders a LEFT JOIN {source('ords')} b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice IS NOT NULL""",
    ("verified_rows", "unverifiable_rows"))
for _mode in ("fail", "skip"):
    _name = "ACC-zscore" if _mode == "fail" else f"ACC-zscore.{_mode}"
    _z = "abs(reading - mu) / nullif(sigma, 0) "
    check_query(_name, Check(_name, "accuracy", "statistical", "evt", ("reading",),
                             {"statistical_threshold": 2.0, "null_handling": _mode}), _plain(
        "count(*)", _count(_z + "<= 2"), _count(_z + "> 2"),
        f"""{source('evt')} t CROSS JOIN (SELECT avg(reading) AS mu, stddev_samp(reading) AS sigma
            FROM {source('evt')} s) s {'WHERE reading IS NOT NULL' if _mode == 'skip' else ''}"""))
_OUT = "reading < q1 - 1.5e0 * (q3 - q1) OR reading > q3 + 1.5e0 * (q3 - q1)"
check_query("ACC-iqr", Check("ACC-iqr", "accuracy", "statistical", "evt", ("reading",),
                             {"statistical_method": "iqr"}), _plain(
    "count(*)", _count(f"NOT ({_OUT})"), _count(_OUT),
    f"""{source('evt')} t CROSS JOIN (SELECT quantile_cont(reading, 0.25) AS q1,
        quantile_cont(reading, 0.75) AS q3 FROM {source('evt')} s) s"""))
check_query("STA-outliers", Check("STA-outliers", "statistical", "outliers", "evt", ("reading",)), _plain(
    "count(*)", "count(*) - " + _count("reading < mu - 3 * sd OR reading > mu + 3 * sd"),
    _count("reading < mu - 3 * sd OR reading > mu + 3 * sd"),
    f"{source('evt')} t CROSS JOIN (SELECT avg(reading) AS mu, stddev_samp(reading) AS sd FROM {source('evt')} s) s"))


@query("STA-stats", f"""
    SELECT count(*) AS total_rows, round(avg(reading), 4) AS mean_value,
           round(stddev_samp(reading), 4) AS stddev_value, min(reading) AS min_value,
           max(reading) AS max_value FROM {source('evt')} t""")
def _stats(t):
    return column_statistics(t["evt"], "reading").withColumns({
        "mean_value": F.round("mean_value", 4), "stddev_value": F.round("stddev_value", 4)})


# --- reconciliation: orders as booked against orders found in the line items ---
from veritab.registry import base as _base  # noqa: E402

_base.derive("booked_orders", "orders", [
    "o_orderkey", "o_custkey", "o_totalprice AS amount", "o_orderpriority AS priority",
    "nullif(o_orderstatus, 'P') AS status"])
_base.derive("billed_orders", "orders", [
    "CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey",
    "o_custkey",
    "CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN o_totalprice + (o_orderkey % 40) ELSE o_totalprice END AS amount",
    "CASE WHEN o_orderkey % 17 = 0 THEN '9-OTHER' ELSE o_orderpriority END AS priority",
    "nullif(o_orderstatus, 'P') AS status"])
_SIDES = {"source_dataset": "booked_orders", "target_dataset": "billed_orders"}
_S, _T = source("booked_orders"), source("billed_orders")


def _recon(name, subtype, params, counts, extras=(), columns=()):
    check_query(name, Check(name, "reconciliation", subtype, "booked_orders", tuple(columns),
                            {**_SIDES, **params}), counts, extras)


_recon("REC-count", "record_count", {"target_filter": "status = 'O'"}, f"""
    SELECT greatest(s, t) AS total_rows, least(s, t) AS passed_rows, abs(s - t) AS failed_rows, 0 AS skipped_rows,
           greatest(s, t) AS evaluated_rows, s AS source_count, t AS target_count
    FROM (SELECT count(*) AS s FROM {_S} a) x CROSS JOIN (SELECT count(*) AS t FROM {_T} b WHERE status = 'O') y""",
       ("source_count", "target_count"))
_SIZES = f"(SELECT count(*) AS s FROM {_S} a) x CROSS JOIN (SELECT count(*) AS t FROM {_T} b) y"
_recon("REC-onetoone", "one_to_one", {"join_keys": ["o_orderkey"]}, f"""
    SELECT greatest(s, t) AS total_rows, m AS passed_rows, d + e AS failed_rows, 0 AS skipped_rows,
           greatest(s, t) AS evaluated_rows, s AS source_count, t AS target_count, m AS matched_count,
           d AS missing_in_target, e AS extra_in_target
    FROM {_SIZES} CROSS JOIN (
      SELECT {_count('a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL')} AS m,
             {_count('a.o_orderkey IS NOT NULL AND b.o_orderkey IS NULL')} AS d,
             {_count('a.o_orderkey IS NULL AND b.o_orderkey IS NOT NULL')} AS e
      FROM {_S} a FULL OUTER JOIN {_T} b ON a.o_orderkey = b.o_orderkey) j""",
       ("source_count", "target_count", "matched_count", "missing_in_target", "extra_in_target"))
# Keys that repeat on both sides multiply, as in the joined rows.
_recon("REC-onetoone.repeated", "one_to_one",
       {"join_keys": [{"source": "o_custkey", "target": "o_custkey"}, {"source": "status", "target": "status"}]}, f"""
    SELECT greatest(s, t) AS total_rows, m AS passed_rows, d + e AS failed_rows, 0 AS skipped_rows,
           greatest(s, t) AS evaluated_rows, s AS source_count, t AS target_count, m AS matched_count,
           d AS missing_in_target, e AS extra_in_target
    FROM {_SIZES} CROSS JOIN (
      SELECT {_count('a.o_custkey IS NOT NULL AND b.o_custkey IS NOT NULL')} AS m,
             {_count('a.o_custkey IS NOT NULL AND b.o_custkey IS NULL')} AS d,
             {_count('a.o_custkey IS NULL AND b.o_custkey IS NOT NULL')} AS e
      FROM {_S} a FULL OUTER JOIN {_T} b ON a.o_custkey = b.o_custkey AND a.status = b.status) j""",
       ("source_count", "target_count", "matched_count", "missing_in_target", "extra_in_target"))
_recon("REC-missingextra", "missing_extra", {"join_keys": ["o_orderkey"]}, f"""
    SELECT s + e AS total_rows, s - d AS passed_rows, d + e AS failed_rows, 0 AS skipped_rows,
           s + e AS evaluated_rows, s AS source_count, t AS target_count,
           d AS missing_in_target, e AS extra_in_target
    FROM {_SIZES}
    CROSS JOIN (SELECT count(*) AS d FROM {_S} a ANTI JOIN {_T} b ON a.o_orderkey = b.o_orderkey) m
    CROSS JOIN (SELECT count(*) AS e FROM {_T} b ANTI JOIN {_S} a ON a.o_orderkey = b.o_orderkey) n""",
       ("source_count", "target_count", "missing_in_target", "extra_in_target"))
_recon("REC-field", "field_level", {"join_keys": ["o_orderkey"], "compare_columns": ["amount", "priority", "status"]},
       _pairs(_S, _T, "a.o_orderkey = b.o_orderkey",
              "a.amount = b.amount AND a.priority = b.priority AND a.status = b.status"))
_recon("REC-tolerance", "tolerance", {"join_keys": ["o_orderkey"], "tolerance_type": "absolute", "tolerance_value": 20},
       _plain("count(*)", _count("abs(a.amount - b.amount) <= 20"), _count("abs(a.amount - b.amount) > 20"),
              f"{_S} a JOIN {_T} b ON a.o_orderkey = b.o_orderkey"), columns=["amount"])
_recon("REC-tolerance.repeated", "tolerance",
       {"join_keys": ["o_custkey"], "tolerance_type": "percentage", "tolerance_value": 10},
       _plain("count(*)", _count("abs(a.amount - b.amount) / nullif(abs(b.amount), 0) * 100 <= 10"),
              _count("abs(a.amount - b.amount) / nullif(abs(b.amount), 0) * 100 > 10"),
              f"{_S} a JOIN {_T} b ON a.o_custkey = b.o_custkey"), columns=["amount"])
# Few keys, and tolerances that hold for most or all values of a key.
for _name, _kind, _value, _gap in (("REC-tolerance.whole", "percentage", 100, "abs(a.amount - b.amount) / nullif(abs(b.amount), 0) * 100"),
                                   ("REC-tolerance.wide", "absolute", 200000, "abs(a.amount - b.amount)")):
    _recon(_name, "tolerance", {"join_keys": ["status"], "tolerance_type": _kind, "tolerance_value": _value},
           _plain("count(*)", _count(f"{_gap} <= {_value}"), _count(f"{_gap} > {_value}"), f"{_S} a JOIN {_T} b ON a.status = b.status"),
           columns=["amount"])
_recon("REC-aggregate", "aggregate", {"aggregate_column": "o_custkey", "aggregate_function": "SUM",
                                      "target_filter": "priority <> '9-OTHER'", "tolerance_type": "percentage",
                                      "tolerance_value": 7}, f"""
    SELECT 1 AS total_rows, CASE WHEN abs(s - t) / abs(s) * 100 <= 7 THEN 1 ELSE 0 END AS passed_rows,
           CASE WHEN abs(s - t) / abs(s) * 100 <= 7 THEN 0 ELSE 1 END AS failed_rows, 0 AS skipped_rows,
           1 AS evaluated_rows, s AS source_agg, t AS target_agg
    FROM (SELECT CAST(sum(o_custkey) AS BIGINT) AS s FROM {_S} a) x
    CROSS JOIN (SELECT CAST(sum(o_custkey) AS BIGINT) AS t FROM {_T} b WHERE priority <> '9-OTHER') y""",
       ("source_agg", "target_agg"))
_grouped = {"aggregate_column": "amount", "aggregate_function": "MAX", "group_by_columns": ["o_custkey"],
            "tolerance_type": "absolute", "tolerance_value": 5}
_GROUPED_SQL = f"""
    SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, s AS source_agg, t AS target_agg,
           abs(coalesce(s, 0) - coalesce(t, 0)) <= 5 AS matches
    FROM (SELECT o_custkey, max(amount) AS s FROM {_S} x GROUP BY 1) a
    FULL OUTER JOIN (SELECT o_custkey, max(amount) AS t FROM {_T} y GROUP BY 1) b ON a.o_custkey = b.o_custkey"""
_recon("REC-aggregate-grouped.summary", "aggregate", _grouped,
       _plain("count(*)", _count("matches"), _count("NOT matches"), f"({_GROUPED_SQL}) g"))
register("REC-aggregate-grouped", lambda t: grouped_aggregates(
    Check("x", "reconciliation", "aggregate", "booked_orders", (), {**_SIDES, **_grouped}),
    t["booked_orders"], t["billed_orders"]), _GROUPED_SQL)
_MISSING = "SELECT o_orderkey, o_custkey, amount, priority, status, '{tag}' AS recon_status FROM {a} a ANTI JOIN {b} b ON a.o_orderkey = b.o_orderkey"
register("REC-violations", lambda t: unmatched(t["booked_orders"], t["billed_orders"], [("o_orderkey", "o_orderkey")]),
         _MISSING.format(tag="missing_in_target", a=_S, b=_T) + " UNION ALL "
         + _MISSING.format(tag="extra_in_target", a=_T, b=_S))

# --- suites ---
_SUITE = [
    (Check("s1", "completeness", "null", "li", ("flag",)), "flag IS NOT NULL", "flag IS NULL"),
    (Check("s2", "validity", "range", "li", ("l_quantity",), {"min_value": 1, "max_value": 45}),
     "l_quantity BETWEEN 1 AND 45", "NOT (l_quantity BETWEEN 1 AND 45)"),
    (Check("s3", "validity", "regex", "li", ("l_linestatus",), {"regex_pattern": "^[OF]$"}),
     "regexp_matches(l_linestatus, '^[OF]$')", "NOT regexp_matches(l_linestatus, '^[OF]$')"),
    (Check("s4", "consistency", "formula", "li", (), {
        "expected_column": "net", "rule_expression": "l_extendedprice * (1 - l_discount)"}),
     "abs(net - l_extendedprice * (1 - l_discount)) <= 0.01e0",
     "abs(net - l_extendedprice * (1 - l_discount)) > 0.01e0"),
    (Check("s5", "generic", "condition", "li", (), {"expression": "l_tax <= l_discount"}),
     "l_tax <= l_discount", "NOT (l_tax <= l_discount)"),
]


def _suite_sql(entries):
    return " UNION ALL ".join(summary_sql(check, _plain(
        "count(*)", _count(ok), _count(bad), f"{source(check.dataset)} t")) for check, ok, bad in entries)


register("SUITE-fused", lambda t: run_suite(t, [c for c, _, _ in _SUITE], AS_OF), _suite_sql(_SUITE))
_FLAG_UNQ = Check("s6", "uniqueness", "composite", "lineitem", ("l_orderkey", "l_linenumber"))
_FLAG_REF = Check("s7", "validity", "reference_lookup", "lineitem", ("l_orderkey",), {
    "reference_dataset": "orders", "reference_column": "o_orderkey"})
register("SUITE-flagship",
         lambda t: run_suite(t, [c for c, _, _ in _SUITE] + [_FLAG_UNQ, _FLAG_REF], AS_OF),
         _suite_sql(_SUITE)
         + " UNION ALL " + summary_sql(_FLAG_UNQ, _duplicates("l_orderkey, l_linenumber", "lineitem", ""))
         + " UNION ALL " + summary_sql(_FLAG_REF, _plain(
             "count(*)", _count("o_orderkey IS NOT NULL"), _count("o_orderkey IS NULL"),
             "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")))

# Three checks on the customers of orders share one grouping.
_KEYED = [Check("g1", "uniqueness", "exact", "ords", ("buyer",)),
          Check("g2", "uniqueness", "exact", "ords", ("buyer",), {"null_handling": "include"}),
          Check("g3", "consistency", "inter_record", "ords", (), {
              "group_by_columns": ["buyer"], "comparison_columns": ["currency"]}),
          Check("g4", "consistency", "inter_record", "ords", (), {
              "group_by_columns": ["buyer"], "comparison_columns": ["status"]})]


def _mixed(column):
    return f"""SELECT sum(n) AS total_rows, sum(CASE WHEN d > 1 THEN 0 ELSE n END) AS passed_rows,
        sum(CASE WHEN d > 1 THEN n ELSE 0 END) AS failed_rows, 0 AS skipped_rows, sum(n) AS evaluated_rows
        FROM (SELECT count(*) AS n, count(DISTINCT {column}) AS d FROM {source('ords')} t GROUP BY buyer) g"""


register("SUITE-keyed", lambda t: run_suite(t, _KEYED, AS_OF), " UNION ALL ".join([
    summary_sql(_KEYED[0], _duplicates("buyer", source("ords"), "WHERE buyer IS NOT NULL")),
    summary_sql(_KEYED[1], _duplicates("buyer", source("ords"), "")),
    summary_sql(_KEYED[2], _mixed("currency")), summary_sql(_KEYED[3], _mixed("status"))]))

# --- compound groups ---
_MEMBERS = [Check("m1", "validity", "range", "li", ("l_quantity",), {"max_value": 40}),
            Check("m2", "completeness", "null", "li", ("flag",)),
            Check("m3", "conformity", "regex", "li", ("l_linestatus",), {"regex_pattern": "^O$"})]
_M = ["(l_quantity <= 40)", "(flag IS NOT NULL)", "(l_linestatus = 'O')"]
for _logic in ("AND", "OR"):
    _name = "GEN-compound" if _logic == "AND" else "GEN-compound.or"
    _all = f" {_logic} ".join(_M)
    check_query(_name, Check(_name, "generic", "compound", "li", (), {"logic": _logic, "members": _MEMBERS}),
                _plain("count(*)", _count(_all), _count(f"NOT ({_all})"), f"{source('li')} t"))
register("GEN-compound.independent", lambda t: run_suite(t, _MEMBERS, AS_OF), " UNION ALL ".join(
    summary_sql(c, _plain("count(*)", _count(ok), _count(f"NOT {ok}"), f"{source('li')} t"))
    for c, ok in zip(_MEMBERS, _M)))

# --- shared predicates, each judged over all orders in one scan ---
_SPELLINGS = [(alias, op) for op, aliases in X.OPERATOR_ALIASES.items() for alias in aliases]
_INVERTED = {"=": "<>", "!=": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def _tallied(df, names, conditions):
    """One row per named condition with the rows it holds for."""
    row = df.agg(F.array(*[F.count(F.when(c, 1)) for c in conditions]).alias("n"))
    labels = F.array(*[F.lit(n) for n in names])
    return row.select(F.inline(F.arrays_zip(labels.alias("name"), F.col("n")))).toDF("name", "n")


def _tallied_sql(pairs, table="ords"):
    return " UNION ALL ".join(f"SELECT '{n}' AS name, {_count(c)} AS n FROM {source(table)} t" for n, c in pairs)


@query("PRED-ops", _tallied_sql([(a, f"buyer {op} o_custkey") for a, op in _SPELLINGS]))
def _operators(t):
    return _tallied(t["ords"], [a for a, _ in _SPELLINGS],
                    [X.compare(F.col("buyer"), a, F.col("o_custkey")) for a, _ in _SPELLINGS])


@query("PRED-invert", _tallied_sql([(op, f"booked {inv} o_totalprice") for op, inv in _INVERTED.items()]))
def _inverted(t):
    return _tallied(t["ords"], list(_INVERTED), [violating("column_comparison", {
        "columns": ["booked"], "operator": op, "compare_column": "o_totalprice"}) for op in _INVERTED])


@query("PRED-neg", _tallied_sql([("exact", "phone = 'n/a'"), ("contains", "phone LIKE '%1_5%'"),
                                 ("regex", "regexp_matches(phone, '[05]$')")], "cust"))
def _negatives(t):
    wanted = {"exact": "n/a", "contains": "1_5", "regex": "[05]$"}
    return _tallied(t["cust"], list(wanted),
                    [P.negative_match(F.col("phone"), p, mode) for mode, p in wanted.items()])


_TEMPLATES = {"AA-9999": "^[A-Z][A-Z]-[0-9][0-9][0-9][0-9]$", "AA-0999": "^[A-Z][A-Z]-0[0-9][0-9][0-9]$",
              "ab-99": "^ab-[0-9][0-9]$"}


@query("PRED-template", _tallied_sql([(n, f"regexp_matches(code, '{r}')") for n, r in _TEMPLATES.items()], "cust"))
def _templates(t):
    return _tallied(t["cust"], list(_TEMPLATES), [F.col("code").rlike(P.template_regex(n)) for n in _TEMPLATES])
