"""Row-level checks: completeness, validity, conformity, consistency, timeliness, generic."""

from __future__ import annotations

from veritab.functions import patterns as P
from veritab.registry.base import AS_OF, derive, row_query

# --- completeness ---
_BLANK = "segment IS NULL OR trim(segment) = ''"
row_query("CMP-null", "completeness", "null", "cust", ["segment"], {},
          "segment IS NOT NULL", "segment IS NULL", threshold_pass=95, threshold_warn=85)
row_query("CMP-null.columns", "completeness", "null", "cust", ["segment", "email"], {},
          "segment IS NOT NULL AND email IS NOT NULL", "segment IS NULL OR email IS NULL")
row_query("CMP-null.empty_strings", "completeness", "null", "cust", ["segment"],
          {"include_empty_strings": True}, f"NOT ({_BLANK})", _BLANK)
row_query("CMP-null.star", "completeness", "null", "cust", ["*"], {}, "TRUE", "FALSE")
row_query("CMP-empty", "completeness", "empty", "cust", ["segment"], {}, f"NOT ({_BLANK})", _BLANK)
_HOLDER = f"{_BLANK} OR lower(trim(segment)) IN ('n/a', 'tbd')"
row_query("CMP-placeholder", "completeness", "placeholder", "cust", ["segment"],
          {"placeholder_values": ["N/A ", "TBD"]}, f"NOT ({_HOLDER})", _HOLDER)
row_query("CMP-conditional", "completeness", "conditional", "cust", ["email"],
          {"condition_column": "c_mktsegment", "condition_value": ["BUILDING", "MACHINERY"]},
          "email IS NOT NULL", "email IS NULL", where="c_mktsegment IN ('BUILDING', 'MACHINERY')")
row_query("CMP-multi-all", "completeness", "multi_field", "cust", ["segment", "phone", "code"], {},
          "segment IS NOT NULL AND phone IS NOT NULL AND code IS NOT NULL",
          "segment IS NULL OR phone IS NULL OR code IS NULL")
row_query("CMP-multi-any", "completeness", "multi_field", "cust", ["segment", "email"],
          {"multi_field_mode": "any"}, "coalesce(segment, email) IS NOT NULL",
          "segment IS NULL AND email IS NULL")
row_query("CMP-population", "completeness", "population", "li", ["flag"], {},
          "flag IS NOT NULL", "flag IS NULL", threshold_pass=60, threshold_warn=40)
_ABSENT = "segment IS NULL OR segment = '' OR (trim(segment) = '' AND segment <> '')"
row_query("CMP-doc", "completeness", "not_null", "cust", ["segment"],
          {"treat_whitespace_as_null": True}, f"NOT ({_ABSENT})", _ABSENT)
row_query("CMP-doc.default", "completeness", "not_null", "cust", ["segment"], {},
          "segment IS NOT NULL AND segment <> ''", "segment IS NULL OR segment = ''")

# --- validity: each type under each NULL policy ---


def _validity(name, subtype, dataset, columns, params, ok, missing, **options):
    for mode in ("fail", "skip", "pass"):
        label = name if mode == "fail" else f"{name}.{mode}"
        passed, failed, skipped = {
            "fail": (ok, f"NOT ({ok}) OR {missing}", "FALSE"),
            "skip": (f"NOT ({missing}) AND ({ok})", f"NOT ({missing}) AND NOT ({ok})", missing),
            "pass": (f"({ok}) OR {missing}", f"NOT ({missing}) AND NOT ({ok})", "FALSE"),
        }[mode]
        row_query(label, "validity", subtype, dataset, columns, {**params, "null_handling": mode},
                  passed, failed, skipped=skipped, **options)


def _matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


_validity("VAL-regex", "regex", "cust", ["email"], {"regex_pattern": r"^user[0-9]+@"},
          _matches("email", "^user[0-9]+@"), "email IS NULL")
_validity("VAL-range", "range", "cust", ["credit"], {"min_value": 0, "max_value": 9000},
          "credit >= 0 AND credit <= 9000", "credit IS NULL")
row_query("VAL-range.min", "validity", "range", "li", ["l_quantity"], {"min_value": 2},
          "l_quantity >= 2", "NOT (l_quantity >= 2) OR l_quantity IS NULL", max_violations=100,
          threshold_pass=50)
_validity("VAL-allowed", "allowed_values", "li", ["flag"], {"allowed_values": ["A", "X"]},
          "flag IN ('A', 'X')", "flag IS NULL")
_validity("VAL-rule", "business_rule", "ords", ["booked"],
          {"expression": "booked > 1000 AND o_orderstatus <> 'F'"},
          "booked > 1000 AND o_orderstatus <> 'F'", "booked IS NULL")
_validity("VAL-crossfield", "cross_field", "li", ["net"],
          {"comparison_column": "l_extendedprice", "comparison_operator": "less_than"},
          "net < l_extendedprice", "(net IS NULL OR l_extendedprice IS NULL)")
_validity("VAL-datelogic", "date_logic", "ords", ["shipped_at"],
          {"comparison_column": "o_orderdate", "comparison_operator": "not_before"},
          "CAST(shipped_at AS DATE) >= CAST(o_orderdate AS DATE)",
          "(shipped_at IS NULL OR o_orderdate IS NULL)")
_validity("VAL-negative", "negative", "cust", ["email"],
          {"negative_expression": "email LIKE '%Test%'"}, "NOT (email LIKE '%Test%')",
          "email IS NULL")
row_query("VAL-negative.contains", "validity", "negative", "cust", ["phone"],
          {"negative_pattern": "n/a", "negative_match_mode": "contains"},
          "NOT (phone LIKE '%n/a%')", "phone LIKE '%n/a%' OR phone IS NULL")
row_query("VAL-negative.exact", "validity", "negative", "li", ["flag"],
          {"negative_pattern": "R", "negative_match_mode": "exact"},
          "NOT (flag = 'R')", "flag = 'R' OR flag IS NULL")
row_query("VAL-validator", "validity", "validator", "pages", ["url"], {"validator": "url"},
          _matches("url", P.VALIDATORS["url"]), f"NOT {_matches('url', P.VALIDATORS['url'])} OR url IS NULL")
row_query("VAL-validator.email", "validity", "validator", "cust", ["email"], {"validator": "email"},
          _matches("email", P.VALIDATORS["email"]),
          f"NOT {_matches('email', P.VALIDATORS['email'])} OR email IS NULL")
# Which values are right follows from how the columns are derived, not from the patterns.
derive("formats", "customer", [
    "c_custkey",
    """CASE c_custkey % 4 WHEN 0 THEN '10.0.' || CAST(c_custkey % 300 AS STRING) || '.7' WHEN 1 THEN '300.1.1.1'
       WHEN 3 THEN '255.255.255.' || CAST(c_custkey % 256 AS STRING) END AS ipv4""",
    """CASE c_custkey % 4 WHEN 0 THEN '2001:db8::' || CAST(c_custkey % 1000 AS STRING) WHEN 1 THEN '1:2:3:4:5:6:7:8'
       WHEN 2 THEN '1:2:3' END AS ipv6""",
    """CASE WHEN c_custkey % 3 = 1 THEN 'no-uuid' WHEN c_custkey % 5 = 0 THEN '123e4567-e89b-72d3-a456-' || lpad(CAST(c_custkey AS STRING), 12, '0')
       WHEN c_custkey % 7 > 0 THEN '123e4567-E89B-12d3-a456-' || lpad(CAST(c_custkey AS STRING), 12, '0') END AS uuid""",
    """CASE c_custkey % 4 WHEN 0 THEN '2024-01-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') WHEN 1 THEN '2024-1-5'
       WHEN 2 THEN '2024-02-03T10:00' END AS day""",
    """CASE c_custkey % 4 WHEN 0 THEN '+1' || CAST(200000000 + c_custkey AS STRING) WHEN 1 THEN '0049123' WHEN 2 THEN '+0123' END AS phone""",
    "CASE c_custkey % 3 WHEN 0 THEN lpad(CAST(c_custkey AS STRING), 9, '0') WHEN 1 THEN CAST(c_custkey AS STRING) || 'a' END AS digits",
    "CASE c_custkey % 3 WHEN 0 THEN 'ab' || CAST(c_custkey AS STRING) WHEN 1 THEN 'ab ' || CAST(c_custkey AS STRING) END AS word",
    "CASE c_custkey % 4 WHEN 0 THEN 'plain text~' WHEN 1 THEN 'na' || chr(239) || 've' WHEN 2 THEN 'a' || chr(9) || 'b' END AS mixed",
])
for _name, _column, _ok in (
        ("ipv4", "ipv4", "(c_custkey % 4 = 0 AND c_custkey % 300 < 256) OR c_custkey % 4 = 3"), ("ipv6", "ipv6", "c_custkey % 4 < 2"),
        ("uuid", "uuid", "c_custkey % 3 <> 1 AND c_custkey % 5 > 0 AND c_custkey % 7 > 0"), ("isodate", "day", "c_custkey % 4 = 0"),
        ("iso8601", "day", "c_custkey % 4 IN (0, 2)"), ("phone_e164", "phone", "c_custkey % 4 = 0")):
    row_query(f"VAL-validator.{_name}", "validity", "validator", "formats", [_column], {"validator": _name}, _ok, f"NOT ({_ok})")
row_query("VAL-accepted", "validity", "allowed_values", "cust", ["c_mktsegment"],
          {"allowed_values": ["building", "Machinery", "household"], "case_sensitive": False},
          "lower(c_mktsegment) IN ('building', 'machinery', 'household')",
          "lower(c_mktsegment) NOT IN ('building', 'machinery', 'household') OR c_mktsegment IS NULL")
row_query("VAL-comparison", "validity", "comparison", "cust", ["credit"],
          {"operator": "gte", "value": 0}, "credit >= 0", "NOT (credit >= 0) OR credit IS NULL")
row_query("PRED-filter", "validity", "range", "li", ["l_discount"], {"max_value": 0.05},
          "l_discount <= 0.05e0", "NOT (l_discount <= 0.05e0) OR l_discount IS NULL",
          filter="l_linestatus = 'F' AND l_quantity < 10")

# --- conformity ---


def _conformity(name, subtype, column, params, ok, mode="skip", dataset="cust", **options):
    passed, failed, where = {
        "skip": (ok, f"NOT ({ok})", f"{column} IS NOT NULL"),
        "fail": (ok, f"NOT ({ok})", None),
        "pass": (f"{column} IS NULL OR ({ok})", f"{column} IS NOT NULL AND NOT ({ok})", None),
    }[mode]
    row_query(name, "conformity", subtype, dataset, [column], {**params, "null_handling": mode},
              passed, failed, where=where, **options)


for _mode in ("skip", "fail", "pass"):
    _tail = "" if _mode == "skip" else f".{_mode}"
    _conformity(f"CNF-regex{_tail}", "regex", "email", {"regex_pattern": r"^(user|Test)[0-9]+@"},
                _matches("trim(email)", "^(user|Test)[0-9]+@"), _mode)
_conformity("CNF-regex.untrimmed", "regex", "email",
            {"regex_pattern": "^Test", "trim_whitespace": False}, _matches("email", "^Test"))
for _standard, _column in (
    ("email", "email"), ("email_rfc5322", "email"), ("phone", "phone"), ("e164", "phone"),
    ("uuid", "code"), ("iban", "code"), ("postal_code", "code"), ("iso_3166", "segment"),
    ("iso_4217", "segment"), ("ssn", "phone"), ("credit_card", "phone"), ("date_iso", "code"),
    ("iso_8601", "code"), ("ip_address", "phone"),
):
    _conformity("CNF-standard" if _standard == "email" else f"CNF-standard.{_standard}",
                "standard", _column, {"standard_name": _standard},
                _matches(f"trim({_column})", P.STANDARDS[_standard]))
_conformity("CNF-standard.url", "standard", "url", {"standard_name": "url"},
            _matches("trim(url)", P.STANDARDS["url"]), dataset="pages")
_conformity("CNF-length", "length", "email", {"min_length": 14, "max_length": 16},
            "length(trim(email)) >= 14 AND length(trim(email)) <= 16")
_conformity("CNF-charset", "charset", "code", {"allowed_characters": "custom", "custom_charset": "A-Z0-9-"},
            _matches("trim(code)", "^[A-Z0-9-]*$"))
_conformity("CNF-charset.alpha", "charset", "segment", {"allowed_characters": "alpha"},
            _matches("trim(segment)", "^[A-Za-z]*$"))
for _name, _column, _ok in (("numeric", "digits", "c_custkey % 3 = 0"), ("alphanumeric", "word", "c_custkey % 3 = 0"),
                            ("ascii", "mixed", "c_custkey % 4 IN (0, 2)"), ("printable", "mixed", "c_custkey % 4 = 0")):
    _conformity(f"CNF-charset.{_name}", "charset", _column, {"allowed_characters": _name}, _ok, dataset="formats")
_conformity("CNF-case", "case", "segment", {"case_rule": "upper"}, "trim(segment) = upper(trim(segment))")
_conformity("CNF-case.lower", "case", "code", {"case_rule": "lower"}, "trim(code) = lower(trim(code))", "fail")
# Which spellings are title case follows from how the column is derived.
_conformity("CNF-case.title", "case", "title", {"case_rule": "title"}, "c_custkey % 5 IN (1, 3)")
_conformity("CNF-structural-json", "structural", "json", {"structural_format": "json"}, "json_valid(json)")
_conformity("CNF-structural-json.events", "structural", "props", {"structural_format": "json"},
            "json_valid(props)", dataset="events")
# Which documents are well formed follows from how the column is derived.
_conformity("CNF-structural-xml", "structural", "xml", {"structural_format": "xml"},
            "c_custkey % 6 <> 0 AND c_custkey % 29 <> 0")
_conformity("CNF-template", "template", "code", {"template": "AA-9999"},
            _matches("trim(code)", r"^[A-Z][A-Z]\-[0-9][0-9][0-9][0-9]$"))

# --- consistency ---


def _consistency(name, subtype, dataset, columns, params, ok, missing):
    for mode in ("fail", "skip", "pass"):
        verdict = f"coalesce(({ok}), TRUE)" if mode == "pass" else f"({ok})"
        row_query(name if mode == "fail" else f"{name}.{mode}", "consistency", subtype, dataset,
                  columns, {**params, "null_handling": mode}, verdict, f"NOT {verdict}",
                  where=f"NOT ({missing})" if mode == "skip" else None)


_consistency("CNS-intra", "intra_record", "ords", ["shipped_at"],
             {"rule_expression": "o_orderstatus <> 'F' OR shipped_at > o_orderdate"},
             "o_orderstatus <> 'F' OR shipped_at > o_orderdate", "shipped_at IS NULL")
row_query("CNS-intra.columns", "consistency", "intra_record", "ords", ["buyer"],
          {"reference_column": "o_custkey", "operator": "="}, "buyer = o_custkey",
          "NOT (buyer = o_custkey)")
_consistency("CNS-formula", "formula", "li", ["net"],
             {"expected_column": "net", "rule_expression": "net = l_extendedprice * (1 - l_discount)"},
             "abs(net - l_extendedprice * (1 - l_discount)) <= 0.01e0", "net IS NULL")
row_query("CNS-formula.percentage", "consistency", "formula", "ords", ["o_totalprice"],
          {"expected_column": "o_totalprice", "rule_expression": "booked",
           "tolerance_type": "percentage", "tolerance_value": 2.0},
          "abs(o_totalprice - booked) / nullif(abs(booked), 0) * 100 <= 2e0",
          "abs(o_totalprice - booked) / nullif(abs(booked), 0) * 100 > 2e0")
_consistency("CNS-temporal", "temporal", "ords", ["shipped_at"],
             {"comparison_column": "o_orderdate", "operator": "greater_equal"},
             "shipped_at >= o_orderdate", "(shipped_at IS NULL OR o_orderdate IS NULL)")
for _policy, _ok, _bad, _where in (
    ("ignore", "shipped_at >= o_orderdate", "NOT (shipped_at >= o_orderdate)", "shipped_at IS NOT NULL"),
    ("fail", "shipped_at >= o_orderdate", "shipped_at IS NULL OR NOT (shipped_at >= o_orderdate)", None),
    ("pass", "shipped_at IS NULL OR shipped_at >= o_orderdate",
     "shipped_at IS NOT NULL AND NOT (shipped_at >= o_orderdate)", None),
):
    row_query("CNS-doc-compare" if _policy == "ignore" else f"CNS-doc-compare.{_policy}",
              "consistency", "compare", "ords", ["shipped_at"],
              {"comparison_column": "o_orderdate", "operator": ">=", "null_policy": _policy},
              _ok, _bad, where=_where)

# --- timeliness ---


def _seconds(later: str, earlier: str) -> str:
    return f"(epoch_us({later}) - epoch_us({earlier}))"


_NOW = f"TIMESTAMP '{AS_OF}'"


def _timeliness(name, subtype, column, params, gap, missing, seconds):
    limit = seconds * 1_000_000
    for mode in ("fail", "skip", "pass"):
        passed, failed, where = {
            "fail": (f"{gap} <= {limit}", f"{gap} > {limit}", None),
            "skip": (f"{gap} <= {limit}", f"{gap} > {limit}", f"NOT ({missing})"),
            "pass": (f"{missing} OR {gap} <= {limit}", f"NOT ({missing}) AND {gap} > {limit}", None),
        }[mode]
        row_query(name if mode == "fail" else f"{name}.{mode}", "timeliness", subtype, "evt",
                  [column], {**params, "null_handling": mode}, passed, failed, where=where)


_timeliness("TML-recordage", "record_age", "loaded_at", {"max_age": "10d"},
            _seconds(_NOW, "loaded_at"), "loaded_at IS NULL", 864000)
_timeliness("TML-latency", "latency", "ts", {"comparison_timestamp": "loaded_at", "max_age": "1h"},
            f"abs({_seconds('loaded_at', 'ts')})", "(ts IS NULL OR loaded_at IS NULL)", 3600)
_timeliness("TML-procdelay", "processing_delay", "loaded_at",
            {"comparison_timestamp": "ts", "max_age": "45m"},
            f"abs({_seconds('ts', 'loaded_at')})", "(ts IS NULL OR loaded_at IS NULL)", 2700)
_MINUTES = "(hour(loaded_at) * 60 + minute(loaded_at))"
row_query("TML-window", "timeliness", "delivery_window", "evt", ["loaded_at"],
          {"delivery_window_start": "06:30", "delivery_window_end": "09:00"},
          f"{_MINUTES} BETWEEN 390 AND 540", f"NOT ({_MINUTES} BETWEEN 390 AND 540)")

# --- accuracy, generic ---
for _mode in ("fail", "skip", "pass"):
    _ok = "net = l_extendedprice * (1 - l_discount)"
    _passed, _failed, _where = {
        "fail": (_ok, f"NOT ({_ok})", None),
        "skip": (_ok, f"NOT ({_ok})", "net IS NOT NULL"),
        "pass": (f"net IS NULL OR {_ok}", f"net IS NOT NULL AND NOT ({_ok})", None),
    }[_mode]
    row_query("ACC-derived" if _mode == "fail" else f"ACC-derived.{_mode}", "accuracy",
              "derived_value", "li", ["net"],
              {"formula": "l_extendedprice * (1 - l_discount)", "null_handling": _mode},
              _passed, _failed, where=_where)
row_query("ACC-derived.percentage", "accuracy", "derived_value", "ords", ["o_totalprice"],
          {"formula": "booked", "tolerance_type": "percentage", "tolerance_value": 1.5},
          "abs(o_totalprice - booked) / nullif(abs(booked), 0) * 100 <= 1.5e0",
          "abs(o_totalprice - booked) / nullif(abs(booked), 0) * 100 > 1.5e0")
row_query("GEN-condition", "generic", "condition", "ords", [],
          {"expression": "booked > 50000 AND status = 'O'"}, "booked > 50000 AND status = 'O'",
          "NOT (booked > 50000 AND status = 'O')")
row_query("GEN-range-doc", "validity", "range", "li", ["l_discount"],
          {"min_value": 0.01, "max_value": 0.09}, "l_discount >= 0.01e0 AND l_discount <= 0.09e0",
          "NOT (l_discount >= 0.01e0 AND l_discount <= 0.09e0) OR l_discount IS NULL")
row_query("GEN-notnull-inverse", "completeness", "must_be_null", "ords", ["status"], {},
          "status IS NULL", "status IS NOT NULL")
