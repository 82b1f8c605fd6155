"""Checks that judge one row at a time; all of them can share a single scan."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions import patterns as P
from veritab.functions import predicates as X
from veritab.model import Check, RowRule


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


# --- null policies ---------------------------------------------------------

def count_nulls_as(check: Check, ok: Column, missing: Column, default: str = "fail") -> RowRule:
    """Validity policy: a NULL input fails, passes, or leaves the denominator."""
    mode = check.param("null_handling", default)
    if mode == "skip":
        return RowRule(~missing & ok, ~missing & ~ok, skipped=missing)
    if mode == "pass":
        return RowRule(missing | ok, ~missing & ~ok)
    if mode == "fail":
        return RowRule(ok, missing | ~ok)
    raise ValueError(f"{check.check_id}: unknown null_handling {mode!r}")


def drop_nulls_or(check: Check, ok: Column, missing: Column, default: str) -> RowRule:
    """Policy of the other dimensions: ``skip`` drops the row, ``pass`` accepts it,

    ``fail`` lets SQL's third truth value stand: in the total, in neither bucket.
    """
    mode = check.param("null_handling", default)
    if mode == "skip":
        return RowRule(ok, ~ok, population=~missing)
    if mode == "pass":
        return RowRule(missing | ok, ~missing & ~ok)
    if mode == "fail":
        return RowRule(ok, ~ok)
    raise ValueError(f"{check.check_id}: unknown null_handling {mode!r}")


def unknown_is(check: Check, ok: Column, missing: Column) -> RowRule:
    """Consistency policy: as above, but ``pass`` turns an unknown verdict true."""
    if check.param("null_handling", "fail") == "pass":
        ok = F.coalesce(ok, F.lit(True))
        return RowRule(ok, ~ok)
    return drop_nulls_or(check, ok, missing, "fail")


# --- completeness ----------------------------------------------------------

def _absent(check: Check) -> Column:
    """True where the value a completeness check looks for is not there."""
    mode = check.subtype
    if mode == "multi_field":
        if len(check.columns) < 2:
            raise ValueError(f"{check.check_id}: multi_field needs at least two columns")
        nulls = [F.col(c).isNull() for c in check.columns]
        return _all(nulls) if check.param("multi_field_mode", "all") == "any" else _any(nulls)
    if check.columns in ((), ("*",)):
        return F.lit(False)
    gaps = []
    for name in check.columns:
        col = F.col(name)
        gap = col.isNull()
        if mode in ("empty", "placeholder") or check.param("include_empty_strings", False):
            gap = gap | X.is_blank(col)
        if mode == "placeholder" and (words := check.param("placeholder_values", [])):
            listed = [w.strip().lower() for w in words]
            gap = gap | F.lower(F.trim(col.cast("string"))).isin(listed)
        if mode == "not_null":
            if check.param("treat_empty_string_as_null", True):
                gap = gap | (col.cast("string") == "")
            if check.param("treat_whitespace_as_null", False):
                gap = gap | (X.is_blank(col) & (col.cast("string") != ""))
        gaps.append(gap)
    return _any(gaps)


def _equals_literal(col: Column, value) -> Column:
    """Equality with a literal that takes the type of the column, as a quoted one does in SQL."""
    text, kind = col.cast("string"), F.typeof(col)
    if value is None:
        return F.lit(None).cast("boolean")
    words = str(value).lower() if isinstance(value, bool) else str(value)
    literal = F.lit(words)
    number = kind.isin("double", "float") | kind.startswith("decimal")
    whole = literal.try_cast("decimal(38,0)").cast("string")
    exact = F.coalesce(literal.try_cast("double") == whole.try_cast("double"), F.lit(False))
    return (F.when(kind == "boolean", col.cast("string").try_cast("boolean") == literal.try_cast("boolean"))
            .when(number, text.try_cast("double") == literal.try_cast("double"))
            .when(kind.isin("tinyint", "smallint", "int", "bigint"), exact & (text == whole))
            .when(kind.isin("date", "timestamp", "timestamp_ntz"),
                  text.try_cast("timestamp") == literal.try_cast("timestamp"))
            .otherwise(text == F.lit(str(value))))


def completeness(check: Check) -> RowRule:
    if check.subtype == "must_be_null":
        gap = F.col(check.column).isNotNull()
        return RowRule(~gap, gap)
    gap = F.coalesce(_absent(check), F.lit(False))
    population = None
    if check.subtype == "conditional":
        values = check.need("condition_value")
        values = list(values) if isinstance(values, (list, tuple)) else [values]
        population = _any([_equals_literal(F.col(check.need("condition_column")), v) for v in values])
    return RowRule(~gap, gap, population=population)


# --- validity --------------------------------------------------------------

def validity(check: Check) -> RowRule:
    kind = check.subtype
    if kind in ("business_rule", "negative"):
        return _expression_rule(check, kind)
    col = F.col(check.column)
    missing = col.isNull()
    if kind == "regex":
        pattern = P.java_regex(check.need("regex_pattern"), check.param("flags", ""))
        ok = col.rlike(pattern)
    elif kind == "validator":
        ok = col.rlike(P.VALIDATORS[check.need("validator")])
    elif kind == "range":
        low, high = check.params.get("min_value"), check.params.get("max_value")
        bounds = ([col >= F.lit(low)] if low is not None else []) + (
            [col <= F.lit(high)] if high is not None else [])
        if not bounds:
            raise ValueError(f"{check.check_id}: range needs min_value or max_value")
        ok = _all(bounds)
    elif kind == "allowed_values":
        values = check.need("allowed_values")
        if check.param("case_sensitive", True):
            ok = col.isin(list(values))
        else:
            ok = F.lower(col).isin([str(v).lower() for v in values])
    elif kind == "comparison":
        ok = X.compare(col, check.param("operator", "="), F.lit(check.need("value")))
    elif kind in ("cross_field", "date_logic"):
        other = F.col(check.need("comparison_column"))
        missing = missing | other.isNull()
        if kind == "date_logic":
            op = check.param("comparison_operator", "<=")
            ok = X.compare(col.try_cast("date"), op, other.try_cast("date"))
        else:
            ok = X.compare(col, check.param("comparison_operator", "="), other)
    else:
        raise ValueError(f"{check.check_id}: {kind} is not a row-level validity type")
    return count_nulls_as(check, ok, missing)


def _expression_rule(check: Check, kind: str) -> RowRule:
    if kind == "business_rule":
        ok = F.expr(check.need("expression"))
    elif "negative_pattern" in check.params:
        ok = ~P.negative_match(
            F.col(check.column), check.params["negative_pattern"],
            check.param("negative_match_mode", "regex"))
    else:
        ok = ~F.expr(check.need("negative_expression"))
    missing = F.col(check.column).isNull() if check.columns else F.lit(False)
    return count_nulls_as(check, ok, missing)


# --- conformity ------------------------------------------------------------

def conformity(check: Check) -> RowRule:
    raw = F.col(check.column)
    col = F.trim(raw.cast("string")) if check.param("trim_whitespace", True) else raw.cast("string")
    kind = check.subtype
    if kind == "regex":
        ok = col.rlike(P.java_regex(check.need("regex_pattern")))
    elif kind == "standard":
        ok = col.rlike(P.STANDARDS[check.need("standard_name")])
    elif kind == "template":
        ok = col.rlike(P.template_regex(check.need("template")))
    elif kind == "charset":
        ok = col.rlike(P.charset_regex(
            check.need("allowed_characters"), check.param("custom_charset", "")))
    elif kind == "length":
        low, high = check.params.get("min_length"), check.params.get("max_length")
        size = F.char_length(col)
        bounds = ([size >= F.lit(int(low))] if low is not None else []) + (
            [size <= F.lit(int(high))] if high is not None else [])
        if not bounds:
            raise ValueError(f"{check.check_id}: length needs min_length or max_length")
        ok = _all(bounds)
    elif kind == "case":
        recase = {"upper": F.upper, "lower": F.lower, "title": X.title_case}
        ok = col == recase[check.need("case_rule")](col)
    else:
        well_formed = {"json": X.is_json, "xml": X.is_xml}
        ok = well_formed[check.need("structural_format")](raw)
        # A broken document is a failure; only a NULL one is undecided.
        ok = F.when(raw.isNotNull(), ok)
    return drop_nulls_or(check, ok, raw.isNull(), "skip")


# --- consistency -----------------------------------------------------------

def _strip_left_side(formula: str, column: str) -> str:
    """``total = a * b`` written for column ``total`` means ``a * b``."""
    return re.sub(rf'^\s*["`]?\s*{re.escape(column)}\s*["`]?\s*=(?!=)\s*', "", formula).strip()


def consistency(check: Check) -> RowRule:
    kind = check.subtype
    if kind == "intra_record":
        if check.param("rule_expression"):
            ok = F.expr(check.params["rule_expression"])
        else:
            ok = X.compare(F.col(check.column), check.param("operator", "="),
                           F.col(check.need("reference_column")))
        missing = _any([F.col(c).isNull() for c in check.columns]) if check.columns else F.lit(False)
        return unknown_is(check, ok, missing)
    if kind == "formula":
        name = check.need("expected_column")
        formula = _strip_left_side(check.param("rule_expression") or check.need("formula"), name)
        ok = X.within_tolerance(F.col(name), F.expr(formula),
                                check.param("tolerance_type", "absolute"),
                                check.param("tolerance_value"))
        return unknown_is(check, ok, F.col(name).isNull())
    left, right = F.col(check.column), F.col(check.need("comparison_column"))
    op = X.canonical_operator(check.param("operator"), ">=", strict=kind == "compare")
    ok = X.compare(left, op, right)
    missing = left.isNull() | right.isNull()
    if kind == "compare":
        # Documented policy names: ignore leaves the row out, fail counts it.
        policy = check.param("null_policy", "ignore")
        if policy == "fail":
            return RowRule(~missing & ok, missing | ~ok)
        if policy == "pass":
            return RowRule(missing | ok, ~missing & ~ok)
        return RowRule(ok, ~ok, population=~missing)
    return unknown_is(check, ok, missing)


# --- timeliness ------------------------------------------------------------

def timeliness(check: Check, as_of: Column) -> RowRule:
    kind = check.subtype
    name = check.param("timestamp_column") or check.column
    ts = F.col(name)
    if kind == "delivery_window":
        start = X.minutes_of_day(check.need("delivery_window_start"))
        end = X.minutes_of_day(check.need("delivery_window_end"))
        minutes = F.hour(ts) * 60 + F.minute(ts)
        inside = minutes.between(start, end)
        return RowRule(inside, ~inside)
    limit = F.lit(X.duration_seconds(check.need("max_age")) * 1_000_000)
    if kind == "record_age":
        ok = X.epoch_micros(as_of) - X.epoch_micros(ts) <= limit
        return drop_nulls_or(check, ok, ts.isNull(), "fail")
    other = F.col(check.need("comparison_timestamp"))
    ok = F.abs(X.epoch_micros(other) - X.epoch_micros(ts)) <= limit
    return drop_nulls_or(check, ok, ts.isNull() | other.isNull(), "fail")


# --- accuracy, statistical, generic ----------------------------------------

def derived_value(check: Check) -> RowRule:
    col = F.col(check.column)
    ok = X.within_tolerance(col, F.expr(check.need("formula")),
                            check.param("tolerance_type", "none"), check.param("tolerance_value"))
    return drop_nulls_or(check, ok, col.isNull(), "fail")


def condition(check: Check) -> RowRule:
    ok = F.expr(check.need("expression"))
    return RowRule(ok, ~ok)


def compound(check: Check, as_of: Column) -> RowRule:
    """AND / OR of row-level members, judged row by row.

    A member's population and skips count as "not concerned": such a row passes
    that member, so the group judges every row of the table once. An unknown verdict
    stays unknown unless the other members decide.
    """
    logic = str(check.param("logic", "AND")).upper()
    verdicts = []
    for member in check.need("members"):
        rule = row_rule(member, as_of)
        bad = rule.failed
        scopes = [rule.population, None if rule.skipped is None else ~rule.skipped,
                  F.expr(member.filter) if member.filter else None]
        for scope in scopes:
            if scope is not None:
                bad = F.when(F.coalesce(scope, F.lit(False)), bad).otherwise(F.lit(False))
        verdicts.append(bad)
    if logic == "AND":
        bad = _any(verdicts)
    elif logic == "OR":
        bad = _all(verdicts)
    else:
        raise ValueError("compound logic is AND or OR; INDEPENDENT members are separate checks")
    return RowRule(~bad, bad)


_TABLE_LEVEL = {
    ("completeness", "group"), ("validity", "reference_lookup"), ("validity", "custom_sql"),
    ("consistency", "inter_record"), ("consistency", "cross_table"),
    ("consistency", "aggregation"), ("timeliness", "freshness"), ("timeliness", "heartbeat"),
    ("timeliness", "delay_metric"), ("accuracy", "reference_comparison"),
    ("accuracy", "trusted_source"), ("accuracy", "tolerated_deviation"),
    ("accuracy", "statistical"), ("statistical", "outliers"),
}


def is_row_level(check: Check) -> bool:
    if check.dimension in ("uniqueness", "reconciliation"):
        return False
    return (check.dimension, check.subtype) not in _TABLE_LEVEL


def row_rule(check: Check, as_of: Column) -> RowRule:
    """The row verdict of a row-level check."""
    if not is_row_level(check):
        raise ValueError(f"{check.check_id}: {check.dimension} {check.subtype} is not row-level")
    if check.dimension == "timeliness":
        return timeliness(check, as_of)
    if check.subtype == "compound":
        return compound(check, as_of)
    build = {
        "completeness": completeness,
        "validity": validity,
        "conformity": conformity,
        "consistency": consistency,
        "accuracy": derived_value,
        "generic": condition,
    }[check.dimension]
    return build(check)
