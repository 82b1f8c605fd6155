"""Evidence: the rows a check rejected, in one canonical shape, masked on request."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import predicates as X
from veritab.model import Check, Tables
from veritab.plans.suite import moment, violations

MASK = "[MASKED]"
# Classifications whose columns are masked.
MASKED_CLASSES = ("confidential", "restricted")

# What each dimension expects of a value, and why it was rejected. The most specific
# template counts: dimension and subtype with a named column, without one, then the dimension's own.
EXPECTED_TEXT = {
    "completeness": "NOT NULL",
    "validity": "valid per rule",
    "uniqueness": "unique",
    "conformity": "conforming to format",
    "reconciliation": "matched in target",
}
REASON_TEXT = {
    ("completeness", "null", True): "Column '{column}' is NULL",
    ("completeness", "null", False): "Value is NULL",
    ("completeness", "empty", True): "Column '{column}' is empty",
    ("completeness", "empty", False): "Value is empty",
    ("completeness", "placeholder", True): "Column '{column}' contains a placeholder value",
    ("completeness", "placeholder", False): "Placeholder value detected",
    ("completeness", None, True): "Completeness {subtype} check failed on column '{column}'",
    ("completeness", None, False): "Completeness {subtype} check failed",
    ("validity", None, None): "Value does not satisfy {subtype} validation",
    ("conformity", None, None): "Value does not conform to {subtype} format",
    ("uniqueness", None, None): "Duplicate value found",
    ("consistency", None, None): "Inconsistent value detected",
    ("timeliness", None, None): "Record exceeds maximum allowed age",
    ("accuracy", None, None): "Value deviates from reference",
    ("reconciliation", None, None): "Reconciliation mismatch",
    (None, None, None): "Data quality check failed",
}
OCCURRENCES_TEXT, AGE_TEXT, RECON_TEXT = " ({n} occurrences)", " ({n}s)", "Record {n}"


def _text(col: Column) -> Column:
    return col.cast("string")


def _filled(template: str, n: Column) -> Column:
    before, after = template.split("{n}")
    return F.concat(F.lit(before), _text(n), F.lit(after))


def _reason(check: Check, rows: DataFrame, age: Column | None) -> Column:
    """The template of the check, with what the row itself tells."""
    named = bool(check.columns)
    keys = [(check.dimension, check.subtype, named), (check.dimension, None, named),
            (check.dimension, None, None), (None, None, None)]
    template = next(REASON_TEXT[k] for k in keys if k in REASON_TEXT)
    reason = F.lit(template.format(column=check.columns[0] if named else "", subtype=check.subtype))
    if check.dimension == "timeliness" and age is not None:
        return F.concat(reason, F.coalesce(_filled(AGE_TEXT, age.cast("long")), F.lit("")))
    if check.dimension == "uniqueness" and "occurrences" in rows.columns:
        return F.concat(reason, _filled(OCCURRENCES_TEXT, F.col("occurrences")))
    if "recon_status" in rows.columns:
        return _filled(RECON_TEXT, F.col("recon_status"))
    return reason


def _uses(value, hidden: set[str]) -> bool:
    """Whether a rule's parameters name a hidden column, alone or within a formula."""
    if isinstance(value, str):
        return any(re.search(rf"(?<![A-Za-z0-9_]){re.escape(c)}(?![A-Za-z0-9_])", value) for c in hidden)
    if isinstance(value, Mapping):
        return any(_uses(x, hidden) for pair in value.items() for x in pair)
    return isinstance(value, (list, tuple, set)) and any(_uses(x, hidden) for x in value)


def _observation(check: Check, rows: DataFrame, now: Column) -> tuple[Column, Column, Column]:
    """Observed value, expected value and numeric deviation of a violating row."""
    none = F.lit(None).cast("string")
    no_number = F.lit(None).cast("double")
    value = F.col(check.columns[0]) if check.columns and check.columns[0] in rows.columns else none
    dimension = check.dimension
    if dimension == "completeness":
        return F.lit("NULL"), F.lit(EXPECTED_TEXT[dimension]), no_number
    if dimension in ("consistency", "accuracy"):
        expected = none
        if "reference_value" in rows.columns:
            expected = F.col("reference_value")
        elif "expected_value" in rows.columns:
            value, expected = F.col("computed_value"), F.col("expected_value")
        elif check.param("comparison_column") in rows.columns:
            expected = F.col(check.params["comparison_column"])
        elif check.subtype == "derived_value":
            expected = F.expr(check.params["formula"])
        return _text(value), _text(expected), (
            _text(value).try_cast("double") - _text(expected).try_cast("double"))
    if dimension == "timeliness":
        ts = F.col(check.param("timestamp_column") or check.column)
        other = check.param("comparison_timestamp")
        gap = X.epoch_micros(F.col(other) if other else now) - X.epoch_micros(ts)
        limit = check.param("max_age") or check.param("expected_frequency")
        return _text(ts), F.lit(limit).cast("string"), F.abs(gap) / 1e6
    if dimension == "reconciliation" and "recon_status" in rows.columns:
        return _text(value), F.lit(EXPECTED_TEXT[dimension]), no_number
    return _text(value), F.lit(EXPECTED_TEXT.get(dimension)).cast("string"), no_number


def mask(df: DataFrame, sensitivity: Mapping[str, str]) -> DataFrame:
    """Hide the values of sensitive columns; flag whether anything was hidden."""
    hidden = [c for c in df.columns if sensitivity.get(c) in MASKED_CLASSES]
    return df.withColumns({c: F.lit(MASK) for c in hidden}).withColumn(
        "masking_applied", F.lit(bool(hidden)))


def row_reference(df: DataFrame, key: str | None = None) -> Column:
    """The primary key of a row, else a hash of its content."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256)
    return F.coalesce(_text(F.col(key)), digest) if key else digest


def canonical_violations(
    tables: Tables, check: Check, as_of=None, key: str | None = None,
    sensitivity: Mapping[str, str] | None = None,
) -> DataFrame:
    """Violating rows in the canonical shape; the row itself as JSON in ``record``.

    A hidden column hides all that is derived from it: the other side's copy, the values a
    check computes or compares with, the deviation; a hidden key is shown as a hash.

    ``result_id`` is a content hash, so a re-run or a lost task yields the same id.
    """
    now = moment(as_of)
    rows = violations(tables, check, now)
    observed, expected, deviation = _observation(check, rows, now)
    hidden = {c for c, s in (sensitivity or {}).items() if s in MASKED_CLASSES}
    touched = _uses([*check.columns, check.params], hidden)
    given = tables[check.dataset].columns if check.dataset in tables else rows.columns

    def is_hidden(name: str) -> bool:
        """Own columns by name; those a check adds, when it reads a hidden one."""
        return name in hidden or (name not in given and name != "recon_status" and (
            touched or name.removeprefix("target_") in hidden))

    if touched:
        observed = F.when(observed.isNotNull(), F.lit(MASK))
        if check.dimension in ("consistency", "accuracy"):
            expected = F.when(expected.isNotNull(), F.lit(MASK))
        reason = _reason(check, rows, None)
        deviation = F.lit(None).cast("double")
    else:
        reason = _reason(check, rows, deviation)
    reference = row_reference(rows, key)
    if key in hidden:
        reference = F.sha2(F.concat_ws("|", F.lit(check.dataset), reference), 256)
    shown = [F.lit(MASK).alias(c) if is_hidden(c) else F.col(c) for c in rows.columns]
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit(check.check_id), reference), 256).alias("result_id"),
        F.lit(check.check_id).alias("check_id"),
        F.lit(check.dimension).alias("dimension"),
        F.lit(check.subtype).alias("subtype"),
        F.lit(check.dataset).alias("dataset"),
        F.lit(check.columns[0] if len(check.columns) == 1 else None).cast("string")
        .alias("column_name"),
        reference.alias("business_key"),
        F.lit("FAIL").alias("check_status"),
        observed.alias("observed_value"),
        expected.alias("expected_value"),
        deviation.alias("deviation"),
        reason.alias("issue_reason"),
        F.lit(check.severity).alias("severity"),
        F.to_json(F.struct(*shown)).alias("record"),
        F.lit(touched or key in hidden or any(is_hidden(c) for c in rows.columns)).alias("masking_applied"),
    )


def evidence_page(rows: DataFrame, order: Iterable[str], limit: int = 100) -> DataFrame:
    """The first rows in a fixed order, as reports show them."""
    return rows.orderBy(*order).limit(limit)


def run_on_sample(df: DataFrame, fraction: float, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Input of a sampled run: the rows are sampled, not the result.

    A hash of the key decides, so that a restart or another engine takes the same rows.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    place = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.where(place < int(fraction * 2**32))
