"""What a check is, and what a check run returns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Tables = Mapping[str, DataFrame]

# Per dimension: the parameter that names the subtype, and the known subtypes.
SUBTYPES: dict[str, tuple[str, tuple[str, ...]]] = {
    "completeness": (
        "check_mode",
        ("null", "empty", "placeholder", "conditional", "multi_field", "population", "group",
         "not_null", "must_be_null"),
    ),
    "validity": (
        "validation_type",
        ("allowed_values", "range", "regex", "reference_lookup", "business_rule", "cross_field",
         "date_logic", "negative", "validator", "comparison", "custom_sql"),
    ),
    "uniqueness": (
        "uniqueness_mode",
        ("exact", "composite", "scoped", "cross_dataset", "fuzzy", "temporal"),
    ),
    "conformity": (
        "conformity_type",
        ("regex", "standard", "length", "charset", "case", "structural", "template"),
    ),
    "consistency": (
        "consistency_type",
        ("intra_record", "formula", "temporal", "inter_record", "cross_table", "aggregation",
         "compare"),
    ),
    "accuracy": (
        "accuracy_type",
        ("reference_comparison", "trusted_source", "tolerated_deviation", "statistical",
         "derived_value"),
    ),
    "timeliness": (
        "timeliness_type",
        ("freshness", "record_age", "latency", "processing_delay", "delivery_window",
         "heartbeat", "delay_metric"),
    ),
    "statistical": ("statistical_type", ("outliers",)),
    "reconciliation": (
        "reconciliation_type",
        ("record_count", "one_to_one", "aggregate", "field_level", "tolerance",
         "missing_extra"),
    ),
    "generic": ("generic_type", ("condition", "compound")),
}


@dataclass(frozen=True)
class Check:
    """One declarative check on one dataset.

    ``params`` holds the subtype's own settings; ``filter`` is a SQL boolean
    that restricts the rows before anything is counted.
    """

    check_id: str
    dimension: str
    subtype: str
    dataset: str
    columns: tuple[str, ...] = ()
    params: Mapping[str, Any] = field(default_factory=dict)
    filter: str | None = None
    threshold_pass: float = 100.0
    threshold_warn: float | None = None
    max_violations: int | None = None
    severity: str = "medium"

    def __post_init__(self) -> None:
        if self.dimension not in SUBTYPES:
            raise ValueError(f"unknown dimension {self.dimension!r}")
        if self.subtype not in SUBTYPES[self.dimension][1]:
            raise ValueError(f"unknown {self.dimension} subtype {self.subtype!r}")
        object.__setattr__(self, "columns", tuple(self.columns))

    @property
    def column(self) -> str:
        if not self.columns:
            raise ValueError(f"{self.check_id}: {self.subtype} needs a column")
        return self.columns[0]

    def param(self, name: str, default: Any = None) -> Any:
        value = self.params.get(name)
        return default if value is None else value

    def need(self, name: str) -> Any:
        value = self.params.get(name)
        if value is None or value == [] or value == "":
            raise ValueError(f"{self.check_id}: {self.dimension} {self.subtype} needs {name}")
        return value

    @classmethod
    def from_rule(cls, rule: Mapping[str, Any], check_id: str | None = None) -> Check:
        """Build a check from a platform-neutral rule document.

        ``entity`` is ``table.column`` (or ``table``); the subtype is named by
        the dimension's own parameter or inferred from the parameters present.
        """
        dimension = rule["dimension"]
        if dimension not in SUBTYPES:
            dimension = "generic"
        params = dict(rule.get("parameters") or {})
        for name, spellings in _PARAMETER_ALIASES.items():
            for spelling in spellings:
                if params.get(name) is None and params.get(spelling) is not None:
                    params[name] = params[spelling]
        table, _, column = str(rule.get("entity", "")).partition(".")
        columns = tuple(params.get("columns") or ([column] if column else []))
        if dimension == "generic" and rule.get("condition"):
            params.setdefault("expression", rule["condition"])
        named = SUBTYPES[dimension][0]
        subtype = params.get(named) or infer_subtype(dimension, params, columns)
        condition = params.get("filter_expression")
        if subtype == "business_rule" and not params.get("expression") and condition:
            # A rule with nothing but a filter states the condition rows must meet.
            params["expression"], condition = condition, None
        return cls(
            check_id=check_id or rule.get("rule_id") or rule.get("name") or f"{dimension}:{table}",
            dimension=dimension,
            subtype=subtype,
            dataset=rule.get("target_table") or params.get("source_dataset") or table,
            columns=columns,
            params=params,
            filter=condition,
            threshold_pass=float(params.get("threshold_pass", 100)),
            threshold_warn=params.get("threshold_warn"),
            max_violations=params.get("max_violations"),
            severity=rule.get("severity", "medium"),
        )


# Other spellings of parameters met in rule documents.
_PARAMETER_ALIASES: dict[str, tuple[str, ...]] = {
    "expression": ("business_rule_expression",),
    "regex_pattern": ("pattern",),
    "comparison_operator": ("date_operator",),
    "comparison_column": ("right_column", "start_column"),
    "allowed_values": ("values", "accepted_values"),
    "min_value": ("min",),
    "max_value": ("max",),
}

# Per dimension, in order, the parameters whose presence decides the subtype.
_SIGNALS: dict[str, list[tuple[str | tuple[str, ...], str]]] = {
    "validity": [
        ("regex_pattern", "regex"), ("min_value", "range"), ("max_value", "range"),
        ("allowed_values", "allowed_values"), ("reference_dataset", "reference_lookup"),
        ("reference_column", "reference_lookup"), ("expression", "business_rule"),
        ("validator", "validator"), ("filter_expression", "business_rule"),
    ],
    "uniqueness": [
        ("scope_columns", "scoped"), ("cross_dataset_name", "cross_dataset"),
        ("fuzzy_algorithm", "fuzzy"), ("temporal_window", "temporal"),
    ],
    "conformity": [
        ("regex_pattern", "regex"), ("standard_name", "standard"), ("min_length", "length"),
        ("max_length", "length"), ("allowed_characters", "charset"), ("case_rule", "case"),
        ("structural_format", "structural"),
    ],
    "consistency": [
        ("aggregation_function", "aggregation"), (("comparison_dataset", "join_keys"), "cross_table"),
        (("group_by_columns", "comparison_columns"), "inter_record"), ("comparison_column", "temporal"),
        ("expected_column", "formula"),
    ],
    "timeliness": [
        ("comparison_timestamp", "latency"), ("delivery_window_start", "delivery_window"),
        ("expected_frequency", "heartbeat"),
    ],
    "accuracy": [
        ("formula", "derived_value"), ("statistical_method", "statistical"),
        ("tolerance_value", "tolerated_deviation"),
    ],
}
_DEFAULT_SUBTYPE = {
    "completeness": "null",
    "uniqueness": "exact",
    "conformity": "regex",
    "consistency": "intra_record",
    "timeliness": "freshness",
    "accuracy": "reference_comparison",
    "statistical": "outliers",
    "generic": "condition",
}


def infer_subtype(dimension: str, params: Mapping[str, Any], columns: tuple[str, ...]) -> str:
    def present(name: str) -> bool:
        value = params.get(name)
        return value is not None and value is not False and value != "" and value != []

    for names, subtype in _SIGNALS.get(dimension, []):
        if all(present(n) for n in ((names,) if isinstance(names, str) else names)):
            return subtype
    if dimension == "uniqueness" and len(columns) > 1:
        return "composite"
    if dimension not in _DEFAULT_SUBTYPE:
        raise ValueError(f"cannot tell the {dimension} subtype from the parameters")
    return _DEFAULT_SUBTYPE[dimension]


@dataclass(frozen=True)
class RowRule:
    """A check that judges each row alone.

    ``passed`` and ``failed`` are separate three-valued columns: a row for which
    neither is true counts in the total only. ``population`` restricts the
    total; ``skipped`` rows stay in the total but leave the rate's denominator.
    """

    passed: Column
    failed: Column
    population: Column | None = None
    skipped: Column | None = None


@dataclass(frozen=True)
class TablePlan:
    """A check that needs a join, grouping or table statistic.

    ``counts`` is a one-row frame with ``total_rows, passed_rows, failed_rows,
    skipped_rows, evaluated_rows`` plus the check's own extra columns.
    ``violations`` builds the failing rows only when asked.
    """

    counts: DataFrame
    violations: Callable[[], DataFrame]
    extras: tuple[str, ...] = ()


SUMMARY_SCHEMA = T.StructType([
    T.StructField("check_id", T.StringType(), False),
    T.StructField("dimension", T.StringType(), False),
    T.StructField("subtype", T.StringType(), False),
    T.StructField("dataset", T.StringType(), False),
    T.StructField("total_rows", T.LongType()),
    T.StructField("passed_rows", T.LongType()),
    T.StructField("failed_rows", T.LongType()),
    T.StructField("skipped_rows", T.LongType()),
    T.StructField("undetermined_rows", T.LongType()),
    T.StructField("pass_rate", T.DoubleType()),
    T.StructField("check_status", T.StringType()),
])
SUMMARY_COLUMNS = tuple(SUMMARY_SCHEMA.names)

STATUS_RANK = {"PASS": 0, "WARN": 1, "FAIL": 2, "ERROR": 3}


def rate(passed: Column, evaluated: Column) -> Column:
    """Percentage passed; nothing evaluated counts as fully passed."""
    return F.when(evaluated == 0, F.lit(100.0)).otherwise(
        F.try_divide(F.lit(100.0) * passed, evaluated.cast("double"))
    )


def status(
    pass_rate: Column,
    threshold_pass: float,
    threshold_warn: float | None = None,
    failed: Column | None = None,
    max_violations: int | None = None,
) -> Column:
    outcome = F.when(pass_rate >= F.lit(float(threshold_pass)), F.lit("PASS"))
    if threshold_warn is not None:
        outcome = outcome.when(pass_rate >= F.lit(float(threshold_warn)), F.lit("WARN"))
    outcome = outcome.otherwise(F.lit("FAIL"))
    if max_violations is not None and failed is not None:
        outcome = F.when(failed > F.lit(max_violations), F.lit("FAIL")).otherwise(outcome)
    return outcome


def worst_status(col: Column) -> Column:
    """Aggregate: the worst of a group of statuses."""
    rank = F.max(
        F.when(col == "ERROR", 3).when(col == "FAIL", 2).when(col == "WARN", 1).otherwise(0)
    )
    return F.element_at(F.array(*[F.lit(s) for s in STATUS_RANK]), rank + 1)


def summarise(counts: DataFrame, check: Check, extras: tuple[str, ...] = ()) -> DataFrame:
    """Turn a one-row counts frame into the summary row of ``check``."""
    counted = counts.withColumn("pass_rate", rate(F.col("passed_rows"), F.col("evaluated_rows")))
    verdict = status(
        F.col("pass_rate"), check.threshold_pass, check.threshold_warn,
        F.col("failed_rows"), check.max_violations,
    )
    if "check_status" in counts.columns:
        verdict = F.col("check_status")
    return counted.select(
        F.lit(check.check_id).alias("check_id"),
        F.lit(check.dimension).alias("dimension"),
        F.lit(check.subtype).alias("subtype"),
        F.lit(check.dataset).alias("dataset"),
        *[F.col(c).cast("long").alias(c)
          for c in ("total_rows", "passed_rows", "failed_rows", "skipped_rows")],
        (F.col("total_rows") - F.col("passed_rows") - F.col("failed_rows")
         - F.col("skipped_rows")).cast("long").alias("undetermined_rows"),
        "pass_rate",
        verdict.alias("check_status"),
        *extras,
    )
