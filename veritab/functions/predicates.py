"""Column builders shared by the checks: comparison, tolerance, null policy."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings per canonical comparison operator.
OPERATOR_ALIASES: dict[str, tuple[str, ...]] = {
    "=": ("=", "==", "eq", "equal", "equals", "same_day"),
    "!=": ("!=", "<>", "ne", "not_equal", "not_equals"),
    "<": ("<", "lt", "less", "less_than", "before"),
    "<=": ("<=", "lte", "less_equal", "less_than_or_equal", "on_or_before", "not_after", "within"),
    ">": (">", "gt", "greater", "greater_than", "after"),
    ">=": (">=", "gte", "greater_equal", "greater_than_or_equal", "on_or_after", "not_before"),
}

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}

INVERSE = {"=": "!=", "!=": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def canonical_operator(raw: str | None, default: str = "=", strict: bool = True) -> str:
    """Map any accepted spelling to one of ``= != < <= > >=``.

    An unknown spelling raises, or falls back to ``default`` when not strict.
    """
    if raw is None:
        return default
    word = str(raw).strip().lower()
    for canonical, spellings in OPERATOR_ALIASES.items():
        if word in spellings:
            return canonical
    if strict:
        raise ValueError(f"unknown comparison operator {raw!r}")
    return default


def compare(left: Column, op: str, right: Column) -> Column:
    return _COMPARE[canonical_operator(op)](left, right)


def within_tolerance(
    actual: Column, expected: Column, kind: str = "none", value: float | None = None
) -> Column:
    """Three-valued match of two numbers.

    ``percentage`` against an expected 0 is undefined and yields NULL, so such
    a row is neither a match nor a mismatch.
    """
    if kind == "none":
        return actual == expected
    gap = F.abs(actual - expected)
    if kind == "absolute":
        return gap <= F.lit(0.01 if value is None else value)
    if kind == "percentage":
        base = F.nullif(F.abs(expected), F.lit(0))
        return gap / base * F.lit(100) <= F.lit(1.0 if value is None else value)
    raise ValueError(f"unknown tolerance type {kind!r}")


_DURATION = re.compile(r"^(\d+(?:\.\d+)?)\s*([smhdw])$", re.IGNORECASE)
_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def duration_seconds(value: str | float) -> int:
    """``90``, ``"90"``, ``"30m"``, ``"1.5h"``, ``"7d"``, ``"2w"`` as whole seconds."""
    text = str(value).strip()
    if match := _DURATION.match(text):
        return int(float(match[1]) * _UNIT_SECONDS[match[2].lower()])
    try:
        return int(float(text))
    except ValueError:
        raise ValueError(f"not a duration: {value!r}") from None


def minutes_of_day(value: str) -> int:
    """``HH:MM`` as minutes after midnight."""
    match = re.match(r"^(\d{1,2}):(\d{2})$", value.strip())
    if not match or int(match[1]) > 23 or int(match[2]) > 59:
        raise ValueError(f"not a time of day: {value!r}")
    return int(match[1]) * 60 + int(match[2])


def epoch_micros(col: Column) -> Column:
    """Microseconds since the epoch, read in the session time zone."""
    return F.unix_micros(col.cast("timestamp"))


def is_blank(col: Column) -> Column:
    """Empty after stripping spaces (tabs and newlines are content)."""
    return F.trim(col.cast("string")) == F.lit("")


def title_case(col: Column) -> Column:
    """Every run of letters and digits starts upper case and goes on lower case.

    ``initcap`` breaks words at spaces only; here any character that is neither
    letter nor digit ends a word, so ``mary-ann o'neil`` is ``Mary-Ann O'Neil``.
    """
    chars = F.split(F.lower(col), "")
    previous = F.concat(F.array(F.lit(" ")), chars)
    cased = F.zip_with(
        chars,
        F.slice(previous, F.lit(1), F.size(chars)),
        lambda ch, before: F.when(before.rlike(r"[\p{L}\p{N}]"), ch).otherwise(F.upper(ch)),
    )
    return F.array_join(cased, "")


def is_json(col: Column) -> Column:
    return F.try_parse_json(col).isNotNull()


def is_xml(col: Column) -> Column:
    """Well-formed XML document: the permissive reader leaves no corrupt record."""
    parsed = F.from_xml(
        col,
        "_corrupt string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    return parsed["_corrupt"].isNull() & (F.trim(col) != F.lit(""))
