"""Pairs of values within tolerance under a key, counted without forming them.

For a right value the left values within tolerance are an interval of the sorted left values,
so their number is a difference of running sums. Running sums are taken over three levels of
digits of the values, so that no window holds more than the values of one narrow cell, and a key
with most of the rows is spread over many tasks. Rounding makes the ends of an interval uncertain
by some units in the last place; the few left values there are tested one by one.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions import predicates as X
from veritab.functions.relations import conjunction, sum_where

# Bits of the fraction of a double by level; the first level also has sign and exponent.
FIRST, SECOND, THIRD = 10, 21, 21
DIGITS = ["__d1", "__d2", "__d3"]
# Far above what rounding and casts to double can shift an interval's ends, in proportion and near zero.
SLACK, LEAST = 2.0 ** -46, 1e-322
LARGEST = sys.float_info.max


def with_digits(df: DataFrame, place: str) -> DataFrame:
    """``df`` with three integers that order finite doubles as the doubles do, compared from the first on.

    One step a projection, as each is used several times by the next.
    """
    x, size, e, m = F.col(place), F.abs(F.col(place)), F.col("__e"), F.col("__m")
    df = df.withColumn("__e", F.when(x != 0, F.floor(F.log2(size))).cast("int"))
    # Scaling by powers of two is exact; in two steps, as 2 to the exponent may be too small to divide by.
    half = F.shiftright(e, 1)
    df = df.withColumn("__m", size / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), e - half))
    # The logarithm may have been rounded across a power of two.
    df = df.withColumns({"__e": e + F.when(m >= 2, 1).when(m < 1, -1).otherwise(0),
                         "__m": F.when(m >= 2, m / 2).when(m < 1, m * 2).otherwise(m)})
    df = df.withColumn("__m", ((m - 1) * F.lit(2.0 ** (FIRST + SECOND + THIRD))).cast("long"))
    sign, zero = F.signum(x).cast("long"), F.lit(0).cast("long")
    parts = ((e + 1080).cast("long") * (1 << FIRST) + F.shiftright(m, SECOND + THIRD),
             F.shiftright(m, THIRD).bitwiseAND((1 << SECOND) - 1), m.bitwiseAND((1 << THIRD) - 1))
    return df.withColumns({name: F.coalesce(sign * d, zero) for name, d in zip(DIGITS, parts)}).drop("__e", "__m")


def running_sums(rows: DataFrame, names: list[str], place: str, tie: str, sums: list[str]) -> DataFrame:
    """``rows`` with the sums of ``sums`` over all rows of the same ``names`` up to and with the row, by (place, tie)."""
    rows = with_digits(rows, place)
    inner, outer = [*names, *DIGITS[:2]], [*names, DIGITS[0]]
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    cells = rows.groupBy(*inner).agg(*[F.sum(s).alias(s) for s in sums])
    wide = cells.groupBy(*outer).agg(*[F.sum(s).alias(s) for s in sums])
    over_wide = before(Window.partitionBy(*names).orderBy(DIGITS[0]))
    wide = wide.select(*outer, *[F.coalesce(F.sum(s).over(over_wide), zero).alias(f"{s}_wide") for s in sums])
    over_cells = before(Window.partitionBy(*outer).orderBy(DIGITS[1]))
    cells = cells.select(*inner, *[F.coalesce(F.sum(s).over(over_cells), zero).alias(f"{s}_cell") for s in sums])
    starts = cells.join(wide, outer).select(*inner, *[(F.col(f"{s}_wide") + F.col(f"{s}_cell")).alias(f"{s}_start") for s in sums])
    over_rows = upto(Window.partitionBy(*inner).orderBy(DIGITS[2], tie))
    inside = rows.withColumns({f"{s}_in": F.sum(s).over(over_rows) for s in sums})
    return inside.join(starts, inner).select(
        *[c for c in rows.columns if c not in (*DIGITS, *sums)], *sums,
        *[(F.col(f"{s}_start") + F.col(f"{s}_in")).alias(f"{s}_upto") for s in sums])


def equal_pairs(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    zero = F.lit(0).cast("long")
    both = a.select(*names, "v", F.col("n").alias("l"), zero.alias("r")).unionByName(
        b.select(*names, "v", zero.alias("l"), F.col("n").alias("r")))
    return both.groupBy(*names, "v").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).agg(
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).cast("long").alias("ok"))


def pairs_within(a: DataFrame, b: DataFrame, names: list[str], kind: str, value: float | None) -> DataFrame:
    """``ok``: how many pairs under the same key are within tolerance of the right value.

    Both frames hold weighted values: the keys ``names``, ``v`` (not NULL) and ``n``. NaN and
    infinities are within no tolerance.
    """
    finite = F.abs(F.col("v").cast("double")) < float("inf")
    if kind == "none":
        return equal_pairs(a, b, names)
    a, b = a.where(finite), b.where(finite)
    if kind == "absolute" and float(value) == 0:
        return equal_pairs(a, b, names)
    x, r = F.col("v").cast("double"), F.col("__r")
    reach = F.lit(float(value)) if kind == "absolute" else F.abs(x) * F.lit(float(value) / 100)
    reach = F.least(reach, F.lit(LARGEST))  # a larger gap is infinite
    slack = F.abs(x) * F.lit(SLACK) + F.abs(reach) * F.lit(SLACK) + F.lit(LEAST)
    b = b.withColumns({"__r": x, "__reach": reach, "__slack": slack})
    held = lambda end: F.greatest(F.least(end, F.lit(LARGEST)), F.lit(-LARGEST))
    sure, maybe = F.col("__reach") - F.col("__slack"), F.col("__reach") + F.col("__slack")
    # Ends of the intervals: before equal left values (0), or behind them (2). Left values stand between.
    ends = F.inline(F.array(*[F.struct(F.lit(end).alias("end"), held(at).alias("x"), F.lit(tie).alias("tie")) for end, at, tie in (
        ("maybe_from", r - maybe, 0), ("sure_from", r - sure, 0), ("sure_to", r + sure, 2), ("maybe_to", r + maybe, 2))]))
    zero, none = F.lit(0).cast("long"), F.lit(None)
    kinds = b.schema["v"].dataType
    points = a.select(*names, x.alias("x"), "n").groupBy(*names, "x").agg(F.sum("n").alias("n")).select(
        *names, none.cast(kinds).alias("v"), zero.alias("m"), none.cast("string").alias("end"), "x", F.lit(1).alias("tie"), "n",
        F.lit(1).cast("long").alias("one"))
    asked = b.select(*names, "v", F.col("n").alias("m"), ends).withColumns({"n": zero, "one": zero})
    ranked = running_sums(points.unionByName(asked), names, "x", "tie", ["n", "one"])
    at = lambda what, end: F.max(F.when(F.col("end") == end, F.col(what)))
    found = ranked.where(F.col("end").isNotNull()).groupBy(*names, "v", "m").agg(
        at("n_upto", "sure_from").alias("n_from"), at("n_upto", "sure_to").alias("n_to"),
        *[at("one_upto", end).alias(end) for end in ("maybe_from", "sure_from", "sure_to", "maybe_to")])
    # Left values between the certain interval and the widest one are tested, by their ordinal.
    nothing = F.array().cast("array<bigint>")
    empty = F.col("sure_from") > F.col("sure_to")
    some = lambda low, high: F.when(low < high, F.sequence(low + 1, high)).otherwise(nothing)
    unsure = F.when(empty, some(F.col("maybe_from"), F.col("maybe_to"))).otherwise(
        F.concat(some(F.col("maybe_from"), F.col("sure_from")), some(F.col("sure_to"), F.col("maybe_to"))))
    certain = F.greatest(F.col("n_to") - F.col("n_from"), zero) * F.col("m")
    tested = found.select(*[F.col(n).alias(f"{n}__r") for n in names], F.col("v").alias("__r0"), F.col("m").alias("__m"),
                          F.explode(unsure).alias("__at"))
    ordinals = running_sums(points.drop("v", "m", "end", "n"), names, "x", "tie", ["one"])
    left = a.select(*names, F.col("v").alias("__l0"), x.alias("x"), F.col("n").alias("__n")).join(
        ordinals.select(*names, "x", F.col("one_upto").alias("__nth")), [*names, "x"])
    on = conjunction([*[F.col(f"{n}__r") == F.col(n) for n in names], F.col("__at") == F.col("__nth")])
    within = X.within_tolerance(F.col("__l0"), F.col("__r0"), kind, value)
    edge = tested.join(left, on).agg(sum_where(within, F.col("__n") * F.col("__m")).alias("edge"))
    sure_part = found.agg(F.coalesce(F.sum(certain), zero).cast("long").alias("sure"))
    return sure_part.crossJoin(F.broadcast(edge)).select((F.col("sure") + F.col("edge")).alias("ok"))
