"""Exact order statistics in bounded memory.

The built-in exact percentile merges every distinct value into one buffer. Here
the wanted rank is narrowed by histograms instead. A first pass counts values in
slots of fixed relative width, which needs no knowledge of the range; a second
one cuts the slot that holds the rank into equal steps; the last pass orders the
values left in that step. Every pass is a column scan with map-side aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS_PER_OCTAVE = 512
STEPS = 65536
_TARGET = ("cid", "ask", "rank", "total")


def _stack(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    if len(values) == 1:
        long = df.select(F.lit(0).alias("cid"), values[0].cast("double").alias("v"))
    else:
        cells = F.array(*[
            F.struct(F.lit(i).alias("cid"), v.cast("double").alias("v"))
            for i, v in enumerate(values)
        ])
        long = df.select(F.inline(cells))
    return long.where(F.col("v").isNotNull())


def _relative_slot(v: Column) -> Column:
    """Integer that never decreases with the value; NaN is the greatest, as everywhere in Spark."""
    size = F.least(F.abs(v), F.lit(1.7e308))
    # The offset keeps the exponent of the smallest number positive.
    scaled = F.floor(F.log2(size) * SLOTS_PER_OCTAVE) + F.lit(1 << 20)
    return F.when(F.isnan(v), F.lit(1 << 40)).when(v == 0, F.lit(0).cast("long")).when(
        v > 0, scaled).otherwise(-scaled)


def _first_targets(long: DataFrame, ranks: Sequence[Column]) -> DataFrame:
    """Per wanted rank: the slot that holds it, and how many values lie below."""
    slots = long.groupBy("cid", _relative_slot(F.col("v")).alias("slot")).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    column = Window.partitionBy("cid")
    counted = slots.withColumns({
        "total": F.sum("n").over(column), "upto": F.sum("n").over(column.orderBy("slot"))})
    asks = F.array(*[
        F.struct(F.lit(i).alias("ask"), r.cast("long").alias("rank")) for i, r in enumerate(ranks)])
    asked = counted.withColumn("below", F.col("upto") - F.col("n")).select(
        "cid", "total", "below", "upto", "lo", "hi", F.inline(asks))
    return asked.where(F.col("rank").between(F.col("below"), F.col("upto") - 1)).drop("upto")


def _candidates(long: DataFrame, targets: DataFrame) -> DataFrame:
    """Values that can still be the wanted ones. The broadcast side is bounded:

    one row per wanted rank, so a handful per column.
    """
    return long.join(F.broadcast(targets), "cid").where(
        F.col("v").between(F.col("lo"), F.col("hi")))


def _holding_rank(counted: DataFrame, order: str) -> DataFrame:
    """Of ordered, counted cells keep the one the rank falls into."""
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*_TARGET).orderBy(order))
    return (
        counted.withColumn("upto", upto)
        .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        .withColumn("below", F.col("upto") - F.col("n"))
    )


def values_at_ranks(df: DataFrame, values: Sequence[Column],
                    ranks: Sequence[Column]) -> DataFrame:
    """``cid, ask, rank, total, value`` for every column and zero-based rank.

    A rank is an expression over ``total``, the number of values of the column;
    ``cid`` and ``ask`` are positions in ``values`` and ``ranks``. Columns
    without values give no row.
    """
    long = _stack(df, values)
    targets = _first_targets(long, ranks)
    span = F.col("hi") - F.col("lo")
    step = F.when((span > 0) & (span < float("inf")), F.least(
        F.floor((F.col("v") - F.col("lo")) / span * STEPS), F.lit(STEPS - 1))).otherwise(0)
    steps = _candidates(long, targets).groupBy(*_TARGET, "below", step.alias("step")).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    targets = _holding_rank(steps, "step").select(*_TARGET, "below", "lo", "hi")
    left = _candidates(long, targets).groupBy(*_TARGET, "below", "v").agg(F.count("*").alias("n"))
    return _holding_rank(left, "v").select(*_TARGET, F.col("v").alias("value"))


def quantile_ranks(probabilities: Sequence[float]) -> list[Column]:
    """The lower and upper neighbour of every quantile position, in pairs."""
    ranks = []
    for p in probabilities:
        at = F.lit(float(p)) * (F.col("total") - 1)
        ranks += [F.floor(at), F.ceil(at)]
    return ranks


def interpolated(p: float, low: Column, high: Column) -> Column:
    """Quantile between its two neighbours; ``total`` must be in scope."""
    at = F.lit(float(p)) * (F.col("total") - 1)
    return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))


def exact_quantiles(df: DataFrame, values: Sequence[Column],
                    probabilities: Sequence[float]) -> DataFrame:
    """Interpolated quantiles: one row ``cid, q0, q1, ..`` per column with values."""
    found = values_at_ranks(df, values, quantile_ranks(probabilities))
    picked = found.groupBy("cid", "total").agg(*[
        F.max(F.when(F.col("ask") == i, F.col("value"))).alias(f"v{i}")
        for i in range(2 * len(probabilities))])
    return picked.select("cid", *[
        interpolated(p, F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")).alias(f"q{i}")
        for i, p in enumerate(probabilities)])


def quantile_row(df: DataFrame, value: Column, probabilities: Sequence[float]) -> DataFrame:
    """The quantiles of one column as one row ``q0, q1, ..``; NULLs when empty."""
    return exact_quantiles(df, [value], probabilities).agg(
        *[F.max(f"q{i}").alias(f"q{i}") for i in range(len(probabilities))])
