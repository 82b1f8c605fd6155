"""Relational building blocks that stay exact when one key holds much of the data."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KeyPairs = list[tuple[str, str]]

# Bytes of input files for each task of a shuffle that is dealt by size. Parquet grows many times in memory.
TASK_BYTES = 4 << 20
# Sizes from here on are Spark's placeholders for what it can't tell.
UNKNOWN_BYTES = 1 << 50
# Copies of a row are collapsed by at most so many tasks before they meet.
SPREAD = 8


def key_pairs(keys) -> KeyPairs:
    """Join keys as plain names or ``{"source": .., "target": ..}`` pairs."""
    return [(k["source"], k["target"]) if isinstance(k, dict) else (k, k) for k in keys]


def conjunction(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)


def count_rows(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def sum_where(cond: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")


def attach_one_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Add the columns of a frame that is one aggregate row by construction."""
    return df.crossJoin(F.broadcast(stats))


def small_enough_to_broadcast(df: DataFrame) -> bool:
    """Whether the planner's size estimate is below the session's broadcast limit."""
    spark = df.sparkSession
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return estimate <= limit


def tasks_by_size(*frames: DataFrame) -> int:
    """Tasks for a shuffle of the frames' rows: as many more as the files they read are larger."""
    spark, held = frames[0].sparkSession, 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        if max(sizes, default=0) >= UNKNOWN_BYTES:
            return int(spark.conf.get("spark.sql.shuffle.partitions"))
        held += sum(sizes)
    return max(spark.sparkContext.defaultParallelism, -(-held // TASK_BYTES))


def match_keys(left: DataFrame, right: DataFrame, how: str, names: list[str],
               null_safe: bool = False) -> DataFrame:
    """Join on ``__key`` columns that both sides carry under the same names."""
    renamed = right.select(*[F.col(n).alias(f"{n}__r") for n in names])
    tests = [
        F.col(n).eqNullSafe(F.col(f"{n}__r")) if null_safe else F.col(n) == F.col(f"{n}__r")
        for n in names
    ]
    return left.join(renamed, conjunction(tests), how)


def key_tallies(left: DataFrame, right: DataFrame, pairs: KeyPairs) -> DataFrame:
    """Rows per key on each side, without joining the sides.

    Both inputs are tagged, stacked and grouped on the keys, so copies of a key
    collapse before the shuffle and no pair of rows is ever formed.
    Columns: ``__k0..``, ``n_left``, ``n_right``, ``keyed`` (no key is NULL).
    """
    def side(df: DataFrame, which: int) -> DataFrame:
        cols = [F.col(p[which]).alias(f"__k{i}") for i, p in enumerate(pairs)]
        return df.select(*cols, F.lit(1 - which).alias("l"), F.lit(which).alias("r"))

    names = [f"__k{i}" for i in range(len(pairs))]
    return (
        side(left, 0).unionByName(side(right, 1))
        .groupBy(*names)
        .agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
        .withColumn("keyed", conjunction([F.col(n).isNotNull() for n in names]))
    )


def pair_counts(left: DataFrame, right: DataFrame, keys: KeyPairs,
                compared: KeyPairs) -> DataFrame:
    """Counts over the inner join of two frames, without forming the joined rows.

    One row: ``pairs`` (joined pairs), ``equal_pairs`` (all compared columns equal)
    and ``differing_pairs`` (some compared column certainly differs). A pair with
    a NULL among otherwise equal columns is in neither, as in SQL.

    Rows collapse to weighted cells of key, NULL pattern and values first. Per key the
    number of pairs is a product of two counts. Pairs that *may* agree have equal values
    wherever both sides are non-NULL, so a cell is counted once for each NULL pattern that
    the other side has *under the same key* (one, where keys are unique), with the values
    outside the shared pattern blanked. One or two columns have at most four patterns, all
    of which are faced without looking them up.

    Cells are counted behind the shuffle, in as many tasks as the input is large, so that the
    memory of a task doesn't follow the input; copies are spread over ``SPREAD`` tasks, and
    all that follows adds up weights, whichever cell they come from.
    """
    width, tasks = len(compared), tasks_by_size(left, right)
    full = (1 << width) - 1
    keys_out = [f"__k{i}" for i in range(len(keys))]
    vals = [f"__c{i}" for i in range(width)]

    def side(df: DataFrame, which: int) -> DataFrame:
        shaped = df.select(
            *[F.col(p[which]).alias(k) for p, k in zip(keys, keys_out)],
            *[F.col(p[which]).alias(v) for p, v in zip(compared, vals)],
        ).where(conjunction([F.col(k).isNotNull() for k in keys_out]))
        mask = sum((F.when(F.col(v).isNotNull(), 1 << i).otherwise(0)
                    for i, v in enumerate(vals)), F.lit(0))
        return shaped.withColumn("mask", mask)

    def cells_of(df: DataFrame, which: int) -> DataFrame:
        spread = side(df, which).withColumn("spread", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
        cell = [*keys_out, "mask", *vals, "spread"]
        return spread.repartition(tasks, *cell).groupBy(*cell).agg(F.count("*").alias("n"))

    def counted(df: DataFrame, which: int) -> DataFrame:
        one, zero = F.col("n"), F.lit(0).cast("long")
        return df.select(*keys_out, (zero if which else one).alias("l"), (one if which else zero).alias("r"))

    def facing(mine: DataFrame, theirs: DataFrame, which: int) -> DataFrame:
        if width <= 2:  # so few patterns that each cell faces them all
            spread = mine.withColumn("other", F.explode(F.array(*[F.lit(p) for p in range(full + 1)])))
        else:
            met = theirs.select(*keys_out, F.col("mask").alias("other")).repartition(tasks, *keys_out).distinct()
            spread = mine.repartition(tasks, *keys_out).join(met.hint("merge"), keys_out)
        shared = F.col("mask").bitwiseAND(F.col("other"))
        own, facing_ = ("mask", "other") if which == 0 else ("other", "mask")
        one, zero = F.col("n"), F.lit(0).cast("long")
        return spread.select(
            *keys_out, F.col(own).alias("ml"), F.col(facing_).alias("mr"),
            *[F.when(shared.bitwiseAND(1 << i) != 0, F.col(v)).alias(v) for i, v in enumerate(vals)],
            (zero if which else one).alias("l"), (one if which else zero).alias("r"))

    a, b = cells_of(left, 0), cells_of(right, 1)
    sums = [F.sum(c).alias(c) for c in ("l", "r")]
    product = F.col("l") * F.col("r")
    zero = F.lit(0)
    per_key = counted(a, 0).unionByName(counted(b, 1)).groupBy(*keys_out).agg(*sums)
    pairs = per_key.agg(F.coalesce(F.sum(product), zero).alias("pairs"))
    whole = (F.col("ml") == full) & (F.col("mr") == full)
    cell = [*keys_out, "ml", "mr", *vals]
    agreeing = facing(a, b, 0).unionByName(facing(b, a, 1)).repartition(tasks, *cell).groupBy(*cell).agg(*sums).agg(
        F.coalesce(F.sum(product), zero).alias("maybe"),
        F.coalesce(F.sum(F.when(whole, product)), zero).alias("equal_pairs"))
    return attach_one_row(pairs, agreeing).select(
        "pairs", "equal_pairs", (F.col("pairs") - F.col("maybe")).alias("differing_pairs"))
