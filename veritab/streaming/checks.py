"""Checks on Structured Streaming input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritab.functions.predicates import duration_seconds, epoch_micros
from veritab.functions.relations import count_rows
from veritab.model import Check, Tables, rate, status
from veritab.operators.rowlevel import row_rule
from veritab.plans.suite import moment, run_suite


def check_stream(stream: DataFrame, dataset: str, checks: Sequence[Check], out: str,
                 checkpoint: str, as_of=None, references: Tables | None = None,
                 trigger: dict | None = None) -> StreamingQuery:
    """Run the suite on every micro-batch.

    Each batch writes its own ``batch_id`` folder by overwriting it, so a batch
    that is repeated after a failure leaves one copy of its results. The batch is
    kept while its suite runs, which reads it several times. Uniqueness is judged
    within a batch; repeats across batches are the business of ``first_seen``.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            tables = {**(references or {}), dataset: held}
            run_suite(tables, checks, as_of).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        finally:
            held.unpersist()

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def judged_rows(df: DataFrame, check: Check, ts: str, as_of=None) -> DataFrame:
    """Time and verdicts of the rows a row-level check is about."""
    rule = row_rule(check, moment(as_of))
    if check.filter:
        df = df.where(check.filter)
    if rule.population is not None:
        df = df.where(rule.population)
    skipped = rule.skipped if rule.skipped is not None else F.lit(False)
    return df.select(
        F.col(ts).cast("timestamp").alias("__ts"), rule.passed.alias("__ok"),
        rule.failed.alias("__bad"), skipped.alias("__skip"))


def verdict_counts() -> list[Column]:
    return [F.count("*").alias("total_rows"), count_rows(F.col("__ok")).alias("passed_rows"),
            count_rows(F.col("__bad")).alias("failed_rows"), count_rows(F.col("__skip")).alias("skipped_rows")]


def windowed_counts(df: DataFrame, check: Check, ts: str, window: str, slide: str | None = None,
                    watermark: str | None = None, as_of=None) -> DataFrame:
    """Counts of a row-level check per time window, batch or streaming.

    With a watermark late rows are dropped and finished windows leave the state. Rows
    without a timestamp are counted in a window of NULLs; on a stream, which has no such
    window, ``undated_counts`` counts them.
    """
    judged = judged_rows(df, check, ts, as_of)
    if watermark:
        judged = judged.withWatermark("__ts", watermark)
    counts = verdict_counts()
    grouped = judged.groupBy(F.window("__ts", window, slide or window).alias("w")).agg(*counts)
    if not df.isStreaming:
        no_window = F.lit(None).cast("struct<start:timestamp,end:timestamp>")
        undated = judged.where(F.col("__ts").isNull()).groupBy(no_window.alias("w")).agg(*counts)
        grouped = grouped.unionByName(undated)
    counted = grouped.withColumn(
        "pass_rate", rate(F.col("passed_rows"), F.col("total_rows") - F.col("skipped_rows")))
    return counted.select(
        F.lit(check.check_id).alias("check_id"), F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"), "total_rows", "passed_rows", "failed_rows",
        "skipped_rows", "pass_rate",
        status(F.col("pass_rate"), check.threshold_pass, check.threshold_warn).alias("check_status"))


def undated_counts(stream: DataFrame, check: Check, ts: str, out: str, checkpoint: str,
                   as_of=None, trigger: dict | None = None) -> StreamingQuery:
    """Counts of the rows without a timestamp, which no window of the stream holds.

    Each batch that has such rows writes one row of counts to its own ``batch_id`` folder
    by overwriting it; the sum over the folders is the count so far.
    """
    judged = judged_rows(stream, check, ts, as_of).where(F.col("__ts").isNull())

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.agg(*verdict_counts()).where("total_rows > 0").select(
            F.lit(check.check_id).alias("check_id"), "total_rows", "passed_rows", "failed_rows", "skipped_rows",
        ).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (judged.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def first_seen(stream: DataFrame, keys: Sequence[str], ts: str, window: str) -> DataFrame:
    """Drop repeats of a key. The first row seen stays, unlike in the batch check,

    which rejects every row of a repeated key.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, window)
    return timed.dropDuplicatesWithinWatermark(list(keys))


def heartbeat_sessions(df: DataFrame, ts: str, frequency: str, keys: Sequence[str] = (),
                       watermark: str | None = None) -> DataFrame:
    """Stretches of regular beats per key: each boundary is a missed heartbeat."""
    timed = df.withColumn("__ts", F.col(ts).cast("timestamp"))
    if watermark:
        timed = timed.withWatermark("__ts", watermark)
    gap = f"{duration_seconds(frequency)} seconds"
    return timed.groupBy(*keys, F.session_window("__ts", gap).alias("s")).agg(
        F.count("*").alias("beats"), F.max("__ts").alias("last_beat")).select(
        *keys, F.col("s.start").alias("first_beat"), "last_beat", "beats")


# Cells ordered in one group when looking for gaps.
CELLS_PER_BLOCK = 4096


def missed_heartbeats(df: DataFrame, ts: str, frequency: str, keys: Sequence[str] = ()) -> DataFrame:
    """Batch form: every gap longer than the frequency, per key.

    Rows first collapse to cells one frequency wide. Beats in a cell are close
    enough, so only the ends of neighbouring cells are compared. Cells are
    ordered in blocks; blocks hand on their last beat only, so neither a busy
    key nor a long history is ordered in one task.
    """
    width = duration_seconds(frequency) * 1_000_000
    keys = list(keys)
    at = F.col("__at")
    cell = ((at - F.pmod(at, F.lit(width))) / width).cast("long")
    cells = df.withColumn("__at", epoch_micros(F.col(ts))).where(at.isNotNull()).groupBy(
        *keys, cell.alias("cell")).agg(F.min("__at").alias("lo"), F.max("__at").alias("hi"))
    cells = cells.withColumn("block", F.floor(F.col("cell") / CELLS_PER_BLOCK))
    inside = cells.withColumn("before", F.lag("hi").over(
        Window.partitionBy(*keys, "block").orderBy("cell")))
    blocks = cells.groupBy(*keys, "block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    seams = blocks.withColumn("before", F.lag("hi").over(
        Window.partitionBy(*keys).orderBy("block")))
    steps = [*keys, "lo", "before"]
    gaps = inside.select(*steps).unionByName(seams.select(*steps)).where(
        F.col("lo") - F.col("before") > width)
    return gaps.select(
        *keys, F.timestamp_micros("before").alias("last_beat"), F.timestamp_micros("lo").alias("next_beat"),
        ((F.col("lo") - F.col("before")) / 1e6).alias("gap_seconds"))
