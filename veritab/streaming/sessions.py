"""Sessions of a whole table or stream without keys, in two levels.

Rows first collapse to cells one gap wide, whose beats are close enough, with sums added before the
shuffle. Cells are ordered in blocks; a block hands on its last beat and its number of sessions, so
no task has all cells. On a stream the watermark releases finished cells, and the session that is
still open is carried from batch to batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritab.functions.predicates import duration_seconds, epoch_micros
from veritab.sources.scratch import numbered_folders
from veritab.streaming.checks import CELLS_PER_BLOCK

PIECES = "lo long, hi long, n long"


def joined_pieces(pieces: DataFrame, width: int) -> DataFrame:
    """Sessions ``lo, hi, n`` of pieces that don't overlap: a gap of ``width`` microseconds or more parts them."""
    blocked = pieces.withColumn("block", F.floor(F.col("lo") / (width * CELLS_PER_BLOCK)))
    inside = Window.partitionBy("block").orderBy("lo")
    ends = blocked.groupBy("block").agg(F.max("hi").alias("last"))
    before = ends.select("block", F.lag("last").over(Window.orderBy("block")).alias("last_before"))
    steps = blocked.join(before, "block").withColumn(
        "before", F.coalesce(F.lag("hi").over(inside), F.col("last_before")))
    steps = steps.withColumn("fresh", F.coalesce(F.col("lo") - F.col("before") >= width, F.lit(True)).cast("long"))
    own = steps.withColumn("nth", F.sum("fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    upto = steps.groupBy("block").agg(F.sum("fresh").alias("sessions"))
    offsets = upto.select("block", F.coalesce(F.sum("sessions").over(
        Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return (own.join(offsets, "block").groupBy((F.col("nth") + F.col("offset")).alias("session"))
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).drop("session"))


def shown(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.timestamp_micros("lo").alias("first_beat"), F.timestamp_micros("hi").alias("last_beat"),
                           F.col("n").alias("beats"))


def session_pieces(df: DataFrame, ts: str, width: int) -> DataFrame:
    at = F.col("__at")
    dated = df.select(epoch_micros(F.col(ts)).alias("__at")).where(at.isNotNull())
    return dated.groupBy(F.floor(at / width).alias("cell")).agg(
        F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n")).drop("cell")


def keyless_sessions(df: DataFrame, ts: str, frequency: str) -> DataFrame:
    """Batch form: stretches of regular beats; rows without a timestamp are one row of NULL times, if there are any."""
    width = duration_seconds(frequency) * 1_000_000
    none = F.lit(None).cast("timestamp")
    undated = df.where(F.col(ts).cast("timestamp").isNull()).agg(F.count("*").alias("beats")).where("beats > 0")
    return shown(joined_pieces(session_pieces(df, ts, width), width)).unionByName(
        undated.select(none.alias("first_beat"), none.alias("last_beat"), "beats"))


def keyless_session_stream(stream: DataFrame, ts: str, frequency: str, watermark: str, out: str, state: str,
                           checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Closed sessions, written to ``out/batch_id=N``; the open one is kept in ``state/batch_id=N``.

    Repeating a batch overwrites both folders from the state before it.
    """
    width = duration_seconds(frequency) * 1_000_000
    timed = stream.select(F.col(ts).cast("timestamp").alias("__ts")).where(F.col("__ts").isNotNull())
    cells = timed.withWatermark("__ts", watermark).groupBy(F.window("__ts", f"{duration_seconds(frequency)} seconds")).agg(
        F.min(F.unix_micros("__ts")).alias("lo"), F.max(F.unix_micros("__ts")).alias("hi"), F.count("*").alias("n"))

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = [b for b in numbered_folders(spark, state, "batch_id") if b < batch_id]
        pieces = batch.select("lo", "hi", "n")
        if known:
            pieces = pieces.unionByName(spark.read.schema(PIECES).parquet(f"{state}/batch_id={known[-1]}"))
        sessions = joined_pieces(pieces, width).persist()
        try:
            open_from = sessions.agg(F.max("lo")).first()[0]
            still_open = F.col("lo") == F.lit(open_from)
            shown(sessions.where(~still_open)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
            sessions.where(still_open).coalesce(1).write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")
        finally:
            sessions.unpersist()

    return (cells.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def undated_beats(stream: DataFrame, ts: str, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """How many rows of each batch have no timestamp: ``beats`` in ``out/batch_id=N``, to be summed up."""
    undated = stream.where(F.col(ts).cast("timestamp").isNull())

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.agg(F.count("*").alias("beats")).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (undated.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
