"""Checks on a stream that reads the events file to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.model import Check
from veritab.registry.base import AS_OF, Catalog, query, summary_sql
from veritab.sources.scratch import scratch_path
from veritab.streaming import checks as streaming
from veritab.streaming import sessions as keyless
from veritab.streaming import state as key_state

_BIG = Check("big", "validity", "range", "evt", ("value",), {"max_value": 100}, threshold_warn=80)
_SPREAD = Check("kind", "validity", "allowed_values", "evt", ("event_type",),
                {"allowed_values": ["view", "click", "purchase"]})


def event_stream(t: Catalog) -> DataFrame:
    spark = t["events"].sparkSession
    return spark.readStream.schema(t["events"].schema).option(
        "pathGlobFilter", "events.parquet").parquet(t._at[1])


def finished(t: Catalog, stream: DataFrame, label: str) -> DataFrame:
    """Append the stream to files until its input is used up, and read them."""
    spark = t["events"].sparkSession
    out = scratch_path(spark, label)
    started = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
               .option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start())
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _plain_sql(check, ok):
    return summary_sql(check, f"""SELECT count(*) AS total_rows, count(CASE WHEN {ok} THEN 1 END) AS passed_rows,
        count(CASE WHEN NOT ({ok}) THEN 1 END) AS failed_rows, 0 AS skipped_rows, count(*) AS evaluated_rows
        FROM events t""")


_OK = {"big": "value <= 100", "kind": "event_type IN ('view', 'click', 'purchase')"}


@query("STR-microbatch", _plain_sql(_BIG, _OK["big"]) + " UNION ALL " + _plain_sql(_SPREAD, _OK["kind"]))
def _microbatch(t):
    spark = t["events"].sparkSession
    out = scratch_path(spark, "batches")
    streaming.check_stream(event_stream(t), "evt", [_BIG, _SPREAD], out, f"{out}-state",
                           AS_OF).awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


def _window_sql(step: str, extra: str = "") -> str:
    return f"""
    SELECT 'big' AS check_id, epoch_us(a) AS start_us, count(*) AS total_rows,
           count(CASE WHEN value <= 100 THEN 1 END) AS passed_rows, count(CASE WHEN value > 100 THEN 1 END) AS failed_rows,
           100e0 * count(CASE WHEN value <= 100 THEN 1 END) / count(*) AS pass_rate,
           CASE WHEN count(CASE WHEN value > 100 THEN 1 END) = 0 THEN 'PASS'
                WHEN 100e0 * count(CASE WHEN value <= 100 THEN 1 END) / count(*) >= 80 THEN 'WARN' ELSE 'FAIL' END AS check_status
    FROM (SELECT *, {step} AS a FROM events) e {extra} GROUP BY a"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("check_id", F.unix_micros("window_start").alias("start_us"), "total_rows",
                     "passed_rows", "failed_rows", "pass_rate", "check_status")


_DAY = "date_trunc('day', ts)"


@query("STR-windowed.batch", _window_sql(_DAY))
def _windowed_batch(t):
    return _shown(streaming.windowed_counts(t["events"], _BIG, "ts", "1 day"))


# The stream emits a window once the watermark, two hours behind the latest event, has passed it.
@query("STR-windowed", _window_sql(
    _DAY, "WHERE a + INTERVAL '1' DAY <= (SELECT max(ts) - INTERVAL '2' HOUR FROM events)"))
def _windowed(t):
    counted = streaming.windowed_counts(event_stream(t), _BIG, "ts", "1 day", watermark="2 hours")
    return _shown(finished(t, counted, "windows"))


@query("STR-windowed.undated_stream", f"""
    SELECT epoch_us(a) AS start_us, count(*) AS total_rows, count(CASE WHEN value > 100 THEN 1 END) AS failed_rows
    FROM (SELECT value, CASE WHEN event_id % 4 > 0 THEN {_DAY} END AS a FROM events) e
    WHERE a IS NULL OR a + INTERVAL '1' DAY <= (SELECT max(ts) - INTERVAL '2' HOUR FROM events WHERE event_id % 4 > 0) GROUP BY a""")
def _undated_stream(t):
    """Finished windows of a stream, and its rows without a timestamp."""
    spark = t["events"].sparkSession
    stream = event_stream(t).withColumn("ts", F.when(F.col("event_id") % 4 > 0, F.col("ts")))
    counted = finished(t, streaming.windowed_counts(stream, _BIG, "ts", "1 day", watermark="2 hours"), "dated")
    out = scratch_path(spark, "undated")
    streaming.undated_counts(stream, _BIG, "ts", out, f"{out}-state").awaitTermination()
    undated = spark.read.schema("total_rows long, failed_rows long").parquet(out).agg(
        F.lit(None).cast("long").alias("start_us"), F.sum("total_rows").alias("total_rows"),
        F.sum("failed_rows").alias("failed_rows")).where("total_rows > 0")
    return _shown(counted).select("start_us", "total_rows", "failed_rows").unionByName(undated)


@query("STR-windowed.sliding", f"""
    SELECT start_us, count(*) AS total_rows, count(CASE WHEN value > 100 THEN 1 END) AS failed_rows
    FROM (SELECT value, unnest([epoch_us({_DAY}) + (CAST(floor(hour(ts) / 6) AS BIGINT) - k) * 21600000000::BIGINT
                                FOR k IN [0, 1, 2, 3]]) AS start_us FROM events) e GROUP BY 1""")
def _sliding(t):
    counted = streaming.windowed_counts(t["events"], _BIG, "ts", "1 day", slide="6 hours")
    return _shown(counted).select("start_us", "total_rows", "failed_rows")


@query("STR-dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def _dedupe(t):
    """The surviving keys; which of a key's rows survives is arrival order."""
    kept = streaming.first_seen(event_stream(t), ["user_id", "event_type"], "ts", "31 days")
    return finished(t, kept.select("user_id", "event_type"), "first")


# The same question as a uniqueness check of the whole table, asked batch by batch.
@query("STR-dedupe.all_members", """
    SELECT g.total_rows, g.failed_rows, g.duplicate_groups, g.max_group_size, m.rejected, m.rejected_ids
    FROM (SELECT sum(n) AS total_rows, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS failed_rows, count(CASE WHEN n > 1 THEN 1 END) AS duplicate_groups,
                 max(CASE WHEN n > 1 THEN n ELSE 0 END) AS max_group_size
          FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type) k) g
    CROSS JOIN (SELECT count(*) AS rejected, CAST(sum(event_id) AS BIGINT) AS rejected_ids
                FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) e WHERE n > 1) m""")
def _all_members(t):
    """Every member of a repeated key is rejected, in whatever batch it came."""
    spark = t["events"].sparkSession
    root = scratch_path(spark, "unique")
    t["events"].repartition(5, "event_id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(t["events"].schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    check = Check("once", "uniqueness", "composite", "events", ("user_id", "event_type"))
    key_state.unique_stream(stream, check, ["event_id"], f"{root}/out", f"{root}/state", f"{root}/checkpoint", 8).awaitTermination()
    rejected = spark.read.schema("event_id long").parquet(f"{root}/out").agg(
        F.count("*").alias("rejected"), F.sum("event_id").alias("rejected_ids"))
    return key_state.counts_so_far(spark, f"{root}/state").crossJoin(rejected)


_SESSIONS = """
    SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS beats FROM (
      SELECT *, sum(CASE WHEN fresh THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
        SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000, FALSE) AS fresh
        FROM events) a) b GROUP BY user_id, s"""


def _sessions(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.unix_micros("first_beat").alias("first_us"),
                     F.unix_micros("last_beat").alias("last_us"), "beats")


@query("STR-heartbeat", f"""SELECT * FROM ({_SESSIONS}) s
    WHERE last_us + 21600000000 <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events)""")
def _heartbeat(t):
    found = streaming.heartbeat_sessions(event_stream(t), "ts", "6h", ["user_id"], watermark="1 hour")
    return _sessions(finished(t, found, "beats"))


@query("STR-heartbeat.batch", _SESSIONS)
def _heartbeat_batch(t):
    return _sessions(streaming.heartbeat_sessions(t["events"], "ts", "6h", ["user_id"]))


@query("STR-heartbeat.missed", """
    SELECT user_id, epoch_us(before) AS last_us, epoch_us(ts) AS next_us, (epoch_us(ts) - epoch_us(before)) / 1e6 AS gap_seconds
    FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) a
    WHERE epoch_us(ts) - epoch_us(before) > 43200000000""")
def _missed(t):
    gaps = streaming.missed_heartbeats(t["events"], "ts", "12h", ["user_id"])
    return gaps.select("user_id", F.unix_micros("last_beat").alias("last_us"),
                       F.unix_micros("next_beat").alias("next_us"), "gap_seconds")


def _keyless_sql(rows: str, gap: int) -> str:
    return f"""
    SELECT epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS beats FROM (
      SELECT ts, sum(fresh) OVER (ORDER BY ts) AS s FROM (
        SELECT ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts)) < {gap} THEN 0 ELSE 1 END AS fresh FROM {rows}) a) b
    GROUP BY s"""


def _beats(df: DataFrame) -> DataFrame:
    return df.select(F.unix_micros("first_beat").alias("first_us"), F.unix_micros("last_beat").alias("last_us"), "beats")


@query("STR-heartbeat.keyless_batch", _keyless_sql("(SELECT ts FROM events WHERE event_id % 5 > 0) e", 600_000_000) + """
    UNION ALL SELECT NULL, NULL, count(*) FROM events WHERE event_id % 5 = 0 HAVING count(*) > 0""")
def _keyless_batch(t):
    df = t["events"].withColumn("ts", F.when(F.col("event_id") % 5 > 0, F.col("ts")))
    return _beats(keyless.keyless_sessions(df, "ts", "10m"))


# Closed sessions of the cells behind the watermark, and a row of the undated beats.
@query("STR-heartbeat.keyless", f"""
    WITH d AS (SELECT ts FROM events WHERE event_id % 5 > 0),
    done AS (SELECT ts FROM d WHERE (epoch_us(ts) // 600000000 + 1) * 600000000 <= (SELECT epoch_us(max(ts)) - 3600000000 FROM d)),
    s AS ({_keyless_sql("done", 600_000_000)})
    SELECT * FROM s WHERE first_us < (SELECT max(first_us) FROM s)
    UNION ALL SELECT NULL, NULL, count(*) FROM events WHERE event_id % 5 = 0""")
def _keyless(t):
    spark = t["events"].sparkSession
    root = scratch_path(spark, "sessions")
    stream = event_stream(t).withColumn("ts", F.when(F.col("event_id") % 5 > 0, F.col("ts")))
    keyless.keyless_session_stream(stream, "ts", "10m", "1 hour", f"{root}/out", f"{root}/state", f"{root}/checkpoint").awaitTermination()
    keyless.undated_beats(stream, "ts", f"{root}/undated", f"{root}/undated-checkpoint").awaitTermination()
    closed = spark.read.schema("first_beat timestamp, last_beat timestamp, beats long").parquet(f"{root}/out")
    undated = spark.read.schema("beats long").parquet(f"{root}/undated").agg(F.sum("beats").alias("beats"))
    none = F.lit(None).cast("long")
    return _beats(closed).unionByName(undated.select(none.alias("first_us"), none.alias("last_us"), "beats"))
