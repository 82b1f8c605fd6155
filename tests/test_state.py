"""Checks over the batches of a stream against the same checks on all rows."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest

from veritab import Check, run_check, violations
from veritab.sources.scratch import numbered_folders
from veritab.streaming import sessions
from veritab.streaming import state as key_state


@pytest.mark.parametrize("mode", ["exclude", "include"])
def test_unique_over_batches(spark, tmp_path, mode):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *"abcdefghij"]), rng.randrange(6) if rng.random() < 0.9 else None) for i in range(70)]
    check = Check("u", "uniqueness", "composite", "t", ("k", "s"), {"null_handling": mode})
    schema, out, state = "id int, k string, s int", str(tmp_path / "out"), str(tmp_path / "state")
    sizes, at = [3, 0, 20, 1, 30, 16], 0
    for batch_id, size in enumerate(sizes):
        part = spark.createDataFrame(rows[at: at + size], schema)
        at += size
        for _ in range(1 + batch_id % 2):  # some batches come twice
            key_state.merge_batch(part, batch_id, check, ["id"], out, state, buckets=4)
        seen = {"t": spark.createDataFrame(rows[:at], schema)}
        whole, counts = run_check(seen, check).first(), key_state.counts_so_far(spark, state).first()
        assert (counts.total_rows, counts.failed_rows, counts.duplicate_groups, counts.max_group_size) == (
            whole.total_rows, whole.failed_rows, whole.duplicate_groups, whole.max_group_size or 0)
        rejected = Counter(r.id for r in spark.read.schema("id int").parquet(out).collect())
        assert rejected == Counter(r.id for r in violations(seen, check).collect())


def test_only_touched_buckets_are_written(spark, tmp_path):
    check = Check("u", "uniqueness", "exact", "t", ("k",))
    state = str(tmp_path / "state")
    for batch_id, keys in enumerate([list(range(200)), [5]]):
        key_state.merge_batch(spark.createDataFrame([(k,) for k in keys], "k int"), batch_id, check, ["k"], str(tmp_path / "out"), state, 16)
    assert len(numbered_folders(spark, f"{state}/keys/version=0", "bucket")) == 16
    assert len(numbered_folders(spark, f"{state}/keys/version=1", "bucket")) == 1
    assert Counter(r.version for r in key_state.manifest(spark, state).collect()) == {0: 15, 1: 1}


def test_keyless_sessions_over_batches(spark, tmp_path, monkeypatch):
    """Rows come in files; late or repeated batches aside, closed and open sessions are those of all cells."""
    monkeypatch.setattr(sessions, "CELLS_PER_BLOCK", 3)
    rng, at, times = random.Random(3), datetime(2024, 1, 1), []
    for _ in range(120):
        at += timedelta(seconds=rng.choice([1, 20, 59, 60, 61, 400]))
        times.append(at)
    expected, gap = [], timedelta(seconds=60)
    for x in times:
        if expected and x - expected[-1][1] < gap:
            expected[-1] = (expected[-1][0], x, expected[-1][2] + 1)
        else:
            expected.append((x, x, 1))
    df = spark.createDataFrame([(x,) for x in times] + [(None,)] * 4, "ts timestamp")
    got = sorted(tuple(r) for r in sessions.keyless_sessions(df, "ts", "60s").where("first_beat is not null").collect())
    assert got == expected
    assert sessions.keyless_sessions(df, "ts", "60s").where("first_beat is null").first().beats == 4
    for k in range(6):  # in order of time, as the watermark would otherwise drop rows
        spark.createDataFrame([(x,) for x in times[20 * k: 20 * k + 20]], "ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / p) for p in ("out", "state", "checkpoint")]
    sessions.keyless_session_stream(stream, "ts", "60s", "0 seconds", *paths).awaitTermination()
    closed = sorted((r.first_beat, r.last_beat, r.beats) for r in spark.read.parquet(paths[0]).collect())
    assert closed == expected[: len(closed)] and len(closed) >= len(expected) - 3
