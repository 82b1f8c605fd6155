"""Files in, files out, profiles and streams."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from veritab import Check, run_suite, violations
from veritab.plans import evidence, profile, sketches
from veritab.sources import readers, sinks
from veritab.sources.scratch import scratch_path
from veritab.streaming import checks as streaming


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv(spark, tmp_path, sep):
    lines = [sep.join(x) for x in [("id", "name", "when", "ok", "x"), ("1", " Ann ", "2024-01-02", "true", "1.5"),
                                   ("2", "   ", "2024-01-03 10:00:00", "0", "2"), ("3", '"a, ""b""; |c"', "", "FALSE", ""),
                                   ("4", "too", "2024-01-03", "1", "1", "long"), ("5", "short")]]
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines) + "\n")
    df = readers.read_csv(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "string", "timestamp", "boolean", "double"]
    rows = {r.id: r for r in df.collect()}
    assert set(rows) == {1, 2, 3, 5}
    assert (rows[1].name, rows[2].name, rows[3].name) == ("Ann", None, 'a, "b"; |c')
    assert (rows[2].ok, rows[3].ok, rows[3].when, rows[5].ok) == (False, False, None, None)


def test_json(spark, tmp_path):
    rows = [{"b": 1, "a": "x"}, {"b": 2, "a": None}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "o.json").write_text(json.dumps({"meta": {"n": 2}, "z_rows": rows, "other": [{"q": 1}]}, indent=1))
    (tmp_path / "one.json").write_text(json.dumps({"b": 7, "a": "solo"}))
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    for name in ("a.json", "o.json", "l.jsonl"):
        got = readers.read_json(spark, str(tmp_path / name))
        assert sorted((r.b, r.a) for r in got.select("b", "a").collect()) == [(1, "x"), (2, None)]
    assert readers.read_json(spark, str(tmp_path / "one.json")).first().a == "solo"


def test_jdbc_settings(spark):
    url, properties = readers.jdbc_target("postgresql", "h", 5432, "d")
    assert (url, properties["driver"]) == ("jdbc:postgresql://h:5432/d", "org.postgresql.Driver")
    with pytest.raises(ValueError):
        readers.jdbc_target("sheet", "h", 1, "d")
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, url, "t", partition_column="id", lower=1)
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, url, "t")
    with pytest.raises(ValueError):
        readers.read_files(spark, "s3a://bucket/data")


def test_exports_and_retention(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", None, 5), ("-x", "@y", -5), ("ok", "+z", 0)], "a string, b string, n int")
    got = sinks.export_frame(df).collect()
    assert [tuple(r) for r in got] == [("'=1+1", "", "5"), ("'-x", "'@y", "'-5"), ("ok", "'+z", "0")]
    path = str(tmp_path / "results")
    for day in (date(2024, 1, 1), date(2024, 3, 1)):
        sinks.append_results(df, path, day)
        sinks.append_results(df, path, day)
    assert sinks.drop_expired(spark, path, date(2024, 4, 15), 60) == ["2024-01-01"]
    left = spark.read.parquet(path)
    assert left.count() == 6 and {r[0] for r in left.select("run_date").distinct().collect()} == {date(2024, 3, 1)}
    sinks.write_evidence(df, str(tmp_path / "e"), {"a": "restricted"}, limit=2, order=["n"])
    with pytest.raises(ValueError):
        sinks.write_evidence(df, str(tmp_path / "f"), limit=2)
    docs = spark.read.json(str(tmp_path / "e")).collect()
    assert len(docs) == 2 and all(d.a == "[MASKED]" and d.masking_applied for d in docs)


def test_masked_record_hides_the_value_everywhere(spark):
    t = {"t": spark.createDataFrame([(1, "secret"), (2, "a@b.de")], "id int, mail string")}
    check = Check("m", "validity", "validator", "t", ("mail",), {"validator": "email"})
    row = evidence.canonical_violations(t, check, key="id", sensitivity={"mail": "confidential"}).first()
    assert "secret" not in str(row.asDict()) and row.masking_applied and row.business_key == "1"
    plain = evidence.canonical_violations(t, check).first()
    assert plain.observed_value == "secret" and len(plain.result_id) == 64
    assert plain.result_id == evidence.canonical_violations(t, check).first().result_id


def test_profile(spark):
    rows = [(i, f"v{i % 3}", None if i < 6 else 1.5 * i, None, i % 2 == 0) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, s string, x double, e string, b boolean").withColumn(
        "d", F.expr("date_add(date'2024-01-01', id)"))
    got = {r.column_name: r for r in profile.profile(df).collect()}
    assert got["id"].suggested_checks == ["not_null_check", "unique_check", "range_check", "positive_check"]
    assert got["x"].suggested_checks == ["high_null_rate", "null_check", "range_check", "positive_check"]
    assert got["e"].suggested_checks == ["null_check", "completeness_check"]
    assert got["s"].suggested_checks == ["not_null_check", "length_check", "allowed_values_check"]
    assert got["d"].suggested_checks[-2:] == ["date_range_check", "future_date_check"]
    assert (got["x"].median, got["id"].unique_count, got["s"].avg_length) == (11.25, 10, 2.0)
    assert [(v.value, v.value_count) for v in got["s"].top_values] == [("v0", 4), ("v1", 3), ("v2", 3)]
    assert got["s"].distinct_values == ["v0", "v1", "v2"]
    rough = {r.column_name: r.unique_count for r in profile.profile_basic(df, relative_error=0.02).collect()}
    assert rough["id"] == 10 and rough["s"] == 3 and rough["e"] == 0


def test_stream_of_checks_survives_restart(spark, tmp_path):
    def put(name, values):
        spark.createDataFrame([(v,) for v in values], "v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    checks = [Check("c", "validity", "range", "t", ("v",), {"max_value": 5}),
              Check("u", "uniqueness", "exact", "t", ("v",))]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def drain():
        stream = spark.readStream.schema("v int").parquet(str(tmp_path / "in"))
        streaming.check_stream(stream, "t", checks, out, state).awaitTermination()

    put("a", [1, 1, 9])
    drain()
    drain()  # nothing new: no batch
    put("b", [2, 7, 8, 9])
    drain()
    got = {(r.batch_id, r.check_id): (r.total_rows, r.failed_rows) for r in spark.read.parquet(out).collect()}
    assert got == {(0, "c"): (3, 1), (0, "u"): (3, 2), (1, "c"): (4, 3), (1, "u"): (4, 0)}


def test_missed_heartbeats_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(streaming, "CELLS_PER_BLOCK", 4)
    beats = [0, 5, 9, 30, 31, 45, 100, 105, 118, 119]
    df = spark.createDataFrame([(b,) for b in beats], "s long").withColumn("ts", F.timestamp_seconds("s"))
    got = streaming.missed_heartbeats(df, "ts", "10s").select(
        F.unix_timestamp("last_beat"), F.unix_timestamp("next_beat"), "gap_seconds").collect()
    assert sorted(tuple(r) for r in got) == [(9, 30, 21.0), (31, 45, 14.0), (45, 100, 55.0), (105, 118, 13.0)]


def test_scratch_follows_the_session(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_suite_needs_checks(spark):
    with pytest.raises(ValueError):
        run_suite({}, [])


def test_undated_rows_of_a_stream_are_counted(spark, tmp_path):
    check = Check("big", "validity", "range", "t", ("v",), {"max_value": 10})
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    schema = "ts timestamp, v int"
    for rows, total in (([(None, 5), (None, 50), (None, None)], 3), ([(None, 70)], 4)):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        streaming.undated_counts(stream, check, "ts", out, state).awaitTermination()
        got = spark.read.parquet(out).groupBy().sum("total_rows", "passed_rows", "failed_rows", "skipped_rows").first()
        batch = streaming.windowed_counts(spark.read.schema(schema).parquet(source), check, "ts", "1 day").first()
        assert batch.window_start is None and batch.total_rows == total
        assert tuple(got) == (batch.total_rows, batch.passed_rows, batch.failed_rows, batch.skipped_rows)


def test_rows_of_custom_sql(spark):
    t = {"t": spark.createDataFrame([(1, 5), (2, -1), (3, -2)], "id int, n int")}
    counts = "count(*) AS total, count_if(n < 0) AS failed"

    def check(**params):
        return Check("c", "validity", "custom_sql", "t", (), params)

    listed = check(sql=f"SELECT {counts} FROM {{dataset}}", violations_sql="SELECT id FROM {dataset} WHERE n < 0")
    assert sorted(r.id for r in violations(t, listed).collect()) == [2, 3]
    sampled = check(sql=f"SELECT {counts}, to_json(collect_list(CASE WHEN n < 0 THEN id END)) AS sample FROM {{dataset}}")
    assert sorted(r.row_id for r in violations(t, sampled).collect()) == ["2", "3"]
    with pytest.raises(ValueError, match="lists no rows"):
        violations(t, check(sql=f"SELECT {counts} FROM {{dataset}}"))


def test_sketches_of_parts(spark):
    df = spark.range(30_000).selectExpr("id % 7001 AS k", "cast(id AS string) AS s", "if(id % 5 = 0, null, id / 8) AS x", "id % 2 = 0 AS b",
                                        "date_add(date'2024-01-01', cast(id % 400 AS int)) AS d", "array(id) AS a")
    stored = sketches.column_sketches(df, F.col("k") % 6)
    assert stored.count() == 30 and "Join" not in stored._jdf.queryExecution().executedPlan().toString()
    got = {r.column_name: r for r in sketches.merged_sketches(stored, df.schema).collect()}
    exact = {"k": 7001, "s": 30_000, "x": 24_000, "b": 2, "d": 400}
    assert set(got) == set(exact)
    for name, n in exact.items():
        assert abs(got[name].n_distinct - n) <= 5 * sketches.ERROR * n
    assert (got["k"].least, got["k"].greatest, got["x"].n_nulls, got["x"].greatest) == ("0", "7000", 6000, "3749.875")
    assert (got["s"].greatest, got["d"].greatest, got["b"].n_rows) == ("9999", "2025-02-03", 30_000)
    some = sketches.merged_sketches(stored.where("part < 3"), df.schema).where("column_name = 'k'").first()
    assert abs(some.n_distinct - 3501) <= 5 * sketches.ERROR * 3501
