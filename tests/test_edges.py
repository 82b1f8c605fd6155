"""Readers, masking and verdicts at the edges."""

import json

from pyspark.sql import functions as F

from veritab import Check, run_check
from veritab.functions.quantiles import quantile_row
from veritab.plans import evidence, profile
from veritab.sources import readers


def test_wide_numbers_keep_their_digits(spark, tmp_path):
    (tmp_path / "w.csv").write_text("a,b,c,d\n9007199254740993,12345678901234567890,1,5.0\n1,2,NaN,7\n")
    read = readers.read_csv(spark, str(tmp_path / "w.csv"))
    rows = [tuple(map(str, r)) for r in read.collect()]
    assert rows == [("9007199254740993", "12345678901234567890", "1.0", "5"), ("1", "2", "nan", "7")]
    kinds = {r[0]: r[1] for r in profile.infer_types(spark.createDataFrame(
        [("inf", "1" * 40, "1e3", "9007199254740993.5")], "a string, b string, c string, d string")).collect()}
    assert kinds == {"a": "float", "b": "string", "c": "integer", "d": "float"}


def test_skipped_lines_are_counted(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b\n1,2\n1,2,3\n4\n")
    assert tuple(readers.csv_lines_skipped(spark, str(tmp_path / "s.csv")).first()) == (2, 1)
    assert readers.read_csv(spark, str(tmp_path / "s.csv")).count() == 2


def test_json_documents_lie_in_one_folder_and_tasks_infer_from_them(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameReader

    from veritab import registry

    spark.range(950).selectExpr("id as c_custkey", "concat('n', id) as c_name", "cast(id % 25 as int) as c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "nation.parquet"))
    folder, given, schema = tmp_path / "json", [], DataFrameReader.schema
    monkeypatch.setattr(DataFrameReader, "schema", lambda self, found: given.append(found) or schema(self, found))
    for name, documents in (("SRC-json.object", 10), ("SRC-json.mixed", 20)):
        at = str(folder / name)
        monkeypatch.setattr("veritab.registry.data_queries.scratch_path", lambda spark, label, at=at: at)
        monkeypatch.setattr("veritab.registry.edge_queries.scratch_path", lambda spark, label, at=at: at)
        given.clear()
        assert registry.queries()[name](spark, str(tmp_path)).count() == 950
        assert len(list((folder / name).glob("part-*"))) == documents and given


def test_each_json_document_in_utf_16_is_read(spark, tmp_path):
    (tmp_path / "w.json").write_bytes(json.dumps([{"x": 1}, {"x": 2}]).encode("utf-16"))
    assert sorted(r.x for r in readers.read_json(spark, str(tmp_path)).collect()) == [1, 2]


def test_each_json_document_has_its_own_list(spark, tmp_path):
    for name, body in (("a", {"rows": [{"x": 1}, {"x": 2}]}), ("b", {"items": [{"y": "k"}]}), ("c", {"z": 5})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    rows = readers.read_json(spark, str(tmp_path)).select("x", "y", "z").collect()
    assert sorted(map(str, map(tuple, rows))) == ["(1, None, None)", "(2, None, None)", "(None, 'k', None)", "(None, None, 5)"]


def test_no_hidden_value_in_any_field(spark):
    t = {"p": spark.createDataFrame([(7001, 100.5, "2020-01-01")], "id int, salary double, seen string").withColumn("seen", F.to_timestamp("seen")),
         "r": spark.createDataFrame([(7001, 220.25)], "id int, salary double")}
    hidden = {"salary": "confidential", "id": "restricted", "seen": "restricted"}
    reference = {"reference_dataset": "r", "reference_column": "salary", "join_keys": ["id"]}
    for check in (Check("a", "accuracy", "reference_comparison", "p", ("salary",), reference),
                  Check("b", "accuracy", "tolerated_deviation", "p", ("salary",), {**reference, "tolerance_type": "absolute", "tolerance_value": 1}),
                  Check("c", "accuracy", "derived_value", "p", ("id",), {"formula": "salary * 2"}),
                  Check("d", "timeliness", "record_age", "p", ("seen",), {"max_age": "1d"}),
                  Check("e", "consistency", "cross_table", "p", ("salary",), {
                      "comparison_dataset": "r", "join_keys": ["id"], "comparison_columns": ["salary"]}),
                  Check("f", "reconciliation", "field_level", "p", (), {
                      "source_dataset": "p", "target_dataset": "r", "join_keys": ["id"], "compare_columns": ["salary"]})):
        row = evidence.canonical_violations(t, check, "2024-01-31", "id", hidden).first().asDict()
        shown = " ".join(str(v) for k, v in row.items() if k not in ("result_id", "business_key"))
        for secret in ("100.5", "220.25", "119.75", "201", "7001", "2020"):
            assert secret not in shown, (check.check_id, row)
        assert row["masking_applied"] and row["deviation"] is None and len(row["business_key"]) == 64


def test_unknown_members_leave_the_group_unknown(spark):
    t = {"t": spark.createDataFrame([(1,), (None,), (5,)], "a int")}
    member = Check("m", "generic", "condition", "t", (), {"expression": "a < 3"})
    row = run_check(t, Check("g", "generic", "compound", "t", (), {"logic": "AND", "members": [member]})).first()
    assert (row.passed_rows, row.failed_rows, row.undetermined_rows) == (1, 1, 1)


def test_quantiles_put_nan_last(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (float("nan"),), (None,)], "x double")
    assert quantile_row(df, F.col("x"), [0.5]).first()[0] == 3.0
    inf = spark.createDataFrame([(float("inf"),), (float("inf"),), (1.0,)], "x double")
    assert quantile_row(inf, F.col("x"), [0.5, 1.0, 0.0]).first()[:] == (float("inf"), float("inf"), 1.0)


def test_rules_say_their_subtype():
    rule = Check.from_rule({"dimension": "validity", "entity": "t.a", "parameters": {"filter_expression": "a > 0"}})
    assert (rule.subtype, rule.params["expression"], rule.filter) == ("business_rule", "a > 0", None)
    kept = Check.from_rule({"dimension": "validity", "entity": "t.a", "parameters": {"filter_expression": "a > 0", "min_value": 1}})
    assert (kept.subtype, kept.filter) == ("range", "a > 0")
    half = Check.from_rule({"dimension": "consistency", "entity": "t.a", "parameters": {"comparison_dataset": "u", "reference_column": "b"}})
    assert half.subtype == "intra_record"
    for params, subtype in (({"comparison_dataset": "u", "join_keys": ["k"]}, "cross_table"),
                            ({"group_by_columns": ["k"], "comparison_columns": ["a"]}, "inter_record"), ({"group_by_columns": ["k"]}, "intra_record")):
        assert Check.from_rule({"dimension": "consistency", "entity": "t.a", "parameters": params}).subtype == subtype


def test_reference_counts_are_those_of_the_joined_rows(spark):
    """Keys repeated on both sides, NULLs, zeros, NaN: counts from weights equal counts of pairs."""
    nan = float("nan")
    left = [(k, v) for k in (1, 1, 2, None, 3) for v in (1.0, 2.0, 2.0, None, nan, 0.0, -1.0)]
    right = [(k, v) for k in (1, 1, 2, None, 4) for v in (1.01, 2.0, None, 0.0, nan, -1.0)] + [(3, None)]
    t = {"l": spark.createDataFrame(left, "k int, v double"), "r": spark.createDataFrame(right, "k int, v double")}
    for kind, value in (("none", None), ("absolute", 0), ("absolute", 0.05), ("absolute", 9), ("percentage", 1), ("percentage", 150)):
        for policy in ("fail", "skip", "pass"):
            check = Check("a", "accuracy", "trusted_source", "l", ("v",), {
                "reference_dataset": "r", "join_keys": ["k"], "tolerance_type": kind, "tolerance_value": value, "null_handling": policy})
            row = run_check(t, check).first()
            total = passed = failed = verified = 0
            for k, a in left:
                if a is None and policy == "skip":
                    continue
                partners = [b for j, b in right if k is not None and j == k] or [None]
                for b in partners:
                    total += 1
                    if b is None:
                        continue
                    verified += 1
                    if a is None:
                        passed += policy == "pass"
                        continue
                    if kind == "percentage" and b == 0:
                        continue
                    gap = abs(a - b)
                    same = (a == b or (a != a and b != b)) if kind == "none" else gap <= value if kind == "absolute" else gap / abs(b) * 100 <= value
                    passed, failed = passed + same, failed + (not same)
            assert (row.total_rows, row.passed_rows, row.failed_rows, row.verified_rows) == (total, passed, failed, verified), (kind, value, policy)
