import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.llm.op4_permutation_index import Block, footrule, nearest
from veritab.llm.op10_token_counts import TokenRollup

SF = "/root/testdata/sf0.1"


def test_footrule_counts_places():
    rng = np.random.default_rng(1)
    for _ in range(50):
        one, others = rng.permutation(30)[:8], np.array([rng.permutation(30)[:8] for _ in range(20)])
        place = lambda order, p: list(order).index(p) if p in order else 8
        expected = [sum(abs(place(one, p) - place(o, p)) for p in set(one) | set(o)) for o in others]
        assert footrule(one, others, 30).tolist() == expected


def test_files_hold_each_row_under_its_pivots():
    orders = np.array([np.random.default_rng(i).permutation(40)[:20] for i in range(100)])
    block = Block(orders, 40)
    for p in range(40):
        assert sorted(block.rows[block.at[p]: block.at[p + 1]].tolist()) == [i for i in range(100) if p in orders[i][:8]]


def brute(rows, every, k):
    out = []
    for q, x in rows:
        if q % every == 0:
            near = sorted(((-float(np.dot(x, y)), v) for v, y in rows if v != q))[:k]
            out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(near)]
    return sorted(set(out))


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * (1 + i % 5)]) for i in range(60)]
    vectors += [(100 + i, vectors[3][1]) for i in range(30)]  # copies of one vector
    odd = [(200, None), (220, []), (240, [0.0] * 6), (260, [float("nan")] + [1.0] * 5), (280, [float("inf")] + [1.0] * 5),
           (300, [None] + [1.0] * 5), (320, [1.0] * 7), (None, [1.0] * 6)]
    df = spark.createDataFrame([(v, x, 1.0) for v, x in vectors + odd], "vec_id long, embedding array<float>, score double").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, 20).collect())
    expected = brute([(v, np.array(x)) for v, x in vectors], 20, 20)
    assert [g[:3] for g in got] == [e[:3] for e in expected] and np.allclose([g[3] for g in got], [e[3] for e in expected])
    few = df.filter("vec_id in (0, 1, 2, 20)")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(few, 20).collect()) == [e[:3] for e in brute(
        [(v, np.array(x)) for v, x in vectors if v in (0, 1, 2, 20)], 20, 20)]
    assert nearest(df.filter("vec_id = 0"), 20).count() == 0 and nearest(df.filter("false"), 20).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")
def test_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    at = {v: i for i, v in enumerate(ids)}
    found = {}
    for r in nearest(df, 20).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, got in found.items():
        scores = x @ x[at[q]]
        assert np.allclose([s for *_, s in sorted(got)], [scores[at[v]] for _, v, _ in sorted(got)], atol=1e-12) and len(got) == 20
        scores[at[q]] = -np.inf
        hits += len({v for _, v, _ in got} & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert len(found) == (ids % 20 == 0).sum() and hits / (20 * len(found)) >= 0.9


CHANGES = "op string, doc_id long, tokenizer string, source string, lang string, n_tokens long, seq string"


def state(rollup):
    return sorted((str(r.source), str(r.lang), r.tokenizer, r.n_docs, r.n_tokens) for r in rollup.totals().collect())


def test_rollup_follows_signed_changes_once(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    assert state(rollup) == []
    change = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], CHANGES)
    first = change([("insert", 1, "t1", "a", "en", 10), ("insert", 2, "t1", "a", "en", 20), ("insert", 3, "t1", None, "de", 5), ("insert", 1, "t2", "a", "en", 7),
                    ("insert", 4, "t1", "b", "en", None)])
    assert rollup.commit("b1", first) and not rollup.commit("b1", first)
    after = [("None", "de", "t1", 1, 5), ("a", "en", "t1", 2, 30), ("a", "en", "t2", 1, 7), ("b", "en", "t1", 1, 0)]
    assert state(rollup) == after
    second = change([("revise", 1, "t1", "a", "en", 11), ("delete", 2, "t1", "a", "en", None), ("delete", 99, "t1", "a", "en", None),
                     ("revise", 3, "t1", "b", "de", 6), ("insert", 2, "t2", "a", "en", 1), ("insert", 2, "t2", "a", "en", 1)])
    assert rollup.commit("b2", second)
    after = [("a", "en", "t1", 1, 11), ("a", "en", "t2", 2, 8), ("b", "de", "t1", 1, 6), ("b", "en", "t1", 1, 0)]
    assert state(rollup) == after
    assert not rollup.commit("b1", first) and rollup.commit("b3", first.filter("false"))
    again = TokenRollup(spark, str(tmp_path / "r"))
    assert state(again) == after
    assert sorted((r.doc_id, r.tokenizer, r.n_tokens) for r in again.counts().collect()) == [(1, "t1", 11), (1, "t2", 7), (2, "t2", 1), (3, "t1", 6), (4, "t1", 0)]
    with pytest.raises(Exception):
        rollup.commit("b4", change([("remove", 1, "t1", "a", "en", 1)]))
    with pytest.raises(Exception):
        rollup.commit("b5", change([("insert", None, "t1", "a", "en", 1)]))
    assert state(again) == after and rollup.commit("b4", change([("delete", 1, "t1", "a", "en", 1)]))


def test_an_attempt_without_commit_leaves_no_trace(spark, tmp_path, monkeypatch):
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("insert", i, "t", "s", "en", i, "x") for i in range(50)], CHANGES)
    create = spark.createDataFrame

    def lost(data, schema=None):
        if schema and str(schema).startswith("batch") and data:
            raise RuntimeError("the driver is gone")
        return create(data, schema)

    monkeypatch.setattr(spark, "createDataFrame", lost)
    with pytest.raises(RuntimeError):
        rollup.commit("b", rows)
    monkeypatch.undo()
    assert state(rollup) == [] and rollup.commit("b", rows)
    assert state(rollup) == [("s", "en", "t", 50, sum(range(50)))]
    assert rollup.totals().select(F.sum("n_docs")).first()[0] == 50
