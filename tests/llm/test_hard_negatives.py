import math
import random

import duckdb
import numpy as np
import pytest

from veritab.llm import op13_hard_negatives as op13
from veritab.llm.op13_hard_negatives import Block, Segments, hard_negatives, hilbert, keyed, search, write_blocks

SCHEMA = "vec_id long, label int, embedding array<double>, vec string, place string, row string, dims string"


def brute(rows, every, positives=5, negatives=3, low=50, high=95):
    own = [(i, g, [math.floor(256 * x) for x in v]) for i, g, v, *_ in rows
           if None not in (i, g, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, g, v in own:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, h) for j, h, w in own if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == g][:positives]:
            inside = [s for s in scored if s[2] != g and low * -p <= 100 * -s[0] <= high * -p]
            out += [(i, j, k + 1, m, -p, -s) for k, (s, m, _) in enumerate(inside[:negatives])]
    return sorted(out)


def odd_rows():
    rnd = random.Random(8)
    unit = lambda d=6: [rnd.gauss(0, 0.4) for _ in range(d)]
    rows = [(i, rnd.randrange(3), unit()) for i in range(150)]
    rows += [(200, 1, rows[10][2]), (10, *rows[10][1:]), (10, *rows[10][1:]), (201, 2, [0.0] * 6), (202, 0, rows[20][2]), (203, 0, rows[20][2])]
    rows += [(None, 1, unit()), (204, None, unit()), (205, 1, None), (206, 1, [None] * 6), (207, 1, [math.nan] * 6), (210, 1, [math.inf] * 6),
             (220, 2, []), (221, 1, []), (230, 0, unit(3)), (231, 0, unit(3)), (232, 1, unit(3)), (240, -1, [9.0] * 6), (250, 1, [-9.0] * 6)]
    return [(*r, "v", "p", "r", "d") for r in rows]


@pytest.mark.parametrize("block", [7, 1024])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op13, "BLOCK", block)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives(df.repartition(3), 10)
    assert got.dtypes == [(n, "int" if n == "rank" else "bigint") for n in
                          ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)
    few = [r for r in rows if r[0] in (10, 20, 21)]
    assert sorted(map(tuple, hard_negatives(spark.createDataFrame(few, SCHEMA), 10, 2, 1, (0, 100)).collect())) == brute(few, 10, 2, 1, 0, 100)
    assert hard_negatives(df.limit(0), 10).isEmpty()


def test_large_components(spark):
    rnd = random.Random(2)
    rows = [(i, i % 2, [rnd.choice([1.0, 1e5, 3e6]) * rnd.random() for _ in range(4)], "", "", "", "") for i in range(40)]
    assert sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, SCHEMA), 5).collect())) == brute(rows, 5)
    rows[0] = (0, 0, [1e300] * 4, "", "", "", "")
    got = sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, SCHEMA), 5).collect()))
    most = 2 ** 63 - 1
    assert got == sorted((*r[:4], *(min(max(s, -most - 1), most) for s in r[4:])) for r in brute(rows, 5))


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_goes_to_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    place = hilbert(cells, bits) @ (1 << np.arange(dims * bits)[::-1])
    assert sorted(place) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_bounds_spare_blocks(spark, tmp_path, monkeypatch):
    """Vectors in clusters: most blocks are not read, and the result is that of reading all."""
    monkeypatch.setattr(op13, "BLOCK", 32)
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(60, 16))
    rows = [(i, int(i % 60 // 6), (centres[i % 60] + 0.02 * rnd.normal(size=16)).tolist(), "", "", "", "") for i in range(6000)]
    own = keyed(spark.createDataFrame(rows, SCHEMA))
    segments = Segments(write_blocks(own, str(tmp_path / "blocks")))
    some = sorted(own.filter("vec_id % 60 = 7 and vec_id < 1000").collect(), key=lambda r: r.vec_id)
    tile = Block(16, np.array([r.label for r in some]), np.array([r.vec_id for r in some]), np.array([r.vec for r in some]))
    got = search(tile, segments, float, 5, 3, (50, 95)).to_pylist()
    blocks = own.count() / 32
    assert segments.read < 0.5 * 2 * blocks, (segments.read, blocks)
    x = np.floor(256 * np.array([r[2] for r in rows]))
    labels = np.array([r[1] for r in rows])
    for a in some:
        scores = x @ np.array(a.vec)
        same = [i for i in np.lexsort((np.arange(6000), -scores)) if labels[i] == a.label and i != a.vec_id][:5]
        mine = [r for r in got if r["anchor_id"] == a.vec_id]
        assert list(dict.fromkeys(r["positive_id"] for r in mine)) == [i for i in same if any(r["positive_id"] == i for r in mine)]
        for p in same:
            inside = (labels != a.label) & (50 * scores[p] <= 100 * scores) & (100 * scores <= 95 * scores[p])
            first = np.flatnonzero(inside)[np.lexsort((np.flatnonzero(inside), -scores[inside]))][:3]
            assert [r["negative_id"] for r in mine if r["positive_id"] == p] == first.tolist()


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, op13.op13_hard_negatives(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(op13.ORACLE).fetchall()) and len(got) > 50
