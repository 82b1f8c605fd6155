import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.functions.quantiles import exact_quantiles, quantile_row, values_at_ranks

RNG = random.Random(4)
SAMPLES = {
    "uniform": [RNG.uniform(-5, 5) for _ in range(3001)],
    "one_value": [3.25] * 500,
    "hot_value": [1.0] * 700 + [RNG.gauss(0, 1) for _ in range(300)],
    "epochs": [1.7e15 + RNG.randrange(10**6) for _ in range(2000)],
    "scales": [RNG.choice([-1, 1]) * 10.0 ** RNG.randint(-200, 200) for _ in range(1000)],
    "signed_zero": [0.0] * 10 + [-1e-300, 1e-300, -2.0, 2.0],
    "single": [42.0],
    "pair": [1.0, 2.0],
}


@pytest.mark.parametrize("name", SAMPLES)
def test_quantiles_equal_numpy(spark, name):
    values = SAMPLES[name]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ps = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = quantile_row(df, F.col("v"), ps).first()
    assert list(got) == pytest.approx(list(np.quantile(values, ps)), rel=1e-12, abs=1e-300)


def test_several_columns_and_empty_ones(spark):
    df = spark.createDataFrame([(1.0, 5, None), (3.0, None, None)], "a double, b int, c double")
    got = {r.cid: r.q0 for r in exact_quantiles(df, [F.col("a"), F.col("b"), F.col("c")], [0.5]).collect()}
    assert got == {0: 2.0, 1: 5.0}
    assert quantile_row(df, F.col("c"), [0.5]).first().q0 is None


def test_element_at_rank(spark):
    values = SAMPLES["uniform"]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    total = F.col("total")
    found = values_at_ranks(df, [F.col("v")], [F.least(F.floor(total * 0.95), total - 1)]).first()
    assert found.value == sorted(values)[int(len(values) * 0.95)]
