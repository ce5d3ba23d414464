import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colonnade.functions import quantiles as Q

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0)


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def columns(seed=1, n=4000):
    rng = np.random.default_rng(seed)
    hot = np.where(rng.random(n) < 0.4, 7.25, rng.normal(size=n))
    return {
        "smooth": rng.normal(size=n),
        "heavy": np.exp(rng.normal(scale=8, size=n)),
        "hot": hot,
        "whole": rng.integers(-5, 5, n).astype(float),
        "constant": np.full(n, 3.5),
        "tiny": rng.random(n) * 1e-300,
        "wide": np.where(np.arange(n) == 0, 1.7e308, np.where(np.arange(n) == 1, -1.7e308, rng.random(n))),
    }


def test_refinement_equals_numpy(spark):
    data = columns()
    df = frame(spark, **data)
    found = Q.quantiles(df, list(data), PROBS, direct_rows=20)
    for c, values in data.items():
        for p, got in zip(PROBS, found[c]):
            place = p * (len(values) - 1)
            low, high = np.sort(values)[[math.floor(place), math.ceil(place)]]
            assert got == pytest.approx(low * (1 - place % 1) + high * (place % 1), rel=1e-12, abs=1e-320)


def test_refinement_equals_built_in_with_gaps(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, x=np.where(rng.random(3000) < 0.3, np.nan, rng.normal(size=3000)), empty=np.full(3000, np.nan))
    near = Q.quantiles(df, ["x", "empty"], PROBS)
    far = Q.quantiles(df, ["x", "empty"], PROBS, direct_rows=10)
    assert far["x"] == pytest.approx(near["x"], rel=1e-12)
    assert far["empty"] == near["empty"] == [None] * len(PROBS)


def test_infinite_values(spark):
    df = frame(spark, x=[-math.inf, 1.0, 2.0, 3.0, math.inf, math.inf, math.inf])
    assert Q.quantiles(df, ["x"], (0.0, 0.5, 1.0), direct_rows=2)["x"] == [-math.inf, 3.0, math.inf]


@pytest.mark.parametrize("few", [True, False])
def test_groups(spark, monkeypatch, few):
    """One group holds most rows; small ones go the built-in way, large ones are refined."""
    if not few:
        monkeypatch.setattr(Q, "_FEW_GROUPS", 1)
    rng = np.random.default_rng(9)
    key = rng.choice(["a", "b", "c", "d"], 6000, p=[0.7, 0.2, 0.09, 0.01])
    data = pd.DataFrame({"k": key, "v": np.exp(rng.normal(scale=3, size=6000))})
    data.loc[data.index[:50], "k"] = None
    df = spark.createDataFrame(data)
    got = Q.group_quantiles(df, ["k"], "v", (0.25, 0.5), extra=[F.count(F.lit(1)).alias("n")], direct_rows=200)
    want = data.groupby("k")["v"]
    rows = {r["k"]: r for r in got.collect()}
    assert set(rows) == set("abcd")
    for k, r in rows.items():
        assert r["n"] == want.count()[k]
        assert r["q0"] == pytest.approx(want.quantile(0.25)[k], rel=1e-12)
        assert r["q1"] == pytest.approx(want.quantile(0.5)[k], rel=1e-12)


def test_groups_by_date(spark):
    data = pd.DataFrame({"k": pd.to_datetime(["2020-01-01", "2020-01-02"]).repeat(500), "v": np.arange(1000.0)})
    got = Q.group_quantiles(spark.createDataFrame(data), ["k"], "v", (0.5,), direct_rows=50).orderBy("k").collect()
    assert [r["q0"] for r in got] == [249.5, 749.5]


def test_order_statistic_counts(spark):
    df = frame(spark, x=[5.0, 1.0, 3.0, 3.0, 3.0, 9.0])
    assert Q.order_statistic(df, F.col("x"), 2, (6, None, None)) == (3.0, 1, 3)
    assert Q.order_statistic(df, F.col("x"), 5, (6, 1.0, 9.0), direct_rows=1) == (9.0, 5, 1)


def test_refinement_never_gathers_rows(spark):
    """The passes only count: no plan of theirs sorts or collects raw rows."""
    rows = frame(spark, **{"v": np.arange(100.0)}).select(F.lit(0).alias("g"), "v")
    spans = spark.createDataFrame([(0, 0.0, 99.0)], Q._SPAN)
    targets = spark.createDataFrame([(0, 0, 50, 0.0, 0)], Q._TARGET)
    plan = Q._narrow(rows, spans, targets, ["g"], False)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "CartesianProduct" not in plan
