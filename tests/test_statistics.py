import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colonnade.operators import aggregates, statistics


def test_stats_against_pandas(spark):
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"a": rng.gamma(2, size=500), "b": rng.normal(size=500)})
    data.loc[::7, "a"] = np.nan
    for limit in (10, 10_000):
        rows = {r["column"]: r for r in statistics.column_stats(spark.createDataFrame(data), direct_rows=limit).collect()}
        for c in data:
            s = data[c]
            want = {"n": s.count(), "mean": s.mean(), "std": s.std(), "skew": s.skew(), "q1": s.quantile(0.25),
                    "median": s.median(), "q3": s.quantile(0.75), "min": s.min(), "max": s.max(), "sum": s.sum()}
            for k, v in want.items():
                assert rows[c][k] == pytest.approx(v, rel=1e-9), (c, k)


def test_few_or_equal_values(spark):
    df = spark.createDataFrame([(1.0, 4.0, None), (2.0, 4.0, None), (None, 4.0, None)], "two double, flat double, none double")
    assert [r["column"] for r in statistics.column_stats(df).collect()] == ["flat"]
    shape = {r["column"]: r["distribution"] for r in statistics.distribution_class(df).collect()}
    assert shape == {"two": "unknown", "flat": "roughly normal", "none": "unknown"}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert statistics.null_counts(df).first()["nulls"] == 2
    assert statistics.column_stats(df, min_values=1).first()["max"] == 3.0
    assert statistics.nunique(df).first()["nunique"] == 2


def test_empty(spark):
    df = spark.createDataFrame([], "v double, s string")
    assert statistics.column_stats(df).count() == 0
    assert statistics.null_total(df).first()["nulls"] == 0
    assert statistics.kpi_cards(df, "e").first()["rows"] == 0


def test_booleans_are_labels(spark):
    df = spark.createDataFrame([(True, 1)], "b boolean, n int")
    assert statistics.kpi_cards(df, "x").first()["numeric_cols"] == 1


def test_hash_floor_is_a_lower_bound(spark):
    df = spark.createDataFrame([(f"v{i}", f"w{i % 3}") for i in range(50)], "many string, few string")
    assert statistics.more_labels_than(df, ["many", "few"], 10) == {"many"}


def test_group_agg_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), (None, 9.0), ("c", 5.0)], "x string, y double")
    total = {r["x"]: r["value"] for r in aggregates.group_agg(df, "x", "y", "sum").collect()}
    assert total == {"a": 1.0, "b": 0.0, "c": 5.0}
    assert [r["x"] for r in aggregates.group_agg(df, "x", "y", "nonsense").collect()] == ["c", "a", "b"]
    counts = {r["x"]: r["value"] for r in aggregates.group_agg(df, "x", "y", "count").collect()}
    assert counts == {"a": 1, "b": 0, "c": 1}
    with pytest.raises(ValueError):
        aggregates.group_agg(df, "x", "nope")


def test_mode_prefers_smallest(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), ("c", None)], "s string, gone string")
    assert [tuple(r) for r in aggregates.mode_values(df, ["s", "gone"]).collect()] == [("s", "a")]


def test_segment_share_counts_unlabelled_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 7.0)], "g string, v double")
    rows = aggregates.segment_breakdown(df, "g", "v").collect()
    assert [(r["segment"], r["share"]) for r in rows] == [("b", 20.0), ("a", 10.0)]
    zero = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "g string, v double")
    assert {r["share"] for r in aggregates.segment_breakdown(zero, "g", "v").collect()} == {0.0}


def test_volatility_of_zero_mean(spark):
    stats = spark.createDataFrame([("a", 0.0, 3.0), ("b", 2.0, 3.0)], "column string, mean double, std double")
    got = {r["column"]: (r["cv"], r["band"]) for r in statistics.volatility(stats).collect()}
    assert got == {"a": (0.0, "low"), "b": (150.0, "extreme")}
    assert [r["column"] for r in statistics.high_variability(stats).collect()] == ["b"]


def test_median_of_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("x"), (F.col("id") * 1.5).alias("y")
    )
    near = aggregates.group_agg(df, "x", "y", "median").collect()
    far = aggregates.group_agg(df, "x", "y", "median", direct_rows=100).collect()
    assert near == far
