import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colonnade.operators import outliers, similarity, trends


def test_spike_needs_ten_values(spark):
    nine = spark.createDataFrame([(float(i),) for i in range(8)] + [(99.0,)], "v double")
    assert outliers.spike_value(nine).count() == 0
    ten = spark.createDataFrame([(float(i),) for i in range(9)] + [(99.0,)], "v double")
    row = outliers.spike_value(ten).first()
    assert (row["value"], row["median"], row["iqr"], row["distance_iqr"], row["count"], row["is_high"]) == (99.0, 4.5, 4.5, 21.0, 1, True)


def test_spike_without_spread_or_outliers(spark):
    flat = spark.createDataFrame([(1.0, float(i)) for i in range(20)] + [(5.0, 3.0)], "flat double, even double")
    assert outliers.spike_value(flat).count() == 0
    assert outliers.iqr_outlier_counts({"d": flat}).count() == 0
    assert outliers.outlier_rows(flat, "flat").count() == 0


def test_spike_tie_prefers_high(spark):
    df = spark.createDataFrame([(float(i),) for i in range(-5, 6)] + [(50.0,), (-50.0,)], "v double")
    row = outliers.spike_value(df).first()
    assert row["value"] == 50.0 and row["count"] == 2


def test_outlier_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).select(F.when(F.col("id") == 7, 10**6).otherwise(F.col("id")).alias("v")).write.parquet(path)
    found = outliers.outlier_rows(spark.read.parquet(path), "v")
    assert [r["v"] for r in found.collect()] == [10**6]


def test_nan_in_parquet(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(i, float(i)) for i in range(20)] + [(20, float("nan")), (21, 900.0)], "k int, v double").write.parquet(path)
    df = spark.read.parquet(path)
    assert [r["k"] for r in outliers.outlier_rows(df, "v").collect()] == [21]
    assert outliers.spike_value(df, ["v"]).first()["value"] == 900.0
    assert 20 not in [r["k"] for r in similarity.similar_rows(df, "k", 3, 30, ["v"]).collect()]


def brute_trend(data, date, key, column):
    ordered = data.sort_values([date, key], na_position="last", kind="stable")
    half = len(ordered) // 2
    return ordered[column].iloc[:half].mean(), ordered[column].iloc[half:].mean()


@pytest.mark.parametrize("rows,nulls", [(101, 0), (100, 10), (90, 70), (3, 0)])
def test_halves_with_ties_and_gaps(spark, rows, nulls):
    rng = np.random.default_rng(rows)
    data = pd.DataFrame({
        "at": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 3, rows), unit="D"),
        "k": rng.permutation(rows), "v": rng.gamma(2, size=rows),
    })
    data.loc[data.index[:nulls], "at"] = pd.NaT
    df = spark.createDataFrame(data)
    want = brute_trend(data, "at", "k", "v")
    for limit in (5, 10_000):
        row = trends.half_split_trend(df, "at", "k", ["v"], min_change=0.0, direct_rows=limit).first()
        assert (row["first_avg"], row["second_avg"]) == pytest.approx(want)


def test_text_dates_sort_as_dates(spark):
    df = spark.createDataFrame([(1, "10/1/2019", 1.0), (2, "2/1/2020", 5.0)], "k int, d string, v double")
    row = trends.half_split_trend(df, "d", "k", ["v"]).first()
    assert (row["first_avg"], row["second_avg"], row["change_pct"], row["direction"]) == (1.0, 5.0, 400.0, "increase")


def test_no_trend(spark):
    one = spark.createDataFrame([(1, "2020-01-01", 1.0)], "k int, d string, v double")
    assert trends.half_split_trend(one, "d", "k").count() == 0
    zero = spark.createDataFrame([(1, "2020-01-01", 0.0), (2, "2020-01-02", 5.0)], "k int, d string, v double")
    assert trends.half_split_trend(zero, "d", "k", ["v"]).count() == 0


def test_string_keys_split_in_half(spark):
    df = spark.createDataFrame([(f"row {i}", "2020-01-01", float(i)) for i in range(1001)], "k string, d string, v double")
    early = trends.earlier_half(df, "d", "k")
    assert df.where(early).count() == 500


def test_similar_rows(spark):
    rng = np.random.default_rng(8)
    data = pd.DataFrame({"k": np.arange(300), "a": rng.normal(size=300), "b": rng.gamma(1, size=300), "flat": 5.0})
    data.loc[4, "a"] = np.nan
    df = spark.createDataFrame(data)
    held = data.dropna()
    z = (held[["a", "b"]] - held[["a", "b"]].mean()) / held[["a", "b"]].std(ddof=0)
    t = z.loc[1]
    cosine = (z @ t / (np.linalg.norm(z, axis=1) * np.linalg.norm(t))).drop(1)
    want = cosine.sort_values(ascending=False).head(4)
    rows = similarity.similar_rows(df, "k", 1, 4).collect()
    assert [r["k"] for r in rows] == list(want.index)
    assert [r["similarity_score"] for r in rows] == [round(x, 4) for x in want]
    assert similarity.similar_rows(df, "k", 999).count() == 0
    assert similarity.similar_rows(df, "k", 4).count() == 0


def test_zero_vector_scores_zero(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, -1.0)], "k int, a double")
    assert {r["similarity_score"] for r in similarity.similar_rows(df, "k", 0).collect()} == {0.0}


@pytest.mark.parametrize("direct", [1_000_000, 5])
def test_halves_by_any_key(spark, direct):
    """Large whole numbers, texts with common starts and missing keys divide the rows of one date in key order."""
    many = spark.range(1_000).selectExpr("'2024-01-05' AS day", "id + 1152921504606846976 AS k", "id", "double(id) AS v")
    frames = {
        "big": many,
        "text": many.selectExpr("day", "concat('customer-', repeat('x', int(id % 3)), format_string('%05d', id)) AS k", "id", "v"),
        "null": many.where("id < 12").selectExpr("day", "if(id = 3, null, id) AS k", "id", "v"),
        "mixed": many.selectExpr("if(id % 7 = 0, null, if(id % 5 = 0, '2024-01-04', day)) AS day", "k", "id", "v"),
    }
    for df in frames.values():
        rows = df.collect()
        order = sorted(rows, key=lambda r: (r["day"] is None, r["day"] or "", r["k"] is None, r["k"] if r["k"] is not None else 0))
        want = {r["id"] for r in order[: len(rows) // 2]}
        early = trends.earlier_half(df, "day", "k", direct_rows=direct)
        assert {r["id"] for r in df.where(early).collect()} == want


def test_rows_that_cannot_be_told_apart(spark):
    same = spark.createDataFrame([("2024-01-05", 1, 2.0)] * 4, "day string, k int, v double")
    with pytest.raises(ValueError, match="equal"):
        trends.earlier_half(same, "day", "k")
