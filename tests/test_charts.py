import pytest
from pyspark.sql import functions as F

from colonnade.operators import charts


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(41)] + [(None,)], "v double")
    rows = charts.histogram(df, "v").collect()
    assert len(rows) == 40 and rows[-1]["count"] == 2 and sum(r["count"] for r in rows) == 41
    flat = charts.histogram(spark.createDataFrame([(2.0,)] * 5, "v double"), "v").collect()
    assert flat[0]["count"] == 5 and sum(r["count"] for r in flat) == 5
    assert charts.histogram(spark.createDataFrame([], "v double"), "v").count() == 0


def test_box(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(100.0,)], "v double")
    row = charts.box_stats(df, "v").first()
    assert (row["outliers"], row["whisker_high"], row["max"], row["n"]) == (1, 9.0, 100.0, 11)


def facts(spark, rows):
    df = spark.createDataFrame(rows, "chart string, kind string, unique long, time boolean")
    chart, reason = charts.guard_chart(F.col("chart"), F.col("kind"), F.col("unique"), F.col("time"))
    return [r[0] for r in df.select(chart).collect()]


def test_guards(spark):
    assert facts(spark, [
        ("pie", "categorical", 9, False), ("pie", "categorical", 8, False), ("pie", "numeric", 30, False),
        ("bar", "numeric", 21, False), ("bar", "categorical", 99, False), ("histogram", "numeric", 5, False),
        ("histogram", "categorical", 50, False), ("line", "categorical", 5, False), ("line", "categorical", 5, True),
        ("box", "categorical", 5, True), ("box", "numeric", 5, True), ("scatter", "categorical", 5, False),
    ]) == ["bar", "pie", "bar", "histogram", "bar", "bar", "bar", "bar", "line", "bar", "box", "scatter"]


def test_chart_rows_dispatch(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 1.0), ("a", 5.0, None)], "c string, x double, y double")
    assert charts.chart_rows(df, "bar", "c").columns == ["c", "count", "total_categories"]
    assert charts.chart_rows(df, "bar", "c", "x", "sum").first()["value"] == 6.0
    assert charts.chart_rows(df, "bar", "c", "c").columns == ["c", "count", "total_categories"]
    assert charts.chart_rows(df, "pie", "c", "x").columns == ["c", "value", "share"]
    assert charts.chart_rows(df, "line", "x", "y").count() == 2
    assert charts.chart_rows(df, "line", "c", "x", "median").first()["value"] == 3.0
    assert charts.chart_rows(df, "scatter", "x", "y").count() == 3
    assert charts.chart_rows(df, "box", "c", "x").count() == 2
    assert charts.chart_rows(df, "histogram", "x", "y").count() == 40
    assert [r["y"] for r in charts.chart_rows(df, "line", "y", key="x").collect()] == [2.0, 1.0, None]
    with pytest.raises(ValueError):
        charts.chart_rows(df, "area", "x")
    with pytest.raises(ValueError):
        charts.chart_rows(df, "bar", "nope")


def test_thinning_is_stable(spark):
    df = spark.range(20_000).select("id", (F.col("id") * 2.0).alias("v"))
    once = charts.scatter_series(df, "v", "id", max_points=500)
    again = charts.scatter_series(df.repartition(7), "v", "id", max_points=500)
    assert 350 < once.count() < 650
    assert sorted(once.collect()) == sorted(again.collect())
    assert charts.line_xy(df, "id", "v", max_points=100).count() == 100


def test_pairings(spark):
    df = spark.createDataFrame([(1.0, 2.0, 100.0, "a"), (2.0, 4.1, -50.0, "b"), (3.0, 6.0, 70.0, "a")], "x double, twin double, loud double, c string")
    assert charts.best_y_for_category(df).first()["column"] == "loud"
    assert charts.best_pair_for_scatter(df, "x").first()["column"] == "twin"
    made = charts.auto_charts(df, "x")
    assert made["c"][:2] == ("pie", "loud")
    assert set(made) == {"x", "twin", "loud", "c"}


def test_infinite_values_have_bins_of_their_own(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 4.0, inf, inf, -inf, float("nan"), None)], "v double")
    rows = charts.histogram(df, "v", 4).collect()
    assert [(r["bin"], r["count"]) for r in rows] == [(-1, 1), (0, 1), (1, 1), (2, 1), (3, 1), (4, 2)]
    assert (rows[0]["low"], rows[1]["low"], rows[4]["high"], rows[5]["high"]) == (-inf, 0.0, 4.0, inf)
    wide = spark.createDataFrame([(-1.7e308,), (1.7e308,)], "v double")
    assert sum(r["count"] for r in charts.histogram(wide, "v", 4).collect()) == 2
