import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colonnade.operators import anomaly


def cloud(n=2000, planted=20, seed=0):
    rng = np.random.default_rng(seed)
    data = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    data.loc[: planted - 1, ["a", "b"]] += 25
    return data


def flags(df):
    return {r["id"]: (r[anomaly.SCORE], r[anomaly.STATUS]) for r in df.collect()}


def test_planted_rows_are_flagged(spark):
    got = flags(anomaly.isolation_forest(spark.createDataFrame(cloud()), "id"))
    assert len(got) == 2000
    assert all(got[i][1] == anomaly.ANOMALY for i in range(20))
    assert all(0 < s < 1 for s, _ in got.values())
    assert sum(s == anomaly.ANOMALY for _, s in got.values()) == 100


def test_partitioning_changes_nothing(spark):
    df = spark.createDataFrame(cloud())
    assert flags(anomaly.isolation_forest(df, "id")) == flags(anomaly.isolation_forest(df.repartition(11, "a"), "id"))


def test_large_draw_serves_every_tree(spark):
    n, trees, sample = 20_000, 10, 32
    rows = spark.range(n).select(F.xxhash64("id").alias("_key"), F.rand(1).alias("f0"))
    drawn = anomaly._draw(rows, F.col("_key"), ["f0"], n, trees, sample, 42)
    counts = {r["tree"]: r["count"] for r in drawn.groupBy("tree").count().collect()}
    assert counts == dict.fromkeys(range(trees), sample)
    scored = anomaly.isolation_forest(spark.range(n).withColumn("v", F.randn(3)), "id", ["v"], trees=trees, sample=sample)
    assert scored.where(f"{anomaly.STATUS} = 'Anomaly'").count() == pytest.approx(n * 0.05, rel=0.1)


@pytest.mark.parametrize("n", [3 * 40, 5 * 40, 60 * 40])
def test_draw_is_the_least_of_all(spark, n):
    """Below and above four times what all trees hold, each tree has just the rows of least draw."""
    trees, sample = 10, 4
    rows = spark.range(n).select(F.col("id").alias("_key"), F.col("id").cast("double").alias("f0"))
    for parts in (1, 8, 200):
        drawn = anomaly._draw(rows.repartition(parts), F.col("_key"), ["f0"], n, trees, sample, 42)
        got = {}
        for r in drawn.collect():
            got.setdefault(r["tree"], set()).add(int(r["x0"]))
        each = spark.range(trees).withColumnRenamed("id", "t").crossJoin(rows).select(
            F.col("t").cast("int"), "_key", F.shiftrightunsigned(F.xxhash64(F.lit(42), F.col("t").cast("int"), "_key"), 11).alias("u")
        )
        least = {}
        for r in sorted(each.collect(), key=lambda r: r["u"]):
            if len(least.setdefault(r["t"], set())) < sample:
                least[r["t"]].add(r["_key"])
        assert got == least


def test_equal_rows_are_drawn_by_number(spark):
    """A value that two thirds of the rows share makes up two thirds of what trees without a key see."""
    n, trees, sample = 3_000, 40, 64
    rows = spark.range(n).select(F.lit(0).alias("_key"), F.when(F.col("id") % 3 > 0, -1.0).otherwise(F.col("id").cast("double")).alias("f0"))
    one, many = (anomaly._draw(rows.repartition(p), F.col("_key"), ["f0"], n, trees, sample, 7, False).collect() for p in (1, 23))
    assert sorted(one) == sorted(many) and len(one) == trees * sample
    assert np.mean([r["x0"] == -1 for r in one]) == pytest.approx(2 / 3, abs=0.05)


def test_no_key_and_any_partitioning(spark):
    df = spark.createDataFrame(cloud())
    one = anomaly.isolation_forest(df, None, ["a", "b"])
    other = anomaly.isolation_forest(df.repartition(13, "b"), None, ["a", "b"])
    assert flags(one) == flags(other)
    assert flags(anomaly.unified_anomaly({"d": df})[0]) == flags(anomaly.unified_anomaly({"d": df.repartition(7, "a")})[0])


def test_tree_isolates_every_point():
    x = np.array([[0.0], [1.0], [2.0], [50.0]])
    levels = 2
    nodes = pd.DataFrame(anomaly.grow_tree(x, np.random.default_rng(1), levels), columns=["slot", "feature", "split", "depth"])
    tree = anomaly.lay_out(nodes, levels)
    depth = anomaly.path_lengths(x, [tree], levels)
    assert (depth > 0).all() and depth[3] == depth.min()


def test_equal_rows(spark):
    df = spark.range(500).withColumn("v", F.lit(3.0))
    got = anomaly.isolation_forest(df, "id", ["v"])
    assert got.where("status = 'Anomaly'").count() == 0


def test_one_row_and_no_rows(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, v double")
    assert anomaly.isolation_forest(df, "id").first()["status"] == "Normal"
    assert anomaly.isolation_forest(df.limit(0), "id").count() == 0


def test_incomplete_rows_are_left_out(spark):
    df = spark.createDataFrame([(i, float(i), None if i % 2 else 1.0) for i in range(40)], "id int, a double, b double")
    assert anomaly.isolation_forest(df, "id").count() == 20


def test_unified(spark):
    a = spark.range(300).select("id", F.randn(1).alias("x"), F.rand(2).alias("own"))
    b = spark.range(200).select("id", F.randn(3).alias("x"))
    scored, common = anomaly.unified_anomaly({"a": a, "b": b}, {"a": "id", "b": "id"})
    assert common == ["id", "x"]
    assert {r["_source"]: r["count"] for r in scored.groupBy("_source").count().collect()} == {"a": 300, "b": 200}
    total = anomaly.anomaly_summary(scored).where("source = 'all'").first()
    assert (total["scanned"], total["anomalies"] + total["normal"]) == (500, 500)
    contrast = anomaly.anomaly_contrast(scored, common).collect()
    assert len(contrast) == 2 and abs(contrast[0]["difference"]) >= abs(contrast[1]["difference"])


def test_no_common_columns(spark):
    a, b = spark.range(100).toDF("p"), spark.range(60).toDF("q")
    scored, common = anomaly.unified_anomaly({"a": a, "b": b})
    assert common == [] and scored.count() == 160 and {"p", "q", "_source", "status"} <= set(scored.columns)
