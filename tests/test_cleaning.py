import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colonnade.functions import scalars as S
from colonnade.operators import cleaning

NUMBERS = {
    "inf": math.inf, "+inf": math.inf, "-Infinity": -math.inf, "1e3": 1000.0, " 5 ": 5.0, ".5": 0.5, "5.": 5.0,
    "+3": 3.0, "iNf": math.inf, "\t7": 7.0, "1.5E-2": 0.015,
}
TEXTS = ["  ", "nan", "NaN", "None", "1_000", "0x1F", "5d", "1f", "1e", "e5", "-", "NA", "True", "1,000", ".", "1 2", "--1"]


def test_number_texts(spark):
    df = spark.createDataFrame([(t,) for t in [*NUMBERS, *TEXTS]], "t string")
    got = {r[0]: r[1] for r in df.select("t", S.to_number(F.col("t"))).collect()}
    assert got == NUMBERS | dict.fromkeys(TEXTS)


def test_typing_needs_every_value(spark):
    df = spark.createDataFrame(
        [("1", "1", "", None, "1.0"), ("2", "x", "4", None, "2"), (None, "3", None, None, " 3 ")],
        "a string, b string, c string, d string, e string",
    )
    out = cleaning.type_columns(df)
    assert dict(out.dtypes) == {"a": "bigint", "b": "string", "c": "bigint", "d": "string", "e": "double"}
    assert [r["c"] for r in out.collect()] == [None, 4, None]


def test_money(spark):
    df = spark.createDataFrame([("$ 1,234.5",), ("45%",), ("€ 7",), ("abc",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(S.clean_number(F.col("t"))).collect()] == [1234.5, 45.0, 7.0, None, None, None]


def test_lenient_share(spark):
    rows = [("1",)] * 4 + [("x",)]
    assert dict(cleaning.lenient_numeric_coercion(spark.createDataFrame(rows, "t string")).dtypes) == {"t": "double"}
    rows = [("1",)] * 3 + [("x",)]
    assert dict(cleaning.lenient_numeric_coercion(spark.createDataFrame(rows, "t string")).dtypes) == {"t": "string"}
    gone = spark.createDataFrame([("nan",), ("",)], "t string")
    assert dict(cleaning.lenient_numeric_coercion(gone).dtypes) == {"t": "string"}


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], [" Unit Price ", "QTY"])
    assert cleaning.normalize_columns(df).columns == ["unit_price", "qty"]
    with pytest.raises(cleaning.NameCollision):
        cleaning.normalize_columns(spark.createDataFrame([(1, 2)], ["A b", "a B"]))


def test_duplicate_proof(spark):
    distinct = spark.createDataFrame([(1, None), (None, 1), (1, 1)], "a int, b int")
    assert cleaning.has_duplicates(distinct)[0] == 3
    assert cleaning.clean(distinct)[1].duplicates == 0
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)], "a double")
    out, log = cleaning.clean(zeros)
    assert log.duplicates == 2 and out.count() == 2


def test_duplicates_go_before_typing(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ("1",)], "a string")
    out, log = cleaning.clean(df)
    assert log.duplicates == 1 and log.converted == ["a"]
    assert sorted(r["a"] for r in out.collect()) == [1.0, 1.0]


def test_clean_edges(spark):
    df = spark.createDataFrame(
        [(1.0, None, "x", True, None), (2.0, None, None, None, 5.0), (100.0, None, "y", True, 5.0), (3.0, None, "y", False, 5.0),
         (float("nan"), None, "x", True, 5.0)],
        "v double, gone string, label string, flag boolean, flat double",
    )
    out, log = cleaning.clean(df)
    rows = out.collect()
    assert log.filled["v"][:2] == (1, "median") and log.filled["v"][2] == 2.5
    assert log.filled["label"][2] == "x"
    assert log.filled["gone"][2] == "Unknown"
    assert log.filled["flag"][2] == "true" and all(r["flag"] is not None for r in rows)
    assert dict(out.dtypes)["flag"] == "boolean"
    assert "flat" not in log.capped and {r["flat"] for r in rows} == {5.0}
    assert log.capped == {"v": 1} and max(r["v"] for r in rows) < 100
    assert log.nulls_left == 0


def test_timestamps_stay(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2020-01-01 00:00:00', 1), (TIMESTAMP_NTZ'2020-01-01 00:00:00', 2), (NULL, 3) t(at, n)")
    out, log = cleaning.clean(df)
    assert dict(out.dtypes)["at"] == "timestamp_ntz"
    assert out.where("at IS NULL").count() == 0


def test_empty_frame(spark):
    out, log = cleaning.clean(spark.createDataFrame([], "a double, b string"))
    assert out.count() == 0 and log.rows == 0 and not log.capped


def test_large_and_small_ways_agree(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({
        "k": np.arange(3000), "v": np.where(rng.random(3000) < 0.1, np.nan, np.exp(rng.normal(size=3000) * 2)),
        "s": rng.choice(["a", "b", None], 3000),
    })
    df = spark.createDataFrame(data)
    near = cleaning.clean_table(df).orderBy("k").toPandas()
    far = cleaning.clean_table(df, direct_rows=50).orderBy("k").toPandas()
    pd.testing.assert_frame_equal(near, far)
    filled = data["v"].fillna(data["v"].median())
    q1, q3 = filled.quantile(0.25), filled.quantile(0.75)
    want = filled.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    np.testing.assert_allclose(far["v"], want, rtol=1e-12)


def test_capping_audit_counts_changed_cells(spark):
    raw = spark.createDataFrame([(1, "$ 5"), (2, "$ 500"), (3, None)], "id int, Price string")
    cleaned = spark.createDataFrame([(1, 5.0), (2, 50.0), (3, 5.0)], "id int, price double")
    assert [tuple(r) for r in cleaning.capping_audit(raw, cleaned, "id").collect()] == [("price", 1)]


def test_nested_rows_are_deduplicated(spark):
    df = spark.range(40).selectExpr(
        "id % 20 AS k", "array(id % 20, 1) AS a", "if(id < 20, map('x', 1, 'y', 2), map('y', 2, 'x', 1)) AS m", "struct(id % 20 AS s) AS t"
    )
    out, log = cleaning.clean(df)
    assert (log.rows_in, log.rows, log.duplicates) == (40, 20, 20) and out.count() == 20 and out.columns == ["k", "a", "m", "t"]


def test_audit_with_outlying_key(spark):
    rows = [(i, float(i % 7)) for i in range(1, 60)] + [(-10_000, 1e6)]
    raw = spark.createDataFrame(rows, "key int, v double")
    cleaned = cleaning.clean(raw, key="key")[0]
    assert [tuple(r) for r in cleaning.capping_audit(raw, cleaned, "key").collect()] == [("v", 1)]
    lost = cleaning.capping_audit(raw, cleaned.where("key > 5"), "key").collect()
    assert [(r["column"], r["changed"]) for r in lost] == [("v", 0)][:0] + [(None, 6)]
