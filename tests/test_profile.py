import pytest
from pyspark.sql import functions as F

from colonnade.functions import scalars as S
from colonnade.operators import profile, segments
from colonnade.plans import shared_profile


def test_date_layouts(spark):
    good = ["2020-01-31", "2020-1-3", "2020-01-31 10:20:30", "2020-01-31T10:20:30", "2020/01/31", "1/31/2020",
            "31.1.2020", "20200131", "31 Jan 2020", "Jan 31, 2020"]
    bad = ["2020-13-01", "hello", "", "12", "src0", "2020-01-31 and more", "x" * 500]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    got = [r[0] for r in df.select(S.parse_date(F.col("t")).isNotNull()).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_date_column_choice(spark):
    rows = [("a", "2020-01-01", "2020-01-02"), ("b", "x", "2020-01-05"), ("c", "2020-01-03", "2020-01-09")]
    df = spark.createDataFrame(rows, "label string, order_date string, other string")
    assert profile.detect_date_column(df) == "order_date"
    assert profile.detect_date_column(df.drop("order_date")) == "other"
    assert profile.detect_date_column(df.select("label")) is None
    assert profile.detect_date_column(df.withColumn("at", F.current_timestamp())) == "at"


def test_roles(spark):
    df = spark.createDataFrame(
        [(1.7e12, 0.5, 3, "x", None), (1.7e12, 0.6, 4, "y", None)],
        "at_ms double, fx_rate double, amount int, name string, gone double",
    )
    roles = {r["column"]: r["role"] for r in profile.column_roles(df).collect()}
    assert roles == {"at_ms": "timestamp", "fx_rate": "rate", "amount": "kpi", "name": "category", "gone": "kpi"}


def test_rate_names():
    assert profile.is_rate_name("Conversion Rate") and profile.is_rate_name("generated") and not profile.is_rate_name("price")


def test_year_span(spark):
    df = spark.createDataFrame([(2001, 5), (2009, 6), (1999, 7)], "fiscal_year int, year_index int")
    assert [tuple(r)[1:] for r in profile.year_span(df).collect()] == [("fiscal_year", 1999, 2009)]


def test_domain(spark):
    df = spark.createDataFrame([(1, "patient in hospital"), (2, "tax")], "id int, note string")
    scores = {r["domain"]: r["score"] for r in profile.domain_scores({"d": df}).collect()}
    assert scores["Healthcare"] == 2 and scores["Finance"] == 1 and scores["HR"] == 0
    assert profile.detect_domain({"d": df}) == "Healthcare"
    assert profile.detect_domain({"d": spark.createDataFrame([(1, "zzz")], "id int, note string")}) == "General Business"
    # A tie goes to the domain listed first: "promotion" is in two of them.
    assert profile.detect_domain({"d": spark.createDataFrame([(1, "promotion")], "id int, note string")}) == "Retail"
    sampled = spark.createDataFrame([(1, "x" * 3000), (2, "patient")], "id int, note string")
    assert profile.detect_domain({"d": sampled}) == "Healthcare"


def test_plan(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    steps = [r["step"] for r in profile.analysis_plan(df).collect()]
    assert steps == ["descriptive_statistics", "outlier_detection", "categorical_analysis", "visualization", "ai_insight_generation"]
    gaps = spark.createDataFrame([(None, 2)], "n int, m int")
    assert [r["step"] for r in profile.analysis_plan(gaps).collect()][0] == "handle_missing_values"


def test_dimension_choice(spark):
    rows = [(i, f"t{i % 3}", f"z{i % 8}", "same", f"u{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, item_type string, zone string, flat string, unique string")
    assert segments.primary_dimension(df).first()["column"] == "item_type"
    assert segments.primary_dimension(df.drop("item_type")).first()["column"] == "zone"
    assert segments.primary_dimension(df.select("id", "flat", "unique")).first() is None
    # Too few rows for any to be usable: the first with 2 to 50 labels.
    tiny = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "first string, type string")
    assert segments.primary_dimension(tiny).first()["column"] == "first"


def test_primary_metric(spark):
    stats = spark.createDataFrame(
        [(0, "kwh", 900.0, 9.0), (1, "toe_total", -20.0, -2.0), (2, "toe_avg", 10.0, 1.0)],
        "ordinal int, column string, sum double, mean double",
    )
    assert segments.primary_kpi(stats, "Energy").first()["column"] == "toe_total"
    assert segments.primary_kpi(stats, "Retail").first()["column"] == "kwh"
    assert segments.primary_kpi(stats.limit(0)).first() is None


def test_directions(spark):
    df = spark.createDataFrame([("Profit Loss",), ("lead time",), ("unit_cost",), ("Age",)], "column string")
    got = [r[0] for r in df.select(segments.metric_direction(F.col("column"))).collect()]
    assert got == ["higher_is_good", "higher_is_bad", "higher_is_bad", "neutral"]


@pytest.mark.parametrize("share,found", [(50.0, 1), (90.0, 0)])
def test_concentration(spark, share, found):
    parts = spark.createDataFrame([("a", 8.0, 80.0), ("b", 2.0, 20.0)], "segment string, sum double, share double")
    assert segments.concentration(parts, share).count() == found
    assert segments.concentration(parts.limit(1), share).count() == 0


def test_times_as_files_carry_them(spark):
    texts = [
        "2024-01-02T03:04:05Z", "2024-01-02 03:04:05.000", "2024-01-02 03:04:05.123456", "2024-01-02T05:04:05+02:00",
        "2024-01-02T05:04:05.5+0200", "2024-01-02T03:04:05", "2024-01-02 03:04:05 Z", "2024-13-02T03:04:05Z", "02:04:05Z", "x" * 99,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.date_format(S.parse_date(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSSSSS")).collect()]
    base = "2024-01-02 03:04:05."
    assert got == [base + "000000", base + "000000", base + "123456", base + "000000", base + "500000", base + "000000", base + "000000", None, None, None]


def test_short_tests_before_parsing_turn_no_text_away(spark):
    """What is read as a number or a date is what the patterns read, and a few columns at a time are aggregated."""
    odd = ["12", "$ 1,200.50", "-3e4 ", "5%", "+inf", "Infinity", "iNf", "1-URGENT", "n/a", "", "7\n", "8 ", "£9", ".5", "e5", "1 2", "tiny"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    plain = S.to_number(F.regexp_replace("t", S.MONEY_MARKS, ""))
    assert df.where(~S.clean_number(F.col("t")).eqNullSafe(plain)).count() == 0
    assert all("yyyy" in f for f in S.DATE_LAYOUTS) and r"\d{4}" in S.ISO_TIME
    wide = spark.range(20).select(*[(F.col("id") * k).alias(f"c{k}") for k in range(1, 8)])
    plan = shared_profile._measured(wide)
    assert [(r["ordinal"], r["column"], r["max"]) for r in plan.orderBy("ordinal").collect()] == [(k, f"c{k + 1}", 19.0 * (k + 1)) for k in range(7)]
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 3
