import random
import re

from pyspark.sql import functions as F

from colonnade.functions import vocabulary as V
from colonnade.operators import charts, profile, segments, statistics


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_no_row_is_copied_for_every_column(spark):
    df = spark.range(2_000).selectExpr(
        "id", "cast(id % 7 as string) AS few", "uuid() AS free", "id % 60 AS sixty", "if(id % 3 = 0, null, id / 2) AS half",
        "cast(null as string) AS none", "if(id % 2 = 0, -0.0D, 0.0D) AS zero", "cast('NaN' as double) AS nan",
    )
    found = statistics.nunique(df)
    assert "Expand" not in plan_of(found)
    assert [r["nunique"] for r in found.orderBy("ordinal").collect()] == [2_000, 7, 2_000, 60, 1_333, 0, 1, 0]
    assert "Expand" not in plan_of(charts.chart_choices(df))
    assert statistics.more_labels_than(df, df.columns, 50) == {"id", "free", "half"}
    assert segments.primary_dimension(df).first()["column"] == "few"


def test_the_bound_itself_is_counted_exactly(spark):
    df = spark.range(10_000).selectExpr("cast(id % 50 as string) AS fifty", "cast(id % 51 as string) AS more")
    usable = segments.dimension_candidates(df).collect()
    assert [(r["column"], r["nunique"]) for r in usable] == [("fifty", 50)]


def test_all_keywords_in_one_scan(spark):
    words = sorted({w for ws in V.DOMAIN_KEYWORDS.values() for w in ws})
    pattern = re.compile(f"(?=({profile.alternation(words)}))")
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice([*words, "s", "a", " ", "in", "e"]) for _ in range(8))
        met = {m.group(1) for m in pattern.finditer(text)}
        assert {w for w in words if w in text} == {w for w in words if any(m.startswith(w) for m in met)}
    odd = ["a", "abc", "ab.c", "abd", "b", "bc"]
    pattern = re.compile(f"(?=({profile.alternation(odd)}))")
    assert [m.group(1) for m in pattern.finditer("abcabdab.ca")] == ["abc", "bc", "abd", "b", "ab.c", "b", "a"]
    df = spark.createDataFrame([("wind turbines",), ("salesman orders",), (None,)], "note string")
    hits = {r["keyword"] for r in profile.keyword_hits({"d": df}).collect()}
    assert hits == {w for w in words if w in "note" or w in "wind turbines" or w in "salesman orders"}
    scan = profile.keyword_hits({"d": df}).where(F.col("keyword") != "x")
    assert plan_of(scan).split("== Physical Plan ==")[1].count("regexp_extract_all") == 1
