from pyspark.sql import functions as F

from colonnade.operators import compare, sets, statistics
from colonnade.plans import findings, recommend, shared_profile


def test_without_metrics(spark):
    df = spark.createDataFrame([(f"k{i}", "x") for i in range(5)], "key string, label string")
    a = findings.analyse({"d": df}, {"d": "key"})
    assert a.domain == "General Business" and findings.headline(a).count() == 0
    assert [tuple(r) for r in recommend.recommendations(a).select("rank", "kind", "score").collect()] == [
        (k, kind, 0.0) for k, kind in enumerate(recommend.GENERAL, 1)
    ]
    assert findings.summary_totals(a).first()["kpis"] == 0
    assert findings.findings_table(a).where("metric = 'rating'").first()["text"] == "High"


def test_number_texts_become_metrics(spark):
    df = spark.createDataFrame([(i, f"$ {i},000", "n/a" if i % 2 else str(i)) for i in range(20)], "key int, amount string, mixed string")
    a = findings.analyse({"d": df}, {"d": "key"})
    assert a.datasets["d"].primary == "amount"
    assert {r["column"]: r["role"] for r in a.datasets["d"].roles.collect()} == {"key": "kpi", "amount": "kpi", "mixed": "category"}


def test_headline_tiers(spark):
    flat = spark.createDataFrame([(i, 10.0) for i in range(20)], "key int, amount double")
    more = spark.createDataFrame([(i, 40.0) for i in range(20)], "key int, amount double")
    keys = {"a": "key", "b": "key"}
    measures = {"a": ["amount"], "b": ["amount"]}
    one = findings.headline(findings.analyse({"a": flat}, keys, measures)).first()
    assert (one["kind"], one["value"]) == ("mean", 10.0)
    two = findings.analyse({"a": flat, "b": more}, keys, measures)
    top = findings.headline(two).first()
    assert (top["kind"], top["column"], top["value"]) == ("gap", "amount", 4.0)
    assert findings.summary_totals(two).first()["max_gap"] == 4.0
    spiky = flat.withColumn("amount", F.col("key") * 1.0 + F.when(F.col("key") == 3, 500).otherwise(0))
    assert findings.headline(findings.analyse({"a": spiky, "b": more}, keys, measures)).first()["kind"] == "spike"


def test_recommendations(spark):
    df = spark.createDataFrame(
        [(i, f"2020-01-{1 + i % 28:02d}", 10.0 + (5 if i % 28 >= 14 else 0) + i * 0.001, None if i < 30 else 1.0) for i in range(280)],
        "key int, order_date string, unit_cost double, gappy double",
    )
    a = findings.analyse({"d": df}, {"d": "key"}, {"d": ["unit_cost", "gappy"]})
    recs = recommend.recommendations(a).collect()
    assert [(r["rank"], r["kind"]) for r in recs] == [(1, "trend"), (2, "missing"), (3, "monitoring"), (4, "targets")]
    assert (recs[0]["kind"], recs[0]["direction"], recs[0]["column"]) == ("trend", "increase", "unit_cost")
    assert (recs[1]["kind"], recs[1]["column"], recs[1]["score"]) == ("missing", "gappy", 18.0)


def test_one_recommendation_per_kind_and_column(spark):
    df = spark.createDataFrame([(i, float(i if i else 9000)) for i in range(40)], "key int, amount double")
    a = findings.analyse({"x": df, "y": df}, {"x": "key", "y": "key"}, {"x": ["amount"], "y": ["amount"]})
    found = [(r["kind"], r["column"]) for r in recommend.recommendations(a).collect()]
    assert len(found) == len(set(found)) and ("outlier", "amount") in found


def test_pooled_view_compares_sources(spark):
    a = spark.createDataFrame([(i, 10.0) for i in range(12)], "key int, amount double")
    b = spark.createDataFrame([(i, 30.0) for i in range(12)], "key int, amount double")
    pooled = sets.tagged_union(a, b, "a.csv", "b.csv")
    report = findings.analyse({"both": pooled}, {"both": "key"}, {"both": ["amount"]})
    shares = {r["text"]: r["value"] for r in findings.findings_table(report).where("metric = 'source_share'").collect()}
    assert shares == {"a": 25.0, "b": 75.0}


def test_gap_of_zero_mean(spark):
    a = spark.createDataFrame([(0.0,)] * 3, "x double")
    b = spark.createDataFrame([(4.0,)] * 3, "x double")
    row = compare.cross_dataset_gap({"a": a, "b": b}).first()
    assert (row["lowest"], row["highest"], row["gap_ratio"]) == (0.0, 4.0, None)


def test_only_sources_of_the_view_are_compared(spark):
    a = spark.createDataFrame([(i, 10.0) for i in range(12)], "key int, amount double")
    b = spark.createDataFrame([(i, 30.0) for i in range(12)], "key int, amount double")
    c = spark.createDataFrame([(i, 999.0) for i in range(12)], "key int, amount double")
    pooled = sets.tagged_union(a, b, "a.csv", "b.csv")
    found = compare.source_comparison(pooled, "amount", {"a.csv": a, "b.csv": b, "c.csv": c}).collect()
    assert {r["source"]: r["share"] for r in found} == {"a": 25.0, "b": 75.0}
    assert compare.source_comparison(pooled.where("_source = 'a'"), "amount", {"c.csv": c}).count() == 0


def _jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()


def test_profile_of_all_datasets_in_few_jobs(spark):
    """Facts, moments and quartiles of several frames come from joint passes: as many jobs for four as for two, but for
    one aggregation each."""
    frames = {
        f"d{k}": spark.range(3_000 + k).selectExpr("id", f"(id * 37 % 1000) * {k + 1}.5 AS amount", "concat('$', id % 90) AS price", "uuid() AS note")
        for k in range(4)
    }
    used = []
    for names in (["d0", "d1"], list(frames)):
        before = _jobs(spark)
        shared = shared_profile.profile_all({n: frames[n] for n in names})
        stats = shared_profile.stats_of_all(shared, {n: ["id", "amount", "price"] for n in names}, direct_rows=100)
        used.append(_jobs(spark) - before)
        for n in names:
            want = statistics.column_stats(shared.surveys[n].df, ["id", "amount", "price"]).orderBy("ordinal").collect()
            got = stats[n].collect()
            assert [r["column"] for r in got] == ["id", "amount", "price"]
            assert all(abs(a[c] - b[c]) <= 1e-9 * (1 + abs(b[c])) for a, b in zip(got, want) for c in b.asDict() if c != "column")
    assert used[0] <= 12 and used[1] <= used[0] + 4


def test_raw_values_and_what_cleaning_changed(spark):
    raw = spark.createDataFrame([(i, float(i if i else 9_000)) for i in range(40)], "key int, amount double")
    cleaned = raw.withColumn("amount", F.least("amount", F.lit(60.0)))
    keys, measures = {"x": "key"}, {"x": ["amount"]}
    facts = findings.findings_table(findings.analyse({"x": cleaned}, keys, measures, {"x": raw}, prefer_raw=True)).collect()
    found = {(r["metric"], r["column"]): r["value"] for r in facts if r["metric"] in ("capped", "max")}
    assert found[("max", "amount")] == 9_000 and found[("capped", "amount")] == 1
    plain = findings.findings_table(findings.analyse({"x": cleaned}, keys, measures, {"x": raw})).collect()
    assert {r["value"] for r in plain if r["metric"] == "max" and r["column"] == "amount"} == {60.0}
    assert not [r for r in plain if r["metric"] == "capped"]


def test_label_pairs_are_counted_and_five_are_shown(spark):
    rows = [(i, f"Station{i % 30:02d}", "a" if i % 2 else "b") for i in range(300)]
    a = findings.analyse({"d": spark.createDataFrame(rows, "key int, name string, kind string")}, {"d": "key"})
    facts = findings.findings_table(a).collect()
    assert len([r for r in facts if r["metric"] == "near_duplicate"]) == 5
    assert [r["value"] for r in facts if r["metric"] == "near_duplicate_pairs"] == [435.0]
    assert findings.summary_totals(a).first()["duplicate_labels"] == 435


def test_all_label_pairs_are_listed_where_asked_for(spark):
    rows = [(i, f"Station{i % 30:02d}", "a" if i % 2 else "b") for i in range(300)]
    a = findings.analyse({"d": spark.createDataFrame(rows, "key int, name string, kind string")}, {"d": "key"}, shown_pairs=None)
    facts = findings.findings_table(a).collect()
    listed = [r["text"] for r in facts if r["metric"] == "near_duplicate"]
    assert len(listed) == len(set(listed)) == 435 and {r["column"] for r in facts if r["metric"] == "near_duplicate"} == {"name"}
    assert [(r["value"], r["text"]) for r in facts if r["metric"] == "rating"] == [(435.0, "Low")]
