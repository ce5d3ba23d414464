"""Profiles, roles, dates and domains of datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.functions import vocabulary as V
from colonnade.operators import profile, statistics
from workload import base as B

_DOC = [("doc_id", 1), ("lang", 0), ("source", 0), ("n_chars", 1), ("quality", 1), ("toxic", 1)]
_S = f"({B.DOC_LABELS})"


def _profile_sql(c: str, number: int) -> str:
    head = f"""SELECT '{c}' AS "column", '{'numeric' if number else 'categorical'}' AS kind, count(*) AS "rows",
 count(*) - count({c}) AS nulls, """
    if not number:
        return head + "NULL AS mean, NULL AS std, NULL AS \"min\", NULL AS \"max\", NULL AS skew, NULL AS p25, NULL AS p50, NULL AS p75, NULL AS distribution FROM " + _S
    g = f"coalesce(skewness({c}), 0.0)"
    return head + f"""round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS "min",
 CAST(max({c}) AS DOUBLE) AS "max", round({g}, 4) AS skew, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25,
 round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75,
 CASE WHEN abs({g}) < 0.5 THEN 'roughly normal' WHEN {g} > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS distribution FROM {_S}"""


@B.query("dataset_profile", " UNION ALL ".join(_profile_sql(c, n) for c, n in _DOC))
def dataset_profile(spark, sf):
    return B.shown(profile.dataset_profile(B.doc_labels(spark, sf)).drop("ordinal"))


@B.query(
    "analysis_plan",
    f"""WITH g AS (SELECT bool_or(quality IS NULL OR toxic IS NULL OR lang IS NULL OR source IS NULL OR n_chars IS NULL) AS gaps FROM {_S}),
 s(step, applies) AS (SELECT 'handle_missing_values', gaps FROM g UNION ALL SELECT unnest(['descriptive_statistics',
 'outlier_detection', 'correlation_analysis', 'anomaly_detection', 'categorical_analysis', 'visualization', 'ai_insight_generation']), true)
 SELECT CAST(row_number() OVER () - 1 AS INT) AS "position", step FROM s WHERE applies""",
)
def analysis_plan(spark, sf):
    return profile.analysis_plan(B.doc_labels(spark, sf))


@B.query(
    "detect_date_column",
    f"""SELECT 'order_date' AS "column", round(avg(CAST(try_strptime(order_date, '%Y-%m-%d') IS NOT NULL AS INT)), 4) AS share,
 0.6 :: DOUBLE AS needed, true AS is_date FROM ({B.DATED_TEXT}) UNION ALL
 SELECT 'priority', round(avg(CAST(try_strptime(priority, '%Y-%m-%d') IS NOT NULL AS INT)), 4), 0.9, false FROM ({B.DATED_TEXT})""",
)
def detect_date_column(spark, sf):
    return B.shown(profile.date_candidates(B.dated_text(spark, sf)).drop("ordinal"))


@B.query(
    "date_range",
    f"""SELECT 'order_date' AS "column", CAST(min(order_date) AS DATE) AS "first", CAST(max(order_date) AS DATE) AS "last" FROM ({B.DATED_TEXT})
 UNION ALL SELECT 'ts', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) FROM events""",
)
def date_range(spark, sf):
    return profile.date_range(B.dated_text(spark, sf)).unionByName(profile.date_range(B.table(spark, sf, "events")))


@B.query(
    "detect_epoch_columns",
    B.each(
        ["k", "t_ms", "t_s", "fx_rate"],
        f"SELECT '{{c}}' AS \"column\", round(avg(CAST({{q}} AS DOUBLE)), 2) AS mean, avg({{q}}) > 1e11 AS is_epoch FROM ({B.EPOCH_COLS})",
    ),
)
def detect_epoch_columns(spark, sf):
    return B.shown(profile.detect_epoch_columns(B.epoch_cols(spark, sf)).drop("ordinal"), 2)


@B.query(
    "detect_rate_columns",
    f"""SELECT 'fx_rate' AS "column", count(fx_rate) AS n, round(avg(fx_rate), 4) AS mean FROM ({B.EPOCH_COLS})""",
)
def detect_rate_columns(spark, sf):
    df = B.epoch_cols(spark, sf)
    names = profile.detect_rate_columns(df)
    return B.shown(statistics.column_stats(df, names).select("column", "n", "mean"))


@B.query(
    "column_roles",
    f"""WITH m AS (SELECT avg(k) AS k, avg(t_ms) AS t_ms, avg(t_s) AS t_s FROM ({B.EPOCH_COLS}))
 SELECT 'k' AS "column", CASE WHEN k > 1e11 THEN 'timestamp' ELSE 'kpi' END AS "role" FROM m
 UNION ALL SELECT 't_ms', CASE WHEN t_ms > 1e11 THEN 'timestamp' ELSE 'kpi' END FROM m
 UNION ALL SELECT 't_s', CASE WHEN t_s > 1e11 THEN 'timestamp' ELSE 'kpi' END FROM m
 UNION ALL SELECT 'fx_rate', 'rate' UNION ALL SELECT 'event_type', 'category' UNION ALL SELECT 'ts', 'date'""",
)
def column_roles(spark, sf):
    return profile.column_roles(B.epoch_cols(spark, sf)).drop("ordinal")


@B.query(
    "null_report",
    f"""SELECT * FROM (SELECT 'quality' AS "column", count(*) - count(quality) AS nulls FROM {_S} UNION ALL
 SELECT 'toxic', count(*) - count(toxic) FROM {_S} UNION ALL SELECT 'lang', count(*) - count(lang) FROM {_S}) WHERE nulls > 0""",
)
def null_report(spark, sf):
    return statistics.null_report(B.doc_labels(spark, sf)).drop("ordinal")


@B.query(
    "year_span",
    f"""SELECT 'year' AS "column", min("year") AS "first", max("year") AS "last" FROM ({B.ENERGY_MIX})
 HAVING avg(CAST("year" BETWEEN 1900 AND 2100 AS INT)) > 0.8""",
)
def year_span(spark, sf):
    return profile.year_span(B.energy_mix(spark, sf)).drop("ordinal")


_TIMES = {"orders": True, "events": True, "customer": False, "documents": False}


@B.query(
    "is_time_like",
    " UNION ALL ".join(f"SELECT '{t}' AS dataset, {str(v).lower()} AS time_like, count(*) AS n FROM {t}" for t, v in _TIMES.items()),
)
def is_time_like(spark, sf):
    out = None
    for name in _TIMES:
        df = B.table(spark, sf, name)
        part = df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("dataset"), F.lit(profile.is_time_like(df)).alias("time_like"), "n"
        )
        out = part if out is None else out.unionByName(part)
    return out


_DOMAIN_TABLES = {
    "documents": (["doc_id", "text", "lang", "source", "n_chars"], "text || ' ' || lang || ' ' || source"),
    "orders": (
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
        "o_orderstatus || ' ' || o_orderpriority",
    ),
    "part": (["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "p_name || ' ' || p_brand || ' ' || p_type"),
}


def _domain_sql() -> str:
    words = ", ".join(
        f"({i}, '{d}', '{w}')" for i, (d, ws) in enumerate(V.DOMAIN_KEYWORDS.items()) for w in ws
    )
    hits = " UNION ALL ".join(
        f"""SELECT w, CAST(max(CAST(contains('{' '.join(cols)}', w) OR contains(lower({text}), w) AS INT)) AS BIGINT) AS hit
 FROM (SELECT DISTINCT w FROM k), {t} GROUP BY w"""
        for t, (cols, text) in _DOMAIN_TABLES.items()
    )
    return f"""WITH k(i, domain, w) AS (VALUES {words}), h AS ({hits})
 SELECT domain, CAST(sum(hit) AS BIGINT) AS score FROM k JOIN h USING (w) GROUP BY domain"""


@B.query("domain_scores", _domain_sql())
def domain_scores(spark, sf):
    return profile.domain_scores({t: B.table(spark, sf, t) for t in _DOMAIN_TABLES}).drop("ordinal")


@B.query(
    "detect_domain",
    f"""SELECT domain, (SELECT count(*) FROM documents) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) AS records
 FROM ({_domain_sql()}) ORDER BY score DESC, list_position({list(V.DOMAIN_KEYWORDS)}, domain) LIMIT 1""",
)
def detect_domain(spark, sf):
    tables = {t: B.table(spark, sf, t) for t in _DOMAIN_TABLES}
    records = sum(df.count() for df in tables.values())
    return spark.createDataFrame([(profile.detect_domain(tables), records)], "domain string, records long")
