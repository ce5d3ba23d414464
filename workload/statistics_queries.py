"""Grouped aggregates, column statistics and chart rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade import config
from colonnade.operators import aggregates, anomaly, charts, statistics
from workload import base as B

_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_SQL_AGG = {
    "count": 'CAST(count({y}) AS DOUBLE)', "sum": "coalesce(sum({y}), 0.0)", "mean": "avg({y})",
    "median": "quantile_cont({y}, 0.5)", "min": "min({y})", "max": "max({y})",
}


def _group_sql(source: str, x: str, y: str, func: str, limit: int | None = None) -> str:
    digits = 2 if func == "sum" else 4
    value = _SQL_AGG[func].format(y=y)
    value = f"count({y})" if func == "count" else f"round(CAST({value} AS DOUBLE), {digits})"
    tail = f" ORDER BY 2 DESC NULLS LAST, 1 LIMIT {limit}" if limit else ""
    return f'SELECT {x}, {value} AS "value" FROM {source} WHERE {x} IS NOT NULL GROUP BY {x}{tail}'


def _register_group_agg(func: str) -> None:
    @B.query(f"group_agg_{func}", _group_sql("orders", "o_orderpriority", "o_totalprice", func))
    def run(spark, sf, func=func):
        df = aggregates.group_agg(B.table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", func)
        return B.shown(df, value=2 if func == "sum" else 4)


for _func in aggregates.AGGREGATES:
    _register_group_agg(_func)


@B.query("group_agg_gaps", _group_sql(f"({B.ORDER_GAPS})", "priority", "price", "sum"))
def group_agg_gaps(spark, sf):
    return B.shown(aggregates.group_agg(B.order_gaps(spark, sf), "priority", "price", "sum"), value=2)


@B.query(
    "value_counts",
    'SELECT source, count(*) AS "count" FROM documents GROUP BY source ORDER BY 2 DESC, 1 LIMIT 20',
)
def value_counts(spark, sf):
    return aggregates.value_counts(B.table(spark, sf, "documents"), "source", 20)


_EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@B.query("nunique", B.each(_EVENTS, "SELECT '{c}' AS \"column\", count(DISTINCT {q}) AS \"nunique\" FROM events"))
def nunique(spark, sf):
    return statistics.nunique(B.table(spark, sf, "events")).drop("ordinal")


@B.query("nunique_approx")
def nunique_approx(spark, sf):
    return statistics.nunique(B.table(spark, sf, "events"), approx=True).drop("ordinal")


_DOC = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


@B.query("null_counts", B.each(_DOC, f"SELECT '{{c}}' AS \"column\", count(*) - count({{q}}) AS nulls FROM ({B.DOC_LABELS})"))
def null_counts(spark, sf):
    return statistics.null_counts(B.doc_labels(spark, sf)).drop("ordinal")


@B.query(
    "null_total",
    f"SELECT CAST(sum(n) AS BIGINT) AS nulls FROM ({B.each(_DOC, 'SELECT count(*) - count({q}) AS n FROM (' + B.DOC_LABELS + ')')})",
)
def null_total(spark, sf):
    return statistics.null_total(B.doc_labels(spark, sf))


@B.query(
    "describe",
    f"""SELECT "column", n AS "count", round(mean, 4) AS mean, round(std, 4) AS std, round("min", 4) AS "min",
 round(q1, 4) AS p25, round(median, 4) AS p50, round(q3, 4) AS p75, round("max", 4) AS "max"
 FROM ({B.stats_sql('(' + B.DOC_LABELS + ')', ['doc_id', 'n_chars', 'quality', 'toxic'])})""",
)
def describe(spark, sf):
    return B.shown(statistics.describe(B.doc_labels(spark, sf)))


def _stats_sql(source: str, columns: list[str]) -> str:
    return f"""SELECT "column", n, round("sum", 2) AS "sum", round(mean, 4) AS mean, round(std, 4) AS std,
 round("min", 4) AS "min", round("max", 4) AS "max", round(skew, 4) AS skew, round(q1, 4) AS q1,
 round(median, 4) AS median, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr FROM ({B.stats_sql(source, columns)}) WHERE n >= 3"""


@B.query("column_stats", _stats_sql("lineitem", _LINE_NUMBERS))
def column_stats(spark, sf):
    return B.shown(statistics.column_stats(B.table(spark, sf, "lineitem"), _LINE_NUMBERS).drop("ordinal"), sum=2)


@B.query("column_stats_gaps", _stats_sql(f"({B.DOC_LABELS})", ["n_chars", "quality", "toxic"]))
def column_stats_gaps(spark, sf):
    """The same through bracket refinement, the way large frames go."""
    stats = statistics.column_stats(B.doc_labels(spark, sf), ["n_chars", "quality", "toxic"], direct_rows=50)
    return B.shown(stats.drop("ordinal"), sum=2)


def _segments_sql(source: str, x: str, y: str) -> str:
    return f"""SELECT {x} AS segment, count({y}) AS "count", round(coalesce(sum({y}), 0.0), 2) AS "sum",
 round(avg({y}), 4) AS mean, round(quantile_cont({y}, 0.5), 4) AS median,
 round(coalesce(sum({y}), 0.0) / (SELECT sum({y}) FROM {source}) * 100, 4) AS share FROM {source}
 WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY coalesce(sum({y}), 0.0) DESC, 1 LIMIT 8"""


@B.query("segment_breakdown", _segments_sql("part", "p_brand", "p_retailprice"))
def segment_breakdown(spark, sf):
    return B.shown(aggregates.segment_breakdown(B.table(spark, sf, "part"), "p_brand", "p_retailprice"), sum=2)


@B.query("segment_breakdown_gaps", _segments_sql(f"({B.ORDER_GAPS})", "priority", "price"))
def segment_breakdown_gaps(spark, sf):
    """Rows without a segment count in the total only; medians come through bracket refinement."""
    df = aggregates.segment_breakdown(B.order_gaps(spark, sf), "priority", "price", direct_rows=500)
    return B.shown(df, sum=2)


@B.query(
    "kpi_cards",
    f"""SELECT 'doc_labels' AS dataset, count(*) AS "rows", 6 AS cols, 4 AS numeric_cols,
 2 * count(*) - count(quality) - count(toxic) AS nulls FROM ({B.DOC_LABELS})""",
)
def kpi_cards(spark, sf):
    return statistics.kpi_cards(B.doc_labels(spark, sf), "doc_labels")


_PAIRS = [(a, b) for i, a in enumerate(_LINE_NUMBERS) for b in _LINE_NUMBERS[i + 1:]]


@B.query(
    "pearson_corr",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS
    ),
)
def pearson_corr(spark, sf):
    return B.shown(statistics.pearson_corr(B.table(spark, sf, "lineitem"), _LINE_NUMBERS), 6)


def _mode_sql(source: str, columns: list[str]) -> str:
    return B.each(
        columns,
        f"""SELECT '{{c}}' AS "column", (SELECT CAST({{q}} AS VARCHAR) FROM {source} WHERE {{q}} IS NOT NULL
 GROUP BY {{q}} ORDER BY count(*) DESC, CAST({{q}} AS VARCHAR) LIMIT 1) AS "value" """,
    )


@B.query("mode_value", _mode_sql(f"({B.ORDER_GAPS})", ["priority", "status"]))
def mode_value(spark, sf):
    return aggregates.mode_values(B.order_gaps(spark, sf), ["priority", "status"])


def scored_pair(spark, sf):
    """Customers and suppliers scored by one forest on their common numbers."""
    scored, common = anomaly.unified_anomaly(
        B.shared_pair(spark, sf), {"customer.csv": "custkey", "supplier.csv": "suppkey"}
    )
    return scored, common


@B.query("status_breakdown")
def status_breakdown(spark, sf):
    return aggregates.status_breakdown(scored_pair(spark, sf)[0])


@B.query(
    "distribution_class",
    f"""SELECT "column", n, round(skew, 4) AS skew, CASE WHEN abs(skew) < 0.5 THEN 'roughly normal'
 WHEN skew > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS distribution
 FROM ({B.each(['event_id', 'user_id', 'value'], "SELECT '{c}' AS " + '"column"' + ", count({q}) AS n, skewness({q}) AS skew FROM events")})""",
)
def distribution_class(spark, sf):
    return B.shown(statistics.distribution_class(B.table(spark, sf, "events")).drop("ordinal"))


@B.query(
    "high_variability",
    f"""SELECT "column", round(abs(std / mean) * 100, 4) AS cv FROM ({B.stats_sql('lineitem', _LINE_NUMBERS)})
 WHERE mean <> 0 AND abs(std / mean) * 100 > 50""",
)
def high_variability(spark, sf):
    stats = statistics.column_stats(B.table(spark, sf, "lineitem"), _LINE_NUMBERS)
    return B.shown(statistics.high_variability(stats).select("column", "cv"))


@B.query(
    "quick_summary",
    f"""SELECT 'customer' AS dataset, (SELECT count(*) FROM customer) AS "rows", 3 AS numeric_cols, CAST(0 AS BIGINT) AS nulls,
 "column", round(mean, 4) AS mean, round(median, 4) AS median, round("max", 4) AS "max"
 FROM ({B.stats_sql('customer', ['c_custkey', 'c_nationkey', 'c_acctbal'])})""",
)
def quick_summary(spark, sf):
    return B.shown(statistics.quick_summary(B.table(spark, sf, "customer"), "customer"))


# ---- chart rows ---------------------------------------------------------------------------------


@B.query(
    "bar_counts",
    """SELECT p_brand, count(*) AS "count", (SELECT count(DISTINCT p_brand) FROM part) AS total_categories
 FROM part GROUP BY p_brand ORDER BY 2 DESC, 1 LIMIT 20""",
)
def bar_counts(spark, sf):
    return charts.bar_counts(B.table(spark, sf, "part"), "p_brand")


@B.query(
    "bar_agg",
    """SELECT p_brand, round(avg(p_retailprice), 4) AS "value", (SELECT count(DISTINCT p_brand) FROM part) AS total_categories
 FROM part GROUP BY p_brand ORDER BY avg(p_retailprice) DESC, 1 LIMIT 20""",
)
def bar_agg(spark, sf):
    return B.shown(charts.bar_agg(B.table(spark, sf, "part"), "p_brand", "p_retailprice", "mean"))


@B.query(
    "bar_agg_median",
    """SELECT user_id, round(quantile_cont("value", 0.5), 4) AS "value", (SELECT count(DISTINCT user_id) FROM events) AS total_categories
 FROM events GROUP BY user_id ORDER BY quantile_cont("value", 0.5) DESC, 1 LIMIT 20""",
)
def bar_agg_median(spark, sf):
    return B.shown(charts.bar_agg(B.table(spark, sf, "events"), "user_id", "value", "median"))


@B.query(
    "pie_counts",
    """SELECT *, round("count" / sum("count") OVER () * 100, 4) AS share FROM
 (SELECT event_type, count(*) AS "count" FROM events GROUP BY event_type ORDER BY 2 DESC, 1 LIMIT 8)""",
)
def pie_counts(spark, sf):
    return B.shown(charts.pie_counts(B.table(spark, sf, "events"), "event_type"))


@B.query(
    "pie_agg",
    """SELECT source, round(v, 2) AS "value", round(v / sum(v) OVER () * 100, 4) AS share FROM
 (SELECT source, CAST(sum(n_chars) AS DOUBLE) AS v FROM documents GROUP BY source ORDER BY 2 DESC, 1 LIMIT 8)""",
)
def pie_agg(spark, sf):
    return B.shown(charts.pie_agg(B.table(spark, sf, "documents"), "source", "n_chars", "sum"), value=2)


def _hist_sql(measure: str, source: str, x: str, empty: str) -> str:
    return f"""WITH r AS (SELECT min({x}) AS lo, max({x}) AS hi, (max({x}) - min({x})) / 40 AS w FROM {source}),
 b AS (SELECT CAST(least(39, floor(({x} - lo) / w)) AS INT) AS bin, {measure} AS m FROM {source}, r WHERE {x} IS NOT NULL GROUP BY 1)
 SELECT CAST(g.i AS INT) AS bin, round(lo + g.i * w, 6) AS low, round(lo + (g.i + 1) * w, 6) AS high, {empty}
 FROM range(40) g(i) CROSS JOIN r LEFT JOIN b ON b.bin = g.i"""


@B.query("histogram", _hist_sql("count(*)", "events", '"value"', 'coalesce(m, 0) AS "count"'))
def histogram(spark, sf):
    return B.shown(charts.histogram(B.table(spark, sf, "events"), "value"), 6)


@B.query("histogram_agg", _hist_sql("avg(user_id)", "events", '"value"', 'round(m, 4) AS "value"'))
def histogram_agg(spark, sf):
    return B.shown(charts.histogram_agg(B.table(spark, sf, "events"), "value", "user_id", "median"), low=6, high=6)


def _box_sql(source: str, x: str, group: str | None) -> str:
    keys = f"{group} AS \"group\", " if group else ""
    by = f"GROUP BY {group}" if group else ""
    match = f"ON s.{group} = f.g" if group else "ON true"
    head = 'f.g AS "group"' if group else f"'{x.strip(chr(34))}' AS \"column\""
    return f"""WITH f AS (SELECT {group + ' AS g, ' if group else ''}quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS q2,
 quantile_cont({x}, 0.75) AS q3 FROM {source} {by})
 SELECT {head}, round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
 min({x}) FILTER ({x} >= q1 - 1.5 * (q3 - q1) AND {x} <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
 max({x}) FILTER ({x} >= q1 - 1.5 * (q3 - q1) AND {x} <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
 count(*) FILTER ({x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) AS outliers,
 min({x}) AS "min", max({x}) AS "max", count({x}) AS n FROM {source} s JOIN f {match} {'GROUP BY f.g' if group else ''}"""


@B.query("box_stats", _box_sql("events", '"value"', None))
def box_stats(spark, sf):
    return B.shown(charts.box_stats(B.table(spark, sf, "events"), "value"))


@B.query("box_by_group", _box_sql("events", '"value"', "event_type"))
def box_by_group(spark, sf):
    return B.shown(charts.box_by_group(B.table(spark, sf, "events"), "event_type", "value"))


@B.query("line_xy", "SELECT p_size, p_retailprice FROM part ORDER BY p_size, p_retailprice")
def line_xy(spark, sf):
    return charts.line_xy(B.table(spark, sf, "part"), "p_size", "p_retailprice")


@B.query("line_agg", _group_sql("lineitem", "l_returnflag", "l_extendedprice", "median"))
def line_agg(spark, sf):
    return B.shown(charts.line_agg(B.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", "median"))


@B.query("line_series", 'SELECT event_id, "value" FROM events ORDER BY event_id')
def line_series(spark, sf):
    return charts.line_series(B.table(spark, sf, "events"), "value", "event_id")


@B.query("scatter_xy", "SELECT l_quantity, l_extendedprice FROM lineitem")
def scatter_xy(spark, sf):
    return charts.scatter_xy(B.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@B.query("scatter_series", "SELECT o_orderkey, o_totalprice FROM orders")
def scatter_series(spark, sf):
    return charts.scatter_series(B.table(spark, sf, "orders"), "o_totalprice", "o_orderkey")


_PART = [("p_partkey", 1), ("p_name", 0), ("p_brand", 0), ("p_type", 0), ("p_size", 1), ("p_retailprice", 1)]
_FACTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{'numeric' if number else 'categorical'}' AS kind, count(DISTINCT {c}) AS u,
 {f'skewness({c})' if number else 'NULL'} AS g FROM part"""
    for c, number in _PART
)
_SUGGESTED = f"""SELECT *, CASE WHEN kind = 'categorical' THEN 'pie' WHEN abs(g) >= 0.5 THEN 'histogram' WHEN abs(g) < 0.5 THEN 'box'
 ELSE 'bar' END AS suggested FROM ({_FACTS})"""


@B.query("fallback_chart", f'SELECT "column", kind, suggested FROM ({_SUGGESTED})')
def fallback_chart(spark, sf):
    return charts.chart_choices(B.table(spark, sf, "part")).select("column", "kind", "suggested")


def _guard_sql(wanted: str) -> str:
    return f"""SELECT '{wanted}' AS wanted, "column", u AS "nunique", CASE
 WHEN '{wanted}' = 'pie' AND u > 8 THEN 'bar' WHEN '{wanted}' IN ('pie', 'bar') AND kind = 'numeric' AND u > 20 THEN 'histogram'
 WHEN '{wanted}' = 'histogram' AND u < 6 THEN 'bar' WHEN '{wanted}' = 'line' AND kind <> 'numeric' THEN 'bar'
 WHEN '{wanted}' IN ('histogram', 'box') AND kind <> 'numeric' THEN 'bar' ELSE '{wanted}' END AS chart FROM ({_FACTS})"""


@B.query("chart_guards", " UNION ALL ".join(_guard_sql(w) for w in charts.CHARTS))
def chart_guards(spark, sf):
    part = B.table(spark, sf, "part")
    parts = [
        charts.chart_choices(part, F.lit(w)).select(F.lit(w).alias("wanted"), "column", "nunique", "chart")
        for w in charts.CHARTS
    ]
    return reduce(DataFrame.unionByName, parts)


@B.query(
    "best_y_for_category",
    f"""SELECT "column", round(std, 4) AS std FROM ({B.stats_sql('customer', ['c_custkey', 'c_nationkey', 'c_acctbal'])})
 ORDER BY 2 DESC, 1 LIMIT 1""",
)
def best_y_for_category(spark, sf):
    return B.shown(charts.best_y_for_category(B.table(spark, sf, "customer")))


@B.query(
    "best_pair_for_scatter",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(abs(corr(l_quantity, {c})), 6) AS strength FROM lineitem"
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    )
    + ") ORDER BY strength DESC LIMIT 1",
)
def best_pair_for_scatter(spark, sf):
    return B.shown(charts.best_pair_for_scatter(B.table(spark, sf, "lineitem"), "l_quantity"), 6)


@B.query("auto_charts")
def auto_charts(spark, sf):
    return B.shown(charts.auto_chart_rows(B.table(spark, sf, "part").select([c for c, _ in _PART]), "p_partkey"))
