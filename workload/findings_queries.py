"""Outliers, anomalies, similar rows, trends, comparisons and the ranked report."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.functions import vocabulary as V
from colonnade.operators import anomaly, cleaning, compare, label_links, outliers, quality, segments, sets, similarity, statistics, trends
from colonnade.operators.aggregates import segment_breakdown
from colonnade.plans import findings, recommend
from workload import base as B
from workload.statistics_queries import scored_pair

_ENERGY = f"({B.ENERGY_MIX})"
_DOCS = f"({B.DOC_LABELS})"
_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# ---- outliers -----------------------------------------------------------------------------------


def _count_outside(dataset: str, source: str, column: str) -> str:
    return f"""SELECT '{dataset}' AS dataset, '{column}' AS "column", count(*) AS outliers FROM {source}, (SELECT
 quantile_cont("{column}", 0.25) AS q1, quantile_cont("{column}", 0.75) AS q3 FROM {source})
 WHERE q3 > q1 AND ("{column}" < q1 - 1.5 * (q3 - q1) OR "{column}" > q3 + 1.5 * (q3 - q1)) HAVING count(*) > 0"""


@B.query(
    "iqr_outlier_counts",
    " UNION ALL ".join(
        _count_outside(t, t, c)
        for t, cs in {
            "events": ["event_id", "user_id", "value"],
            "documents": ["doc_id", "n_chars"],
            "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_LINE_NUMBERS],
        }.items()
        for c in cs
    ),
)
def iqr_outlier_counts(spark, sf):
    return outliers.iqr_outlier_counts({t: B.table(spark, sf, t) for t in ("events", "documents", "lineitem")})


_SPIKE = """SELECT "column", round("value", 4) AS "value", round(median, 4) AS median, round(iqr, 4) AS iqr, distance_iqr,
 "count", is_high FROM """


@B.query("spike_value", _SPIKE + f"({B.spikes_sql('events', ['event_id', 'user_id', 'value'])})")
def spike_value(spark, sf):
    return B.shown(outliers.spike_value(B.table(spark, sf, "events")).drop("ordinal"))


@B.query("spike_value_refined", _SPIKE + f"({B.spikes_sql('documents', ['n_chars'])})")
def spike_value_refined(spark, sf):
    """Quartiles through bracket refinement, the way large frames go."""
    return B.shown(outliers.spike_value(B.table(spark, sf, "documents"), ["n_chars"], direct_rows=100).drop("ordinal"))


@B.query(
    "spike_severity",
    f"""SELECT CASE WHEN distance_iqr > 5 THEN 'severe' ELSE 'moderate' END AS severity, count(*) AS metrics,
 CAST(sum("count") AS BIGINT) AS records FROM ({B.spikes_sql('events', ['value'])} UNION ALL {B.spikes_sql('documents', ['n_chars'])}) GROUP BY 1""",
)
def spike_severity(spark, sf):
    both = outliers.spike_value(B.table(spark, sf, "events"), ["value"]).unionByName(
        outliers.spike_value(B.table(spark, sf, "documents"), ["n_chars"])
    )
    return outliers.spike_severity(both)


# ---- anomalies and similar rows -----------------------------------------------------------------


@B.query("isolation_forest")
def isolation_forest(spark, sf):
    lines = B.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", *_LINE_NUMBERS)
    return anomaly.isolation_forest(lines, lines.columns, _LINE_NUMBERS)


@B.query("isolation_forest_unified")
def isolation_forest_unified(spark, sf):
    return scored_pair(spark, sf)[0]


@B.query("isolation_forest_per_source")
def isolation_forest_per_source(spark, sf):
    return anomaly.unified_anomaly(
        {"events": B.table(spark, sf, "events"), "part": B.table(spark, sf, "part")},
        {"events": "event_id", "part": "p_partkey"},
    )[0]


@B.query("anomaly_summary")
def anomaly_summary(spark, sf):
    return anomaly.anomaly_summary(scored_pair(spark, sf)[0])


@B.query("anomaly_contrast")
def anomaly_contrast(spark, sf):
    return anomaly.anomaly_contrast(*scored_pair(spark, sf))


def _similar_sql(source: str, key: str, target: int, features: list[str]) -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in features)
    zs = ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in features)
    dot = " + ".join(f"z.z_{c} * t.z_{c}" for c in features)
    own = " + ".join(f"z.z_{c} * z.z_{c}" for c in features)
    his = " + ".join(f"t.z_{c} * t.z_{c}" for c in features)
    return f"""WITH m AS (SELECT {stats} FROM {source}), z AS (SELECT {key}, {zs} FROM {source}, m),
 c AS (SELECT z.{key}, ({dot}) / (sqrt({own}) * sqrt({his})) AS score FROM z, z t WHERE t.{key} = {target} AND z.{key} <> {target})
 SELECT round(score, 4) AS similarity_score, s.* FROM c JOIN {source} s USING ({key}) ORDER BY round(score, 9) DESC, {key} LIMIT 5"""


@B.query("similar_rows", _similar_sql("part", "p_partkey", 7, ["p_size", "p_retailprice"]))
def similar_rows(spark, sf):
    return similarity.similar_rows(B.table(spark, sf, "part"), "p_partkey", 7)


@B.query("similar_rows_orders", _similar_sql("orders", "o_orderkey", 12, ["o_custkey", "o_totalprice"]))
def similar_rows_orders(spark, sf):
    return similarity.similar_rows(B.table(spark, sf, "orders"), "o_orderkey", 12)


# ---- trends, segments, metrics ------------------------------------------------------------------

_TREND = """SELECT "column", round(first_avg, 4) AS first_avg, round(second_avg, 4) AS second_avg, change_pct, direction FROM """


@B.query("half_split_trend", _TREND + f"({B.trends_sql('events', ['user_id', 'value'], 'ts', 'event_id')})")
def half_split_trend(spark, sf):
    events = B.table(spark, sf, "events")
    return B.shown(trends.half_split_trend(events, "ts", "event_id", min_change=0.5).drop("ordinal"))


@B.query(
    "half_split_trend_ties",
    _TREND + f"({B.trends_sql(_ENERGY, ['consumption_kwh', 'toe', 'emission', 'year'], 'read_on', 'reading')})",
)
def half_split_trend_ties(spark, sf):
    """Several readings share the dividing date."""
    df = B.energy_mix(spark, sf)
    return B.shown(
        trends.half_split_trend(df, "read_on", "reading", ["consumption_kwh", "toe", "emission", "year"]).drop("ordinal")
    )


@B.query(
    "half_split_trend_text",
    _TREND + f"({B.trends_sql('(' + B.DATED_TEXT + ')', ['k', 'v'], 'order_date', 'k')})",
)
def half_split_trend_text(spark, sf):
    """Dates held as text; the dividing row through bracket refinement."""
    df = B.dated_text(spark, sf)
    return B.shown(trends.half_split_trend(df, "order_date", "k", ["k", "v"], direct_rows=100).drop("ordinal"))


_PREFER = {"p_name": 1, "p_brand": 0, "p_type": 1}


@B.query(
    "primary_dimension",
    f"""SELECT "column", u AS "nunique" FROM ({' UNION ALL '.join(
        f"SELECT '{c}' AS " + '"column"' + f", count(DISTINCT {c}) AS u, {p} AS pref FROM part" for c, p in _PREFER.items())})
 WHERE u BETWEEN 2 AND least(50, greatest(2, (SELECT count(*) FROM part) // 2))
 ORDER BY pref DESC, abs(u - 8), "column" DESC LIMIT 1""",
)
def primary_dimension(spark, sf):
    return segments.primary_dimension(B.table(spark, sf, "part"))


@B.query(
    "segment_breakdown_primary",
    f"""WITH k AS (SELECT 'toe' AS kpi) SELECT fuel AS segment, count(toe) AS "count", round(sum(toe), 2) AS "sum",
 round(avg(toe), 4) AS mean, quantile_cont(toe, 0.5) AS median, round(sum(toe) / (SELECT sum(toe) FROM {_ENERGY}) * 100, 4) AS share
 FROM {_ENERGY} GROUP BY fuel""",
)
def segment_breakdown_primary(spark, sf):
    """The primary dimension broken down by the primary metric of the domain."""
    df = B.energy_mix(spark, sf)
    stats = statistics.column_stats(df, ["consumption_kwh", "toe", "emission"])
    kpi = segments.primary_kpi(stats, V.ENERGY).first()["column"]
    dimension = segments.primary_dimension(df, ["site", "fuel"]).first()["column"]
    return B.shown(segment_breakdown(df, dimension, kpi), sum=2)


@B.query(
    "concentration",
    f"""SELECT segment, round(share, 4) AS share FROM (SELECT event_type = 'x' AS other, event_type AS segment, sum(user_id) AS total,
 sum(user_id) / (SELECT sum(user_id) FROM events) * 100 AS share FROM events GROUP BY event_type ORDER BY total DESC, segment LIMIT 1)
 WHERE share >= 20""",
)
def concentration(spark, sf):
    parts = segment_breakdown(B.table(spark, sf, "events"), "event_type", "user_id")
    return B.shown(segments.concentration(parts, 20.0))


_KPIS = ["consumption_kwh", "toe", "emission", "year"]


@B.query(
    "primary_kpi",
    f"""SELECT * FROM (SELECT 'Energy' AS domain, "column", round("sum", 2) AS "sum" FROM ({B.stats_sql(_ENERGY, _KPIS)})
  WHERE contains("column", 'toe') ORDER BY abs("sum") DESC LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'Finance', "column", round("sum", 2) FROM ({B.stats_sql(_ENERGY, _KPIS)}) ORDER BY abs("sum") DESC LIMIT 1)""",
)
def primary_kpi(spark, sf):
    stats = statistics.column_stats(B.energy_mix(spark, sf), _KPIS)
    picks = [
        segments.primary_kpi(stats, d).select(F.lit(d).alias("domain"), "column", "sum") for d in (V.ENERGY, "Finance")
    ]
    return B.shown(picks[0].unionByName(picks[1]), sum=2)


@B.query(
    "rank_kpis",
    f"""WITH s AS ({B.stats_sql(_ENERGY, _KPIS)}), t AS ({B.trends_sql(_ENERGY, _KPIS, 'read_on', 'reading')}),
 p AS ({B.spikes_sql(_ENERGY, _KPIS)})
 SELECT "column", "column" = 'toe' AS "primary", coalesce(abs(t.change_pct), 0) AS trend, coalesce(p.distance_iqr, 0) AS distance_iqr,
 round(abs(s.std / s.mean) * 100, 4) AS cv FROM s LEFT JOIN t USING ("column") LEFT JOIN p USING ("column")
 ORDER BY 2 DESC, 3 DESC, 4 DESC, 5 DESC LIMIT 3""",
)
def rank_kpis(spark, sf):
    df = B.energy_mix(spark, sf)
    ranked = segments.rank_kpis(
        statistics.column_stats(df, _KPIS),
        trends.half_split_trend(df, "read_on", "reading", _KPIS),
        outliers.spike_value(df, _KPIS),
        V.ENERGY,
    )
    return B.shown(ranked.drop("ordinal", "rank"))


_DIRECTIONS = {"consumption_kwh": "higher_is_bad", "toe": "higher_is_bad", "emission": "higher_is_bad", "year": "neutral"}


@B.query(
    "metric_direction",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(\"{c}\") AS n, '{d}' AS direction FROM {_ENERGY}" for c, d in _DIRECTIONS.items()
    )
    + f" UNION ALL SELECT 'quality', count(quality), 'higher_is_good' FROM {_DOCS}",
)
def metric_direction(spark, sf):
    stats = statistics.column_stats(B.energy_mix(spark, sf), _KPIS).unionByName(
        statistics.column_stats(B.doc_labels(spark, sf), ["quality"])
    )
    return stats.select("column", "n", segments.metric_direction(F.col("column")).alias("direction"))


@B.query(
    "volumetric_flag",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(CAST(sum(\"{c}\") AS DOUBLE), 2) AS \"sum\", {str(c != 'toe').lower()} AS volumetric FROM {_ENERGY}" for c in _KPIS
    ),
)
def volumetric_flag(spark, sf):
    stats = statistics.column_stats(B.energy_mix(spark, sf), _KPIS)
    return B.shown(
        stats.select("column", "sum", segments.is_volumetric(F.col("column"), V.ENERGY).alias("volumetric")), sum=2
    )


_KEYED = {
    "bigkeys": ("o_orderkey + 1152921504606846976", "k"),
    "nullkeys": ("nullif(o_orderkey, (SELECT min(o_orderkey) FROM orders))", "k NULLS LAST"),
    "textkeys": ("'key-' || CAST(o_orderkey AS VARCHAR)", "k"),
}


def _keyed_sql(kind: str) -> str:
    key, order = _KEYED[kind]
    source = f"(SELECT date_trunc('year', o_orderdate) AS d, {key} AS k, o_totalprice FROM orders)"
    return f"""SELECT first_avg, second_avg FROM (SELECT round(avg(o_totalprice) FILTER (early), 4) AS first_avg,
 round(avg(o_totalprice) FILTER (NOT early), 4) AS second_avg FROM (SELECT *, row_number() OVER (ORDER BY d, {order})
 <= (SELECT count(*) FROM orders) // 2 AS early FROM {source}))"""


def _keyed(spark, sf, key):
    orders = B.table(spark, sf, "orders").select(F.date_trunc("year", "o_orderdate").alias("d"), key.alias("k"), "o_totalprice")
    return B.shown(trends.half_split_trend(orders, "d", "k", ["o_totalprice"], min_change=0).select("first_avg", "second_avg"))


@B.query("half_split_trend_bigkeys", _keyed_sql("bigkeys"))
def half_split_trend_bigkeys(spark, sf):
    return _keyed(spark, sf, F.col("o_orderkey") + F.lit(1152921504606846976))


@B.query("half_split_trend_nullkeys", _keyed_sql("nullkeys"))
def half_split_trend_nullkeys(spark, sf):
    least = B.table(spark, sf, "orders").agg(F.min("o_orderkey")).first()[0]
    return _keyed(spark, sf, F.nullif(F.col("o_orderkey"), F.lit(least)))


@B.query("half_split_trend_textkeys", _keyed_sql("textkeys"))
def half_split_trend_textkeys(spark, sf):
    return _keyed(spark, sf, F.concat(F.lit("key-"), F.col("o_orderkey").cast("string")))


# ---- quality and comparisons --------------------------------------------------------------------


def labels_sql(source: str, columns: list[str], limit: int | None = None) -> str:
    counted = B.each(
        columns, f"SELECT {{i}} AS o, '{{c}}' AS \"column\", {{q}} AS label, count(*) AS n FROM {source} WHERE {{q}} IS NOT NULL GROUP BY {{q}}"
    )
    tail = f" LIMIT {limit}" if limit else ""
    return f"""SELECT "column", a, b, rows_a, rows_b, edits FROM (WITH l AS ({counted})
 SELECT x.o, x."column", x.label AS a, y.label AS b, x.n AS rows_a, y.n AS rows_b, CAST(levenshtein(x.label, y.label) AS INT) AS edits
 FROM l x JOIN l y ON x."column" = y."column" AND (x.n > y.n OR (x.n = y.n AND x.label < y.label))
 WHERE length(x.label) >= 5 AND length(y.label) >= 5
 AND levenshtein(x.label, y.label) BETWEEN 1 AND 2 ORDER BY o, rows_a DESC, a, rows_b DESC, b{tail})"""


@B.query("near_duplicate_labels", labels_sql("part", ["p_name", "p_brand", "p_type"]))
def near_duplicate_labels(spark, sf):
    return quality.near_duplicate_labels(B.table(spark, sf, "part"))


@B.query("near_duplicate_labels_top", labels_sql("part", ["p_name", "p_brand", "p_type"], 5))
def near_duplicate_labels_top(spark, sf):
    return quality.near_duplicate_labels(B.table(spark, sf, "part"), limit=5)


@B.query("near_duplicate_labels_all", labels_sql("customer", ["c_name", "c_mktsegment"]))
def near_duplicate_labels_all(spark, sf):
    return quality.near_duplicate_labels(B.table(spark, sf, "customer"))


@B.query("near_duplicate_labels_typos", labels_sql(f"({B.TYPO_LABELS})", ["label", "name"]))
def near_duplicate_labels_typos(spark, sf):
    return quality.near_duplicate_labels(B.typo_labels(spark, sf))


def link_counts_sql(source: str, columns: list[str]) -> str:
    counted = B.each(
        columns, f"SELECT '{{c}}' AS \"column\", {{q}} AS label, count(*) AS n FROM {source} WHERE {{q}} IS NOT NULL GROUP BY {{q}}"
    )
    return f"""WITH RECURSIVE l AS (SELECT * FROM ({counted}) WHERE length(label) >= 5),
 e AS (SELECT x."column", x.label AS u, y.label AS v FROM l x JOIN l y ON x."column" = y."column" AND x.label <> y.label
 AND abs(length(x.label) - length(y.label)) <= 2 AND levenshtein(x.label, y.label) <= 2),
 s AS (SELECT "column", u, least(u, min(v)) AS v FROM e GROUP BY "column", u),
 r AS (SELECT "column", u, v FROM s UNION SELECT r."column", e.v, r.v FROM r JOIN e ON e."column" = r."column" AND e.u = r.u
 JOIN s ON s."column" = e."column" AND s.u = e.v WHERE r.v < s.v),
 f AS (SELECT "column", u, min(v) AS "first" FROM r GROUP BY "column", u),
 k AS (SELECT "column", u, count(*) AS links FROM e GROUP BY "column", u)
 SELECT l."column", l.label, n, links, "first", count(*) OVER (PARTITION BY l."column", "first") AS size
 FROM l JOIN k ON k."column" = l."column" AND k.u = l.label JOIN f ON f."column" = l."column" AND f.u = l.label"""


@B.query("near_duplicate_link_counts", link_counts_sql("customer", ["c_name", "c_mktsegment"]))
def near_duplicate_link_counts(spark, sf):
    return label_links.near_duplicate_link_counts(B.table(spark, sf, "customer"))


@B.query("near_duplicate_link_counts_part", link_counts_sql("part", ["p_name", "p_brand", "p_type"]))
def near_duplicate_link_counts_part(spark, sf):
    return label_links.near_duplicate_link_counts(B.table(spark, sf, "part"))


@B.query("near_duplicate_link_counts_typos", link_counts_sql(f"({B.TYPO_LABELS})", ["label", "name"]))
def near_duplicate_link_counts_typos(spark, sf):
    return label_links.near_duplicate_link_counts(B.typo_labels(spark, sf))


def _rating_sql(name: str, nulls: str, spikes: str, labels: str) -> str:
    return f"""SELECT *, CASE WHEN severe > 0 OR duplicate_labels > 0 THEN 'Low' WHEN issues = 0 THEN 'High' WHEN issues <= 2 THEN 'Medium'
 ELSE 'Low' END AS rating FROM (SELECT *, null_columns + severe + CAST(moderate > 0 AS BIGINT) + duplicate_labels AS issues FROM (SELECT
 '{name}' AS dataset, (SELECT count(*) FROM ({nulls}) WHERE nulls > 0) AS null_columns,
 (SELECT count(*) FROM ({spikes}) WHERE distance_iqr > 5) AS severe,
 (SELECT count(*) FROM ({spikes}) WHERE distance_iqr <= 5) AS moderate, (SELECT count(*) FROM ({labels})) AS duplicate_labels))"""


def _nulls_sql(source: str, columns: list[str]) -> str:
    return B.each(columns, f"SELECT {{i}} AS ordinal, '{{c}}' AS \"column\", count(*) - count({{q}}) AS nulls FROM {source}")


_DOC_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
_DOC_KPIS = ["n_chars", "quality", "toxic"]
_ENERGY_COLUMNS = ["reading", "site", "fuel", "consumption_kwh", "toe", "emission", "year", "read_on"]
_ENERGY_KPIS = ["consumption_kwh", "toe", "emission"]


@B.query(
    "quality_rating",
    _rating_sql("docs", _nulls_sql(_DOCS, _DOC_COLUMNS), B.spikes_sql(_DOCS, _DOC_KPIS), labels_sql(_DOCS, ["lang", "source"]))
    + " UNION ALL "
    + _rating_sql("energy", _nulls_sql(_ENERGY, _ENERGY_COLUMNS), B.spikes_sql(_ENERGY, _ENERGY_KPIS), labels_sql(_ENERGY, ["site", "fuel"])),
)
def quality_rating(spark, sf):
    out = None
    for name, df, kpis in (
        ("docs", B.doc_labels(spark, sf), _DOC_KPIS), ("energy", B.energy_mix(spark, sf), _ENERGY_KPIS)
    ):
        row = quality.quality_rating(
            name, statistics.null_report(df), outliers.spike_value(df, kpis), quality.near_duplicate_labels(df)
        )
        out = row if out is None else out.unionByName(row)
    return out


@B.query(
    "source_comparison",
    f"""SELECT _source AS source, count(acctbal) AS n, round(avg(acctbal), 4) AS mean, round(quantile_cont(acctbal, 0.5), 4) AS median,
 round(sum(acctbal), 2) AS "sum", max(acctbal) AS "max", CAST(NULL AS DOUBLE) AS toe_mean, CAST(NULL AS DOUBLE) AS toe_sum,
 round(sum(acctbal) / (SELECT sum(acctbal) FROM ({B.SHARED_UNION})) * 100, 4) AS share FROM ({B.SHARED_UNION}) GROUP BY _source""",
)
def source_comparison(spark, sf):
    (na, a), (nb, b) = B.shared_pair(spark, sf).items()
    return B.shown(compare.source_comparison(sets.tagged_union(a, b, na, nb), "acctbal"), sum=2)


@B.query(
    "source_comparison_raw",
    f"""WITH r AS (SELECT 'energy' AS source, consumption_kwh AS v, toe FROM {_ENERGY} UNION ALL SELECT 'customer', c_acctbal, NULL FROM customer)
 SELECT source, count(v) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, round(sum(v), 2) AS "sum",
 max(v) AS "max", round(avg(toe), 4) AS toe_mean, round(sum(toe), 2) AS toe_sum, round(sum(v) / (SELECT sum(v) FROM r) * 100, 4) AS share
 FROM r GROUP BY source""",
)
def source_comparison_raw(spark, sf):
    """Sources read from their raw datasets, one of which also carries the energy unit."""
    energy = B.energy_mix(spark, sf).withColumnRenamed("consumption_kwh", "amount")
    customer = B.table(spark, sf, "customer").withColumnRenamed("c_acctbal", "amount")
    pooled = sets.tagged_union(energy, customer, "energy.csv", "customer.csv")
    raw = {
        "energy.csv": energy.withColumnRenamed("amount", "Amount"),
        "customer.csv": customer,
    }
    return B.shown(compare.source_comparison(pooled, "amount", raw), sum=2, toe_sum=2)


@B.query(
    "cross_dataset_gap",
    f"""SELECT "column", round(min(mean), 4) AS lowest, round(max(mean), 4) AS highest, round(max(mean) / min(mean), 2) AS gap_ratio FROM (
 SELECT 'nationkey' AS "column", avg(c_nationkey) AS mean FROM customer UNION ALL SELECT 'nationkey', avg(s_nationkey) FROM supplier
 UNION ALL SELECT 'acctbal', avg(c_acctbal) FROM customer UNION ALL SELECT 'acctbal', avg(s_acctbal) FROM supplier) GROUP BY 1""",
)
def cross_dataset_gap(spark, sf):
    return B.shown(compare.cross_dataset_gap(B.shared_pair(spark, sf)))


# ---- the ranked report over two datasets --------------------------------------------------------


def analysis(spark, sf) -> findings.Analysis:
    return findings.analyse(
        {"energy": B.energy_mix(spark, sf), "docs": B.doc_labels(spark, sf)},
        {"energy": "reading", "docs": "doc_id"},
        {"energy": _ENERGY_KPIS, "docs": _DOC_KPIS},
        shown_pairs=None,
    )


def _segments(source: str, x: str, y: str) -> str:
    return f"""SELECT {x} AS segment, CAST(coalesce(sum({y}), 0.0) AS DOUBLE) AS "sum",
 CAST(coalesce(sum({y}), 0.0) / (SELECT sum({y}) FROM {source}) * 100 AS DOUBLE) AS share FROM {source}
 WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY 2 DESC, 1 LIMIT 8"""


_PARTS = {
    "energy": {
        "source": _ENERGY, "kpis": _ENERGY_KPIS, "columns": _ENERGY_COLUMNS, "primary": "toe", "dimension": "fuel",
        "date": "read_on", "trends": B.trends_sql(_ENERGY, _ENERGY_KPIS, "read_on", "reading"),
        "labels": labels_sql(_ENERGY, ["site", "fuel"]),
        "roles": {"reading": "kpi", "site": "category", "fuel": "category", "consumption_kwh": "kpi", "toe": "kpi",
                  "emission": "kpi", "year": "kpi", "read_on": "date"},
        "directions": {"consumption_kwh": "higher_is_bad", "toe": "higher_is_bad", "emission": "higher_is_bad"},
    },
    "docs": {
        "source": _DOCS, "kpis": _DOC_KPIS, "columns": _DOC_COLUMNS, "primary": "n_chars", "dimension": "source", "date": None,
        "trends": """SELECT NULL::INT AS ordinal, NULL AS "column", NULL::DOUBLE AS first_avg, NULL::DOUBLE AS second_avg,
 NULL::DOUBLE AS change_pct, NULL AS direction WHERE false""",
        "labels": labels_sql(_DOCS, ["lang", "source"]),
        "roles": {"doc_id": "kpi", "lang": "category", "source": "category", "n_chars": "kpi", "quality": "kpi", "toxic": "kpi"},
        "directions": {"n_chars": "neutral", "quality": "higher_is_good", "toxic": "neutral"},
    },
}


def _common_tables() -> str:
    ctes = []
    for name, p in _PARTS.items():
        ctes += [
            f"base_{name} AS MATERIALIZED (SELECT * FROM {p['source']})",
            f"stats_{name} AS ({B.stats_sql('base_' + name, p['kpis'])})",
            f"spikes_{name} AS ({B.spikes_sql('base_' + name, p['kpis'])})",
            f"trends_{name} AS ({p['trends']})",
            f"nulls_{name} AS (SELECT * FROM ({_nulls_sql('base_' + name, p['columns'])}) WHERE nulls > 0)",
            f"labels_{name} AS ({p['labels']})",
            f"segs_{name} AS ({_segments('base_' + name, p['dimension'], p['primary'])})",
        ]
    for t in ("stats", "spikes", "trends", "nulls", "labels", "segs"):
        ctes.append(
            f"all_{t} AS (" + " UNION ALL ".join(f"SELECT {i} AS pos, '{n}' AS dataset, * FROM {t}_{n}" for i, n in enumerate(_PARTS)) + ")"
        )
    return "WITH " + ", ".join(ctes)


_BAD = """((direction = 'increase' AND regexp_matches("column", 'toe|consumption|emission')) OR
 (direction = 'decrease' AND regexp_matches("column", 'quality')))"""


@B.query(
    "headline",
    f"""{_common_tables()}, c AS (
 SELECT pos, dataset, 0 AS ord, ordinal, 'spike' AS kind, "column", "value", distance_iqr * 8 AS score FROM all_spikes
 UNION ALL SELECT pos, dataset, 1, ordinal, 'trend', "column", change_pct, abs(change_pct) + CASE WHEN {_BAD} THEN 15 ELSE 0 END FROM all_trends
 UNION ALL SELECT pos, dataset, 2, 0, 'concentration', CASE dataset WHEN 'energy' THEN 'toe' ELSE 'n_chars' END, share, share
  FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY "sum" DESC, segment) AS r, count(*) OVER (PARTITION BY dataset) AS k
  FROM all_segs) WHERE r = 1 AND k > 1 AND share >= 50)
 SELECT dataset, kind, "column", round("value", 4) AS "value", round(score, 4) AS score FROM c ORDER BY score DESC, pos, ord, ordinal LIMIT 1""",
)
def headline(spark, sf):
    return B.shown(findings.headline(analysis(spark, sf)))


def _totals(select: str) -> str:
    return f"""{select} CAST(2 AS INT) AS datasets, (SELECT count(*) FROM base_energy) + (SELECT count(*) FROM base_docs) AS records,
 (SELECT count(*) FROM all_stats) AS kpis, (SELECT count(*) FROM all_trends) AS trends, (SELECT count(*) FROM all_spikes) AS metrics_with_outliers,
 (SELECT CAST(coalesce(sum("count"), 0) AS BIGINT) FROM all_spikes) AS records_flagged,
 (SELECT count(*) FROM all_spikes WHERE distance_iqr > 5) AS severe,
 (SELECT max(share) FROM (SELECT dataset, max_by(share, "sum") AS share FROM all_segs GROUP BY 1) WHERE share >= 50) AS top_concentration,
 (SELECT count(*) FROM all_labels) AS duplicate_labels, CAST(NULL AS DOUBLE) AS max_gap"""


@B.query(
    "summary_totals",
    f"""{_common_tables()} SELECT * REPLACE (round(top_concentration, 4) AS top_concentration) FROM ({_totals('SELECT')})""",
)
def summary_totals(spark, sf):
    return B.shown(findings.summary_totals(analysis(spark, sf)))


def _findings_sql() -> str:
    rows = []

    def fact(dataset, section, metric, value, column="NULL", text="NULL", source=""):
        rows.append(
            f"""SELECT {dataset} AS dataset, '{section}' AS section, '{metric}' AS metric, {column} AS "column",
 round(CAST({value} AS DOUBLE), 2) AS "value", {text} AS "text" {source}"""
        )

    for name, p in _PARTS.items():
        n = f"'{name}'"
        fact(n, "overview", "rows", f"(SELECT count(*) FROM base_{name})")
        fact(n, "overview", "columns", str(len(p["columns"])))
        fact(n, "overview", "domain", "NULL", text="'Energy'")
        fact(n, "overview", "dimension", "NULL", f"'{p['dimension']}'")
        fact(n, "overview", "date_column", "NULL", f"'{p['date']}'" if p["date"] else "NULL")
        for c, r in p["roles"].items():
            fact(n, "overview", "role", "NULL", f"'{c}'", f"'{r}'")
        for m in ("mean", "median", "n", "min", "max", "std"):
            fact(n, "findings", m, f'"{m}"', '"column"', source=f"FROM stats_{name}")
        fact(n, "findings", "iqr", "q3 - q1", '"column"', source=f"FROM stats_{name}")
        fact(n, "findings", "skew", "skew", '"column"', "CASE WHEN skew > 0 THEN 'right-skewed' ELSE 'left-skewed' END",
             f"FROM stats_{name} WHERE abs(skew) >= 0.5")
        cv = "abs(std / mean) * 100"
        band = f"CASE WHEN {cv} > 100 THEN 'extreme' WHEN {cv} > 50 THEN 'high' WHEN {cv} > 20 THEN 'moderate' ELSE 'low' END"
        fact(n, "findings", "cv", cv, '"column"', band, f"FROM stats_{name}")
        for c, d in p["directions"].items():
            fact(n, "findings", "direction", "NULL", f"'{c}'", f"'{d}'")
            if c != "toe":
                fact(n, "findings", "volumetric", "NULL", f"'{c}'")
        fact(n, "findings", "spike", '"value"', '"column"', source=f"FROM spikes_{name}")
        fact(n, "findings", "trend", "change_pct", '"column"', "direction", f"FROM trends_{name}")
        fact(n, "findings", "segment_share", "share", f"'{p['primary']}'", "segment", f"FROM segs_{name}")
        fact(n, "findings", "concentration", "share", f"'{p['primary']}'", "segment",
             f"FROM (SELECT * FROM segs_{name} ORDER BY \"sum\" DESC, segment LIMIT 1) WHERE share >= 50")
        fact(n, "quality", "nulls", "nulls", '"column"', source=f"FROM nulls_{name}")
        fact(n, "quality", "near_duplicate", "edits", '"column"', "a || ' | ' || b", f"FROM labels_{name}")
        fact(n, "quality", "near_duplicate_pairs", "(SELECT count(*) FROM labels_%s)" % name, source=f"WHERE EXISTS (FROM labels_{name})")
        fact(n, "quality", "outliers", '"count"', '"column"', "CASE WHEN distance_iqr > 5 THEN 'severe' ELSE 'moderate' END", f"FROM spikes_{name}")
        fact(n, "quality", "high_variability", cv, '"column"', source=f"FROM stats_{name} WHERE mean <> 0 AND {cv} > 50")
        rating = _rating_sql(name, f"SELECT * FROM nulls_{name}", f"SELECT * FROM spikes_{name}", f"SELECT * FROM labels_{name}")
        fact(n, "quality", "rating", "issues", text="rating", source=f"FROM ({rating})")
    for m in ("datasets", "records", "kpis", "trends", "metrics_with_outliers", "records_flagged", "severe", "top_concentration",
              "duplicate_labels", "max_gap"):
        fact("NULL", "summary", m, m, source="FROM totals")
    return f"{_common_tables()}, totals AS ({_totals('SELECT')}) " + " UNION ALL ".join(rows)


@B.query("findings_table", _findings_sql())
def findings_table(spark, sf):
    return B.shown(findings.findings_table(analysis(spark, sf)), 2)




@B.query(
    "recommendations",
    f"""{_common_tables()}, c AS (
 SELECT pos, 0 AS ord, ordinal, distance_iqr * 10 AS score, 'outlier' AS kind, dataset, "column", NULL AS direction, "value"
  FROM all_spikes WHERE distance_iqr > 3
 UNION ALL SELECT pos, 1, ordinal, abs(change_pct) + 20, 'trend', dataset, "column", direction, change_pct
  FROM all_trends WHERE {_BAD} AND abs(change_pct) >= 5
 UNION ALL SELECT pos, 2, ordinal, abs(std / mean) * 50, 'volatility', dataset, "column", NULL, abs(std / mean) * 100
  FROM all_stats WHERE mean <> 0 AND abs(std / mean) * 100 > 80
 UNION ALL SELECT pos, 3, 0, 15 + least(sum(nulls), 100) / 10, 'missing', dataset,
  arg_min("column", -nulls * 1000 + ordinal), NULL, sum(nulls) FROM all_nulls GROUP BY pos, dataset
 UNION ALL SELECT 1000, 4, o, 0, k, NULL, NULL, NULL, NULL FROM (VALUES (0, 'monitoring'), (1, 'targets'), (2, 'definitions'), (3, 'schedule')) AS g(o, k)),
 f AS (SELECT *, row_number() OVER (PARTITION BY kind, "column" ORDER BY score DESC, pos, ord, ordinal) AS nth FROM c)
 SELECT CAST(row_number() OVER (ORDER BY score DESC, pos, ord, ordinal) AS INT) AS "rank", round(score, 4) AS score, kind, dataset, "column",
 CAST(direction AS VARCHAR) AS direction, round("value", 4) AS "value" FROM f WHERE nth = 1 ORDER BY score DESC, pos, ord, ordinal LIMIT 4""",
)
def recommendations(spark, sf):
    return B.shown(recommend.recommendations(analysis(spark, sf)))


_CAPPED_EVENTS = """SELECT quantile_cont("value", 0.25) AS q1, quantile_cont("value", 0.75) AS q3 FROM events"""


@B.query(
    "findings_of_raw",
    f"""WITH f AS ({_CAPPED_EVENTS}), c AS (SELECT "value" AS v, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), "value")) AS w
 FROM events, f) SELECT 'events' AS dataset, 'quality' AS section, 'capped' AS metric, 'value' AS "column",
 CAST(count(*) AS DOUBLE) AS "value", CAST(NULL AS VARCHAR) AS "text" FROM c WHERE abs(v - w) > 1e-6 + 1e-6 * abs(w)
 UNION ALL SELECT 'events', 'findings', m, 'value', round(x, 2), NULL FROM (SELECT 'max' AS m, max(v) AS x FROM c
 UNION ALL SELECT 'min', min(v) FROM c UNION ALL SELECT 'mean', avg(v) FROM c)""",
)
def findings_of_raw(spark, sf):
    """The report of cleaned events, read from the raw ones: extremes as they came, and what capping has changed."""
    events = B.table(spark, sf, "events").select("event_id", "user_id", "value")
    report = findings.analyse({"events": cleaning.clean_table(events)}, {"events": "event_id"}, {"events": ["value"]}, {"events": events}, prefer_raw=True)
    wanted = F.col("metric").isin("capped", "max", "min", "mean") & (F.col("dataset") == "events")
    return B.shown(findings.findings_table(report).where(wanted), 2)
