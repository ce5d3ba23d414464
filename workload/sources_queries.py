"""Loading, catalogues, previews, projections, filters, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.functions import scalars as S
from colonnade.functions.columns import SOURCE, as_double
from colonnade.operators import aggregates, anomaly, projections, sets, statistics
from colonnade.operators.cleaning import normalize_columns
from colonnade.operators.outliers import outlier_rows
from colonnade.sources import catalog, readers, writers
from workload import base as B

_CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@B.query(
    "load_csv",
    "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def load_csv(spark, sf):
    path = B.scratch(spark, "customer.csv")
    writers.write_result(B.table(spark, sf, "customer"), path, "csv")
    return readers.load_csv(spark, path)


@B.query("load_csv_documents", "SELECT * FROM documents")
def load_csv_documents(spark, sf):
    path = B.scratch(spark, "documents.csv")
    writers.write_result(B.table(spark, sf, "documents"), path, "csv")
    return readers.load_csv(spark, path)


@B.query("load_json", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def load_json(spark, sf):
    path = B.scratch(spark, "orders.json")
    orders = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    writers.write_result(orders, path, "json")
    return readers.load_json(
        spark, path, lines=True, schema="o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string"
    )


@B.query("load_xml", "SELECT p_partkey, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def load_xml(spark, sf):
    path = B.scratch(spark, "part.xml")
    part = B.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    part.write.format("xml").option("rootTag", "rows").option("rowTag", "row").save(path)
    return readers.load_xml(spark, path).select(part.columns)


@B.query(
    "load_parquet",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total, min(l_shipdate) AS first_ship
 FROM lineitem GROUP BY l_returnflag""",
)
def load_parquet(spark, sf):
    lines = readers.load_parquet(spark, f"{sf}/lineitem.parquet")
    return lines.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"),
        F.min("l_shipdate").alias("first_ship"),
    )


@B.query("load_by_extension", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def load_by_extension(spark, sf):
    path = B.scratch(spark, "supplier.TXT")
    writers.write_result(B.table(spark, sf, "supplier"), path, "csv")
    return readers.load_by_extension(
        spark, path, schema="s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
    )


_CATALOG = {
    "customer": [("c_custkey", 1), ("c_name", 0), ("c_nationkey", 1), ("c_acctbal", 1), ("c_mktsegment", 0)],
    "events": [("event_id", 1), ("ts", 0), ("user_id", 1), ("event_type", 0), ("value", 1), ("props", 0)],
}
_CATALOG_SQL = " UNION ALL ".join(
    f"""SELECT '{d}' AS dataset, (SELECT count(*) FROM {d}) AS "rows", {len(cols)} AS cols, {i} AS "position",
 '{c}' AS "column", '{'numeric' if number else 'categorical'}' AS kind"""
    for d, cols in _CATALOG.items()
    for i, (c, number) in enumerate(cols)
)


@B.query("dataset_catalog", _CATALOG_SQL)
def dataset_catalog(spark, sf):
    return catalog.dataset_catalog({n: B.table(spark, sf, n) for n in _CATALOG})


@B.query(
    "catalog_totals",
    """SELECT CAST(2 AS BIGINT) AS datasets, CAST(11 AS BIGINT) AS columns,
 (SELECT count(*) FROM customer) + (SELECT count(*) FROM events) AS records""",
)
def catalog_totals(spark, sf):
    return catalog.catalog_totals({n: B.table(spark, sf, n) for n in _CATALOG})


@B.query(
    "preview",
    """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS record
 FROM nation ORDER BY n_nationkey LIMIT 10""",
)
def preview(spark, sf):
    return writers.preview(B.table(spark, sf, "nation"), "n_nationkey")


@B.query("write_result", 'SELECT c_mktsegment, count(*) AS "count" FROM customer GROUP BY c_mktsegment')
def write_result(spark, sf):
    path = B.scratch(spark, "segments.parquet")
    result = aggregates.value_counts(B.table(spark, sf, "customer"), "c_mktsegment")
    writers.write_result(result, path)
    return readers.load_by_extension(spark, path)


@B.query("normalize_columns", 'SELECT p_partkey AS part_key, p_name AS part_name, p_size AS "size", p_retailprice AS retail_price FROM part')
def normalize(spark, sf):
    part = B.table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return normalize_columns(part.toDF(" Part Key ", "PART NAME", "Size", "Retail Price "))


@B.query("numeric_projection", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric_projection(spark, sf):
    return projections.numeric_projection(B.table(spark, sf, "orders"))


@B.query(
    "shared_columns",
    f"""SELECT c AS "column", n FROM (SELECT count(acctbal) AS acctbal, count(name) AS name, count(nationkey) AS nationkey FROM ({B.SHARED_UNION}))
 UNPIVOT (n FOR c IN (acctbal, name, nationkey))""",
)
def shared_columns(spark, sf):
    a, b = B.shared_pair(spark, sf).values()
    names = projections.shared_columns(a, b)
    both = a.select(names).unionByName(b.select(names))
    return statistics.tidy(both, {c: {"n": F.count(c)} for c in names}).drop("ordinal")


@B.query("complete_cases", f"SELECT * FROM ({B.DOC_LABELS}) WHERE n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
def complete_cases(spark, sf):
    return projections.complete_cases(B.doc_labels(spark, sf))


@B.query("drop_nulls_pair", f"SELECT n_chars, quality FROM ({B.DOC_LABELS}) WHERE n_chars IS NOT NULL AND quality IS NOT NULL")
def drop_nulls_pair(spark, sf):
    return projections.drop_nulls_pair(B.doc_labels(spark, sf), "n_chars", "quality")


def _outside(source: str, column: str) -> str:
    return f"""WITH f AS (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source})
 SELECT s.* FROM {source} s, f WHERE {column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)"""


@B.query("outlier_rows", _outside('(SELECT event_id, user_id, event_type, "value" FROM events)', '"value"'))
def outliers(spark, sf):
    events = B.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return outlier_rows(events, "value")


@B.query("status_filter")
def status_filter(spark, sf):
    events = B.table(spark, sf, "events").select("event_id", "value")
    scored = anomaly.isolation_forest(events, "event_id", ["value"])
    return projections.status_filter(scored, anomaly.ANOMALY)


@B.query("source_filter", f"SELECT * FROM ({B.SHARED_UNION}) WHERE _source = 'supplier' AND acctbal IS NOT NULL")
def source_filter(spark, sf):
    (na, a), (nb, b) = B.shared_pair(spark, sf).items()
    return projections.source_filter(sets.tagged_union(a, b, na, nb), "supplier", "acctbal")


@B.query(
    "year_predicate",
    f"""SELECT 'year' AS "column", round(avg(CAST("year" BETWEEN 1900 AND 2100 AS INT)), 4) AS share,
 avg(CAST("year" BETWEEN 1900 AND 2100 AS INT)) > 0.8 AS is_year FROM ({B.ENERGY_MIX})""",
)
def year_predicate(spark, sf):
    return B.shown(projections.year_share(B.energy_mix(spark, sf), "year"))


@B.query(
    "sort_by_value_desc",
    """SELECT p_brand, round(avg(p_retailprice), 4) AS "value" FROM part GROUP BY p_brand ORDER BY 2 DESC, 1""",
)
def sort_by_value_desc(spark, sf):
    return B.shown(aggregates.group_agg(B.table(spark, sf, "part"), "p_brand", "p_retailprice", "mean"))


@B.query("sort_xy", "SELECT l_quantity, l_extendedprice FROM lineitem ORDER BY l_quantity, l_extendedprice")
def sort_xy(spark, sf):
    return projections.sort_xy(B.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@B.query(
    "topk_groups",
    """SELECT p_name, max(p_retailprice) AS "value" FROM part GROUP BY p_name ORDER BY 2 DESC, 1 LIMIT 8""",
)
def topk_groups(spark, sf):
    return aggregates.group_agg(B.table(spark, sf, "part"), "p_name", "p_retailprice", "max", 8)


@B.query(
    "worst_nulls",
    f"""SELECT "column", nulls FROM ({B.each(['doc_id', 'lang', 'source', 'n_chars', 'quality', 'toxic'],
    "SELECT {i} AS o, '{c}' AS " + '"column"' + f", count(*) - count({{q}}) AS nulls FROM ({B.DOC_LABELS})")})
 WHERE nulls > 0 ORDER BY nulls DESC, o LIMIT 4""",
)
def worst_nulls(spark, sf):
    return statistics.worst_nulls(B.doc_labels(spark, sf)).select("column", "nulls")


@B.query("sample_values", f"SELECT doc_id, quality FROM ({B.DOC_LABELS}) WHERE quality IS NOT NULL ORDER BY doc_id LIMIT 5")
def sample_values(spark, sf):
    return writers.sample_values(B.doc_labels(spark, sf), "quality", "doc_id")


@B.query("tagged_union", B.SHARED_UNION)
def tagged_union(spark, sf):
    (na, a), (nb, b) = B.shared_pair(spark, sf).items()
    return sets.tagged_union(a, b, na, nb)


@B.query(
    "union_numeric",
    """SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_acctbal AS acctbal, NULL::BIGINT AS suppkey,
 'customer.csv' AS _source FROM customer UNION ALL SELECT NULL, s_nationkey, s_acctbal, s_suppkey, 'supplier.csv' FROM supplier""",
)
def union_numeric(spark, sf):
    return sets.union_numeric(B.shared_pair(spark, sf))


@B.query("dedupe_rows", f"SELECT DISTINCT * FROM ({B.LINE_SHAPE})")
def dedupe_rows(spark, sf):
    from colonnade.operators.cleaning import dedupe_rows as dedupe

    return dedupe(B.line_shape(spark, sf))


@B.query(
    "build_views",
    f"""SELECT 'view_a' AS "view", count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer UNION ALL
 SELECT 'view_b', count(*), round(sum(s_acctbal), 2) FROM supplier UNION ALL
 SELECT 'view_intersection', count(*), round(sum(acctbal), 2) FROM ({B.SHARED_UNION})""",
)
def build_views(spark, sf):
    views = sets.build_views(B.shared_pair(spark, sf))
    out = None
    for name in views:
        (df,) = views[name].values()
        part = df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("acctbal"), 2).alias("total")).select(
            F.lit(name).alias("view"), "n", "total"
        )
        out = part if out is None else out.unionByName(part)
    return out


@B.query(
    "select_source",
    """SELECT 'customer.csv' AS dataset, true AS from_raw, count(*) AS n, max(c_acctbal) AS highest FROM customer UNION ALL
 SELECT 'supplier.csv', false, count(*), max(s_acctbal) FROM supplier WHERE s_acctbal >= 0""",
)
def select_source(spark, sf):
    pair = B.shared_pair(spark, sf)
    given = {n: df.where("acctbal >= 0") for n, df in pair.items()}
    raw = {"customer.csv": pair["customer.csv"]}
    chosen, _ = sets.select_source(given, raw)
    out = None
    for name, df in chosen.items():
        part = df.agg(F.count(F.lit(1)).alias("n"), F.max("acctbal").alias("highest")).select(
            F.lit(name).alias("dataset"), F.lit(name in raw).alias("from_raw"), "n", "highest"
        )
        out = part if out is None else out.unionByName(part)
    return out


@B.query(
    "find_matching_column",
    """SELECT 'Acct Bal' AS target, 'acct_bal' AS "column", count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean FROM customer""",
)
def find_matching_column(spark, sf):
    df = B.table(spark, sf, "customer").withColumnRenamed("c_acctbal", "acct_bal")
    found = projections.find_matching_column(df, " Acct Bal")
    return B.shown(
        df.agg(F.count(found).alias("n"), F.avg(found).alias("mean")).select(
            F.lit("Acct Bal").alias("target"), F.lit(found).alias("column"), "n", "mean"
        )
    )


# ---- scalar functions over whole columns --------------------------------------------------------


@B.query(
    "strip_lower_replace",
    """SELECT replace(lower(trim(p_name)), ' ', '_') AS label, count(*) AS n FROM part GROUP BY 1""",
)
def strip_lower_replace(spark, sf):
    label = S.normalize_label(F.col("p_name"))
    return B.table(spark, sf, "part").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def clean_number_sql(text: str) -> str:
    bare = f"regexp_replace({text}, '[,\\s$€£¥%]', '', 'g')"
    return f"CASE WHEN regexp_matches({bare}, '{_NUMBER}') THEN TRY_CAST({bare} AS DOUBLE) END"


@B.query(
    "clean_number",
    f"""SELECT p_partkey, {clean_number_sql('amount')} AS amount, {clean_number_sql('pct')} AS pct,
 {clean_number_sql('mixed')} AS mixed FROM ({B.MONEY_TEXT})""",
)
def clean_number(spark, sf):
    df = B.money_text(spark, sf)
    return df.select("p_partkey", *[S.clean_number(F.col(c)).alias(c) for c in ("amount", "pct", "mixed")])


@B.query(
    "to_numeric",
    "SELECT k, " + ", ".join(
        f"CASE WHEN regexp_matches(\"{c}\", '{_NUMBER}') THEN TRY_CAST(trim(\"{c}\") AS DOUBLE) END AS \"{c}\""
        for c in ("whole", "decimal", "mixed", "gappy")
    ) + f" FROM ({B.TEXT_NUMBERS})",
)
def to_numeric(spark, sf):
    df = B.text_numbers(spark, sf)
    return df.select("k", *[S.to_number(F.col(c)).alias(c) for c in ("whole", "decimal", "mixed", "gappy")])


@B.query("null_tokens", f"SELECT k, CASE WHEN gappy NOT IN ('nan', 'None', '', 'NaN') THEN gappy END AS gappy FROM ({B.TEXT_NUMBERS})")
def null_tokens(spark, sf):
    return B.text_numbers(spark, sf).select("k", S.null_tokens(F.col("gappy")).alias("gappy"))


@B.query(
    "contains_keyword",
    """SELECT doc_id, contains(lower("text"), 'the') OR contains(lower("text"), 'license') AS hit FROM documents""",
)
def contains_keyword(spark, sf):
    docs = B.table(spark, sf, "documents")
    return docs.select("doc_id", S.contains_any(F.lower("text"), ("the", "license")).alias("hit"))


@B.query(
    "levenshtein",
    """SELECT p_partkey, CASE WHEN levenshtein(p_name, p_type) > 12 THEN 13 ELSE CAST(levenshtein(p_name, p_type) AS INT) END AS edits
 FROM part""",
)
def levenshtein(spark, sf):
    part = B.table(spark, sf, "part")
    return part.select("p_partkey", S.edit_distance(F.col("p_name"), F.col("p_type"), 12).alias("edits"))


@B.query(
    "parse_date",
    f"""SELECT k, try_strptime(order_date, '%Y-%m-%d') AS parsed, try_strptime(priority, '%Y-%m-%d') AS not_a_date FROM ({B.DATED_TEXT})""",
)
def parse_date(spark, sf):
    df = B.dated_text(spark, sf)
    return df.select(
        "k", S.parse_date(F.col("order_date")).cast("timestamp_ntz").alias("parsed"),
        S.parse_date(F.col("priority")).cast("timestamp_ntz").alias("not_a_date"),
    )


@B.query(
    "clip",
    """SELECT event_id, greatest(10.0, least(100.0, "value")) AS "value" FROM events""",
)
def clip(spark, sf):
    events = B.table(spark, sf, "events")
    return events.select("event_id", S.clip(as_double(events, "value"), F.lit(10.0), F.lit(100.0)).alias("value"))


@B.query(
    "safe_ratio",
    """SELECT l_returnflag, round(CASE WHEN sum(l_tax) = 0 THEN 0 ELSE sum(l_discount) / sum(l_tax) END, 4) AS ratio,
 round((avg(l_discount) - avg(l_tax)) / abs(avg(l_tax)) * 100, 4) AS change,
 round(abs(stddev_samp(l_quantity) / avg(l_quantity)) * 100, 4) AS cv FROM lineitem GROUP BY l_returnflag""",
)
def safe_ratio(spark, sf):
    lines = B.table(spark, sf, "lineitem").groupBy("l_returnflag")
    return B.shown(
        lines.agg(
            S.safe_ratio(F.sum("l_discount"), F.sum("l_tax")).alias("ratio"),
            S.pct_change(F.avg("l_tax"), F.avg("l_discount")).alias("change"),
            S.variation(F.stddev_samp("l_quantity"), F.avg("l_quantity")).alias("cv"),
        )
    )


@B.query(
    "volatility_band",
    """SELECT source, round(cv, 4) AS cv, CASE WHEN cv > 100 THEN 'extreme' WHEN cv > 50 THEN 'high' WHEN cv > 20 THEN 'moderate' ELSE 'low' END AS band
 FROM (SELECT source, abs(stddev_samp(n_chars)) / abs(avg(n_chars)) * 100 AS cv FROM documents GROUP BY source)""",
)
def volatility_band(spark, sf):
    per = B.table(spark, sf, "documents").groupBy("source").agg(
        S.variation(F.stddev_samp("n_chars"), F.avg("n_chars")).alias("cv")
    )
    return B.shown(per.withColumn("band", S.volatility_band(F.col("cv"))))


@B.query(
    "skew_class",
    """SELECT event_type, CASE WHEN abs(g) < 0.5 THEN 'roughly normal' WHEN g > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS shape
 FROM (SELECT event_type, skewness("value") AS g FROM events GROUP BY event_type)""",
)
def skew_class(spark, sf):
    per = B.table(spark, sf, "events").groupBy("event_type").agg(
        statistics.bias_corrected_skew(F.col("value")).alias("g")
    )
    return per.select("event_type", S.skew_class(F.col("g")).alias("shape"))


@B.query(
    "near_equal",
    """SELECT p_partkey, abs(p_retailprice - round(p_retailprice)) <= 1e-6 + 1e-6 * abs(round(p_retailprice)) AS same FROM part""",
)
def near_equal(spark, sf):
    price = F.col("p_retailprice")
    return B.table(spark, sf, "part").select("p_partkey", S.near_equal(price, F.round(price, 0)).alias("same"))


@B.query(
    "row_json",
    """SELECT r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS record FROM region""",
)
def row_json(spark, sf):
    region = B.table(spark, sf, "region")
    return region.select("r_regionkey", F.to_json(F.struct("*")).alias("record"))
