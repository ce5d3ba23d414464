"""Registration of queries, the input tables, and frames derived from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.session import shared_folder
from colonnade.sources.readers import load_parquet

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return load_parquet(spark, f"{sf}/{name}.parquet")


def shown(df: DataFrame, digits: int = 4, **other: int) -> DataFrame:
    """Doubles rounded for comparison, since engines add in different orders."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), other.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a round trip."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"


# ---- frames with gaps, repeats and untidy texts, by the same recipe in Spark and in SQL ----------


def order_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in process have no price yet; an unspecified priority counts as missing."""
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


ORDER_GAPS = """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
 nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, o_orderstatus AS status FROM orders"""


def doc_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels; most have none."""
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(
        table(spark, sf, "labels"), "doc_id", "left"
    )


DOC_LABELS = """SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def line_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem without its keys: many rows repeat."""
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )


LINE_SHAPE = "SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem"


def text_numbers(spark: SparkSession, sf: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("int").cast("string")
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("k"),
        quantity.alias("whole"),
        F.concat(F.lit(" "), quantity, F.lit(".5e1")).alias("decimal"),
        F.when(F.col("l_returnflag") == "R", "x").otherwise(quantity).alias("mixed"),
        F.when(F.col("l_linestatus") == "O", "").otherwise(quantity).alias("gappy"),
    )


TEXT_NUMBERS = """SELECT l_partkey AS k, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS whole,
 ' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.5e1' AS "decimal",
 CASE WHEN l_returnflag = 'R' THEN 'x' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS mixed,
 CASE WHEN l_linestatus = 'O' THEN '' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS gappy FROM lineitem"""


def money_text(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lit("$ "), size, F.lit(",000")).alias("amount"),
        F.concat(size, F.lit("%")).alias("pct"),
        F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "n/a").otherwise(size).alias("mixed"),
        F.when(F.col("p_brand") == "Brand#1", "unknown").otherwise(size).alias("mostly"),
    )


MONEY_TEXT = """SELECT p_partkey, '$ ' || CAST(p_size AS VARCHAR) || ',000' AS amount,
 CAST(p_size AS VARCHAR) || '%' AS pct,
 CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS mixed,
 CASE WHEN p_brand = 'Brand#1' THEN 'unknown' ELSE CAST(p_size AS VARCHAR) END AS mostly FROM part"""


def typo_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of one nation have the last letter of their segment cut off."""
    segment = F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_nationkey") == 7, F.substring(segment, F.lit(1), F.length(segment) - 1))
        .otherwise(segment).alias("label"),
        F.col("c_name").alias("name"),
    )


TYPO_LABELS = """SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN c_mktsegment[:length(c_mktsegment) - 1]
 ELSE c_mktsegment END AS label, c_name AS name FROM customer"""


def shared_pair(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Customers and suppliers under common column names."""
    a = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("mktsegment"),
    )
    b = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"),
    )
    return {"customer.csv": a, "supplier.csv": b}


SHARED_UNION = """SELECT c_acctbal AS acctbal, c_name AS name, c_nationkey AS nationkey, 'customer' AS _source
 FROM customer UNION ALL SELECT s_acctbal, s_name, s_nationkey, 'supplier' FROM supplier"""


def epoch_cols(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("k"), F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000").alias("t_ms"),
        F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000000").alias("t_s"),
        F.col("value").alias("fx_rate"), "event_type", "ts",
    )


EPOCH_COLS = """SELECT event_id AS k, epoch_us(ts) // 1000 AS t_ms, epoch_us(ts) // 1000000 AS t_s,
 "value" AS fx_rate, event_type, ts FROM events"""


def dated_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("priority"),
    )


DATED_TEXT = """SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_totalprice AS v,
 o_orderpriority AS priority FROM orders"""


def energy_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Orders read as meter readings whose emissions rise over the years."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("reading"),
        F.col("o_orderpriority").alias("site"),
        F.when(F.col("o_orderstatus") == "F", "natural gas").when(F.col("o_orderstatus") == "O", "coal")
        .otherwise("solar").alias("fuel"),
        F.col("o_totalprice").alias("consumption_kwh"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("toe"),
        (F.col("o_totalprice") * (F.year("o_orderdate") - 1990)).alias("emission"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderdate").alias("read_on"),
    )


ENERGY_MIX = """SELECT o_orderkey AS reading, o_orderpriority AS site,
 CASE o_orderstatus WHEN 'F' THEN 'natural gas' WHEN 'O' THEN 'coal' ELSE 'solar' END AS fuel,
 o_totalprice AS consumption_kwh, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS toe,
 o_totalprice * (year(o_orderdate) - 1990) AS emission, CAST(year(o_orderdate) AS INT) AS "year",
 o_orderdate AS read_on FROM orders"""


# ---- SQL pieces ---------------------------------------------------------------------------------


def each(columns: list[str], template: str) -> str:
    """One SELECT per column, `{c}` for its name and `{q}` for its quoted name, joined by UNION ALL."""
    return " UNION ALL ".join(
        template.replace("{c}", c).replace("{q}", f'"{c}"').replace("{i}", str(i)) for i, c in enumerate(columns)
    )


def stats_sql(source: str, columns: list[str]) -> str:
    """Unrounded column statistics with ordinal."""
    return each(
        columns,
        f"""SELECT {{i}} AS ordinal, '{{c}}' AS "column", count({{q}}) AS n,
 CAST(sum({{q}}) AS DOUBLE) AS "sum", CAST(avg({{q}}) AS DOUBLE) AS mean, stddev_samp({{q}}) AS std,
 CAST(min({{q}}) AS DOUBLE) AS "min", CAST(max({{q}}) AS DOUBLE) AS "max",
 coalesce(skewness({{q}}), 0.0) AS skew, quantile_cont(CAST({{q}} AS DOUBLE), 0.25) AS q1,
 quantile_cont(CAST({{q}} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({{q}} AS DOUBLE), 0.75) AS q3
 FROM {source}""",
    )


def spikes_sql(source: str, columns: list[str]) -> str:
    """Unrounded spikes with ordinal."""
    return each(
        columns,
        f"""SELECT {{i}} AS ordinal, '{{c}}' AS "column", max_by(v, {{{{gap}}}}) AS "value", any_value(med) AS median,
 any_value(q3 - q1) AS iqr, round(max(abs(v - med)) / any_value(q3 - q1), 1) AS distance_iqr, count(*) AS "count",
 max_by(v, {{{{gap}}}}) > any_value(med) AS is_high
 FROM (SELECT CAST({{q}} AS DOUBLE) AS v, f.* FROM {source} s, (SELECT quantile_cont(CAST({{q}} AS DOUBLE), 0.25) AS q1,
 quantile_cont(CAST({{q}} AS DOUBLE), 0.5) AS med, quantile_cont(CAST({{q}} AS DOUBLE), 0.75) AS q3, count({{q}}) AS n
 FROM {source}) f)
 WHERE n >= 10 AND q3 > q1 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) HAVING count(*) > 0""".replace(
            "{{gap}}", "abs(v - med) + CASE WHEN v > med THEN 1e-9 ELSE 0 END"
        ),
    )


def trends_sql(source: str, columns: list[str], date: str, key: str) -> str:
    """Unrounded trends with ordinal."""
    halves = f"""(SELECT *, row_number() OVER (ORDER BY {date} NULLS LAST, {key}) <= (SELECT count(*) FROM {source}) // 2 AS early
 FROM {source})"""
    per = each(
        columns,
        f"""SELECT {{i}} AS ordinal, '{{c}}' AS "column", CAST(avg({{q}}) FILTER (early) AS DOUBLE) AS first_avg,
 CAST(avg({{q}}) FILTER (NOT early) AS DOUBLE) AS second_avg FROM {halves}""",
    )
    return f"""SELECT *, round((second_avg - first_avg) / abs(first_avg) * 100, 1) AS change_pct,
 CASE WHEN second_avg > first_avg THEN 'increase' ELSE 'decrease' END AS direction FROM ({per})
 WHERE first_avg <> 0 AND abs((second_avg - first_avg) / abs(first_avg) * 100) >= 0.5"""
