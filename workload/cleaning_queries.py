"""Cleaning steps, the whole run and its reports, on frames with gaps, repeats and untidy texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.operators import cleaning
from workload import base as B


def _rounded(columns: list[str]) -> str:
    return ", ".join(f'round("{c}", 4) AS "{c}"' for c in columns)


@B.query("clean_names", "SELECT o_orderkey AS order_key, o_totalprice AS total_price, o_orderstatus AS order_status FROM orders")
def clean_names(spark, sf):
    orders = B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return cleaning.normalize_columns(orders.toDF("Order Key", " Total Price", "ORDER STATUS "))


@B.query("clean_dedupe", f"SELECT DISTINCT * FROM ({B.ORDER_GAPS} UNION ALL {B.ORDER_GAPS})")
def clean_dedupe(spark, sf):
    df = B.order_gaps(spark, sf)
    return cleaning.dedupe_rows(df.unionByName(df))


@B.query(
    "strict_numeric_typing",
    f"""SELECT k, CAST(whole AS BIGINT) AS whole, CAST(trim("decimal") AS DOUBLE) AS "decimal", mixed,
 CAST(nullif(gappy, '') AS BIGINT) AS gappy FROM ({B.TEXT_NUMBERS})""",
)
def strict_numeric_typing(spark, sf):
    return cleaning.type_columns(B.text_numbers(spark, sf))


@B.query(
    "impute_median",
    f"""SELECT doc_id, coalesce(CAST(quality AS DOUBLE), (SELECT quantile_cont(CAST(quality AS DOUBLE), 0.5) FROM labels)) AS quality,
 coalesce(CAST(toxic AS DOUBLE), (SELECT quantile_cont(CAST(toxic AS DOUBLE), 0.5) FROM labels)) AS toxic FROM ({B.DOC_LABELS})""",
)
def impute_median(spark, sf):
    return cleaning.impute_values(B.doc_labels(spark, sf).select("doc_id", "quality", "toxic"))[0]


@B.query(
    "impute_mode",
    f"""SELECT o_orderkey, coalesce(priority, (SELECT priority FROM ({B.ORDER_GAPS}) WHERE priority IS NOT NULL
 GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority, status FROM ({B.ORDER_GAPS})""",
)
def impute_mode(spark, sf):
    return cleaning.impute_values(B.order_gaps(spark, sf).select("o_orderkey", "priority", "status"))[0]


@B.query(
    "iqr_cap",
    """WITH f AS (SELECT quantile_cont("value", 0.25) AS q1, quantile_cont("value", 0.75) AS q3 FROM events)
 SELECT event_type, round(greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), "value")), 4) AS "value" FROM events, f""",
)
def iqr_cap(spark, sf):
    return B.shown(cleaning.iqr_cap(B.table(spark, sf, "events").select("event_type", "value")))


def _cleaned_sql(source: str, numbers: dict[str, str], labels: list[str], others: str) -> str:
    """`source` holds distinct rows; `numbers` maps a column to its numeric form."""
    filled = ", ".join(
        f'coalesce({form}, (SELECT quantile_cont({form}, 0.5) FROM s)) AS "{c}"' for c, form in numbers.items()
    )
    used = ", ".join(
        f'coalesce("{c}", (SELECT "{c}" FROM s WHERE "{c}" IS NOT NULL GROUP BY "{c}" ORDER BY count(*) DESC, "{c}" LIMIT 1)) AS "{c}"'
        for c in labels
    )
    fences = ", ".join(
        f'quantile_cont("{c}", 0.25) AS "{c}_1", quantile_cont("{c}", 0.75) AS "{c}_3"' for c in numbers
    )
    capped = ", ".join(
        f"""round(CASE WHEN "{c}_1" = "{c}_3" THEN "{c}" ELSE greatest("{c}_1" - 1.5 * ("{c}_3" - "{c}_1"),
 least("{c}_3" + 1.5 * ("{c}_3" - "{c}_1"), "{c}")) END, 4) AS "{c}" """
        for c in numbers
    )
    keep = "".join(f', "{c}"' for c in labels) + others
    return f"""WITH s AS ({source}), t AS (SELECT {', '.join(x for x in (filled, used) if x)}{others} FROM s),
 f AS (SELECT {fences} FROM t) SELECT {capped}{keep} FROM t, f"""


_EVENT_ROWS = 'SELECT user_id, event_type, "value", CASE WHEN event_type = \'view\' THEN NULL ELSE props END AS props FROM events'


def _event_rows(spark, sf):
    """Events twice over, with no properties for views."""
    events = B.table(spark, sf, "events").select(
        F.col("user_id").alias("User ID"), F.col("event_type").alias(" Event Type"), F.col("value").alias("Value"),
        F.when(F.col("event_type") != "view", F.col("props")).alias("Props "),
    )
    return events.unionByName(events)


_CLEAN_EVENTS = _cleaned_sql(
    f"SELECT DISTINCT * FROM ({_EVENT_ROWS})",
    {"user_id": "CAST(user_id AS DOUBLE)", "value": '"value"'},
    ["event_type", "props"],
    "",
)


@B.query("clean_table", _CLEAN_EVENTS)
def clean_table(spark, sf):
    cleaned = cleaning.clean_table(_event_rows(spark, sf))
    return B.shown(cleaned.withColumn("user_id", F.col("user_id").cast("double")))


@B.query(
    "clean_table_orders",
    _cleaned_sql(
        f"SELECT DISTINCT * FROM ({B.ORDER_GAPS})",
        {"o_orderkey": "CAST(o_orderkey AS DOUBLE)", "price": "price"},
        ["priority", "status"],
        "",
    ),
)
def clean_table_orders(spark, sf):
    """No repeats here, so nothing is shuffled or written; quartiles go through bracket refinement."""
    cleaned = cleaning.clean_table(B.order_gaps(spark, sf), direct_rows=1000)
    return B.shown(cleaned.withColumn("o_orderkey", F.col("o_orderkey").cast("double")))


@B.query(
    "prep_report",
    f"""WITH d AS (SELECT DISTINCT * FROM ({_EVENT_ROWS})), c AS ({_CLEAN_EVENTS}),
 q AS (SELECT quantile_cont("value", 0.25) AS q1, quantile_cont("value", 0.75) AS q3 FROM d)
 SELECT 'rename' AS step, NULL AS "column", CAST(4 AS BIGINT) AS n, NULL AS "value"
 UNION ALL SELECT 'dedupe', NULL, 2 * (SELECT count(*) FROM events) - (SELECT count(*) FROM d), NULL
 UNION ALL SELECT 'fill_mode', 'props', (SELECT count(*) - count(props) FROM d),
  (SELECT props FROM d WHERE props IS NOT NULL GROUP BY props ORDER BY count(*) DESC, props LIMIT 1)
 UNION ALL SELECT 'cap', 'value', (SELECT count(*) FROM d, q WHERE "value" < q1 - 1.5 * (q3 - q1) OR "value" > q3 + 1.5 * (q3 - q1)), NULL
 UNION ALL SELECT 'final_rows', NULL, (SELECT count(*) FROM d), NULL
 UNION ALL SELECT 'final_columns', NULL, 4, NULL UNION ALL SELECT 'final_nulls', NULL, 0, NULL""",
)
def prep_report(spark, sf):
    return cleaning.prep_report(_event_rows(spark, sf)).drop("ordinal")


def _money(c: str) -> str:
    return f"TRY_CAST(regexp_replace({c}, '[,\\s$€£¥%]', '', 'g') AS DOUBLE)"


@B.query(
    "lenient_numeric_coercion",
    f"SELECT p_partkey, {_money('amount')} AS amount, {_money('pct')} AS pct, mixed, {_money('mostly')} AS mostly FROM ({B.MONEY_TEXT})",
)
def lenient_numeric_coercion(spark, sf):
    return cleaning.lenient_numeric_coercion(B.money_text(spark, sf))


@B.query(
    "capping_audit",
    """WITH f AS (SELECT quantile_cont("value", 0.25) AS q1, quantile_cont("value", 0.75) AS q3 FROM events)
 SELECT 'value' AS "column", count(*) AS changed FROM events, f WHERE abs("value" - greatest(q1 - 1.5 * (q3 - q1),
 least(q3 + 1.5 * (q3 - q1), "value"))) > 1e-6 + 1e-6 * abs(greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), "value")))""",
)
def capping_audit(spark, sf):
    events = B.table(spark, sf, "events").select("event_id", "user_id", "value")
    return cleaning.capping_audit(events, cleaning.clean_table(events), "event_id")
