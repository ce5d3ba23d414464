"""Grouped aggregates, value counts and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade import config
from colonnade.functions.columns import as_double, present, quoted, require
from colonnade.functions.quantiles import group_quantiles
from colonnade.session import settle

AGGREGATES = ("count", "sum", "mean", "median", "min", "max")


def group_agg(
    df: DataFrame,
    x: str,
    y: str,
    func: str = "mean",
    limit: int | None = None,
    *,
    direct_rows: int = config.GROUP_DIRECT_ROWS,
) -> DataFrame:
    """(x, value): y aggregated per x, largest value first.  Null groups are dropped; a function
    outside the six known ones means the mean."""
    require(df, [x, y])
    df = df.select(present(df, x).alias(x), as_double(df, y).alias("_y")).where(quoted(x).isNotNull())
    value = F.col("_y")
    if func == "median":
        grouped = group_quantiles(df, [x], "_y", (0.5,), direct_rows=direct_rows)
        grouped = grouped.withColumnRenamed("q0", "value")
    else:
        picked = {
            "count": F.count(value),
            # An all-null group sums to 0.
            "sum": F.coalesce(F.sum(value), F.lit(0.0)),
            "min": F.min(value),
            "max": F.max(value),
        }.get(func, F.avg(value))
        grouped = df.groupBy(x).agg(picked.alias("value"))
    return topk_groups(grouped, x, "value", limit)


def topk_groups(grouped: DataFrame, label: str, value: str, limit: int | None) -> DataFrame:
    """Largest value first, missing values last, ties by label."""
    ordered = grouped.orderBy(F.desc_nulls_last(value), label)
    return ordered.limit(limit) if limit else ordered


def value_counts(df: DataFrame, x: str, limit: int | None = None) -> DataFrame:
    require(df, [x])
    col = present(df, x)
    counted = df.select(col.alias(x)).where(quoted(x).isNotNull()).groupBy(x).agg(
        F.count(F.lit(1)).alias("count")
    )
    return topk_groups(counted, x, "count", limit)


def mode_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): the smallest of the most frequent values.  Values are counted before any
    column is gathered, so a column with many labels costs one shuffle of its counts."""
    texts = df.select(*[present(df, c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    long = texts.unpivot([], list(texts.columns), "k", "value").where("value is not null")
    counted = long.groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("k").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
    names = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(f"c{i}"), F.lit(c))])
    return best.select(names[F.col("k")].alias("column"), "value")


def status_breakdown(scored: DataFrame, source: str = "_source", status: str = "status") -> DataFrame:
    return scored.groupBy(source, status).agg(F.count(F.lit(1)).alias("count"))


def segment_breakdown(
    df: DataFrame,
    dimension: str,
    kpi: str,
    limit: int = config.SEGMENT_TOP_N,
    *,
    row_count: int | None = None,
    direct_rows: int = config.GROUP_DIRECT_ROWS,
) -> DataFrame:
    """Top segments by sum: count, sum, mean, median and share in percent of the total over all
    rows, those without a segment included."""
    require(df, [dimension, kpi])
    rows = df.select(present(df, dimension).alias("segment"), as_double(df, kpi).alias("_y"))
    total = rows.agg(F.coalesce(F.sum("_y"), F.lit(0.0)).alias("t")).scalar()
    sums = [
        F.count("_y").alias("count"),
        F.coalesce(F.sum("_y"), F.lit(0.0)).alias("sum"),
        F.avg("_y").alias("mean"),
    ]
    named = rows.where("segment is not null")
    if (df.count() if row_count is None else row_count) <= direct_rows:
        grouped = named.groupBy("segment").agg(*sums, F.percentile("_y", F.lit(0.5)).alias("median"))
        top = topk_groups(grouped, "segment", "sum", limit)
    else:
        # Only `limit` segments are reported, so medians are worked out for those alone.
        span = [F.min("_y").alias("lo"), F.max("_y").alias("hi")]
        best = settle(topk_groups(named.groupBy("segment").agg(*sums, *span), "segment", "sum", limit))
        kept = named.where(F.col("segment").isin([r["segment"] for r in best.collect()]))
        sizes = best.select("segment", F.col("count").alias("n"), "lo", "hi")
        medians = group_quantiles(kept, ["segment"], "_y", (0.5,), sizes=sizes, direct_rows=direct_rows)
        top = best.join(medians.withColumnRenamed("q0", "median"), "segment")
    share = F.coalesce(F.try_divide(F.col("sum"), total) * 100, F.lit(0.0))
    return top.select("segment", "count", "sum", "mean", "median", share.alias("share")).orderBy(
        F.desc("sum"), "segment"
    )
