"""Column statistics: every column of a frame in one wide aggregation, returned as tidy rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade import config
from colonnade.functions import scalars as S
from colonnade.functions.columns import (
    as_double,
    numbers_of,
    numeric_columns,
    present,
    profiled_columns,
    quoted,
)
from colonnade.functions.quantiles import quantile_columns, quantiles
from colonnade.session import local_table, settle

STATS_SCHEMA = (
    "ordinal int, column string, n long, sum double, mean double, std double, min double, max double, "
    "skew double, q1 double, median double, q3 double, iqr double"
)

_QUARTS = ("q1", "median", "q3")


def tidy(df: DataFrame, metrics: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregation holding every metric of every column, then one row per column."""
    if not metrics:
        raise ValueError("no column to aggregate")
    names = list(metrics)
    labels = list(metrics[names[0]])
    wide = df.agg(
        *[
            F.struct(*[metrics[c][m].alias(m) for m in labels]).alias(f"s{i}")
            for i, c in enumerate(names)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"s{i}").alias("s"))
            for i, c in enumerate(names)
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.ordinal", "r.column", "r.s.*")


def bias_corrected_skew(x: Column) -> Column:
    """Sample skewness G1; 0 for a constant column, NULL under three values."""
    n = F.count(x).cast("double")
    g1 = F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, F.coalesce(F.nanvl(g1, F.lit(0.0)), F.lit(0.0)))


def moment_metrics(x: Column) -> dict[str, Column]:
    return {
        "n": F.count(x),
        "sum": F.sum(x),
        "mean": F.avg(x),
        "std": F.stddev_samp(x),
        "min": F.min(x),
        "max": F.max(x),
        "skew": bias_corrected_skew(x),
    }


def column_stats(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    min_values: int = 3,
    rows: int | None = None,
    direct_rows: int = config.DIRECT_ROWS,
) -> DataFrame:
    """Per numeric column with at least `min_values` values: n, sum, mean, std, min, max, skew, q1,
    median, q3, iqr."""
    names = list(columns) if columns is not None else numeric_columns(df)
    rows = df.count() if rows is None else rows
    values = numbers_of(df, names)
    moments = {c: moment_metrics(quoted(c)) for c in names}
    if rows <= direct_rows:
        quarts = quantile_columns(values, names, rows=rows, direct_rows=direct_rows)
        table = tidy(values, {c: moments[c] | dict(zip(_QUARTS, quarts[c])) for c in names})
    else:
        # The moments are one pass, and its counts and extremes start the search for the quartiles.
        known = settle(tidy(values, moments))
        bounds = {r["column"]: (r["n"], r["min"], r["max"]) for r in known.collect()}
        found = quantiles(df, names, rows=rows, bounds=bounds, direct_rows=direct_rows)
        found_rows = {"column": names} | {q: [found[c][i] for c in names] for i, q in enumerate(_QUARTS)}
        quarts = local_table(df.sparkSession, found_rows, "column string, q1 double, median double, q3 double")
        table = known.join(F.broadcast(quarts), "column").select("ordinal", "column", *list(moments[names[0]]), *_QUARTS)
    return table.where(F.col("n") >= min_values).withColumn("iqr", F.col("q3") - F.col("q1"))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of the numeric columns."""
    return column_stats(df, columns, min_values=0).select(
        "column", F.col("n").alias("count"), "mean", "std", "min",
        F.col("q1").alias("p25"), F.col("median").alias("p50"), F.col("q3").alias("p75"), "max",
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values (NULL or NaN) per column, all columns in one pass."""
    names = list(columns) if columns is not None else profiled_columns(df)
    return tidy(df, {c: {"nulls": F.count_if(present(df, c).isNull())} for c in names})


def null_total(df: DataFrame) -> DataFrame:
    return null_counts(df).agg(F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"))


def null_report(df: DataFrame) -> DataFrame:
    """Only the columns that have missing values."""
    return null_counts(df).where("nulls > 0")


def worst_nulls(df: DataFrame, limit: int = 4) -> DataFrame:
    return null_report(df).orderBy(F.desc("nulls"), "ordinal").limit(limit)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nunique) of the columns that have values: the distinct 128-bit hashes of each, numbered by column, in two
    grouping steps.  Rows of 20 bytes are combined before the shuffle, whatever the values are; no row is copied whole
    once a column."""
    marks = F.array(*[
        F.when(present(df, c).isNotNull(), F.struct(
            F.lit(i).alias("place"), F.xxhash64(present(df, c)).alias("one"), F.xxhash64(F.lit(1), present(df, c)).alias("two")
        )) for i, c in enumerate(columns)
    ])
    each = df.select(F.explode(marks).alias("m")).where("m IS NOT NULL").groupBy("m.place", "m.one", "m.two").agg(F.lit(1))
    counted = each.groupBy("place").agg(F.count(F.lit(1)).alias("nunique"))
    return counted.select(F.element_at(F.array(*map(F.lit, columns)), F.col("place") + 1).alias("column"), "nunique")


def nunique(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column; `approx` keeps only a small sketch per column."""
    names = list(columns) if columns is not None else profiled_columns(df)
    if approx:
        return tidy(df, {c: {"nunique": F.approx_count_distinct(present(df, c))} for c in names})
    listed = local_table(df.sparkSession, {"ordinal": list(range(len(names))), "column": names}, "ordinal int, column string")
    found = distinct_counts(df, names)
    return listed.join(found, "column", "left").select("ordinal", "column", F.coalesce("nunique", F.lit(0)).cast("long").alias("nunique"))


def more_labels_than(df: DataFrame, columns: Sequence[str], limit: int) -> set[str]:
    """Columns that have more than `limit` distinct values beyond doubt: a sketch with an error of one in twenty sees more
    than twice as many.  One pass, a few hundred bytes a column; what is left over has to be counted."""
    if not columns:
        return set()
    row = df.agg(*[F.approx_count_distinct(present(df, c), 0.05).alias(f"h{i}") for i, c in enumerate(columns)]).first()
    return {c for i, c in enumerate(columns) if row[i] > 2 * limit}


def pearson_corr(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson r of every pair of numeric columns over the rows where both are present."""
    names = list(columns) if columns is not None else numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    if not pairs:
        raise ValueError("two numeric columns are needed")
    wide = df.agg(
        *[F.corr(as_double(df, a), as_double(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(F.inline(rows))


def kpi_cards(df: DataFrame, name: str) -> DataFrame:
    """rows, cols, numeric cols and missing values of one dataset."""
    names = profiled_columns(df)
    missing = F.lit(0).cast("long")
    for c in names:
        missing = missing + F.count_if(present(df, c).isNull())
    return df.agg(F.count(F.lit(1)).alias("rows"), missing.alias("nulls")).select(
        F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).alias("cols"),
        F.lit(len(numeric_columns(df))).alias("numeric_cols"), "nulls",
    )


def quick_summary(df: DataFrame, name: str) -> DataFrame:
    """Rows, numeric columns and missing values, with mean, median and maximum of every numeric column."""
    head = kpi_cards(df, name).select("dataset", "rows", "numeric_cols", "nulls")
    first = numeric_columns(df)
    if not first:
        return head.select("*", *[F.lit(None).cast(t).alias(c) for c, t in
                                  (("column", "string"), ("mean", "double"), ("median", "double"), ("max", "double"))])
    stats = column_stats(df, first, min_values=1).select(
        F.lit(name).alias("dataset"), "column", "mean", "median", "max"
    )
    return head.join(stats, "dataset", "left")


def distribution_class(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns) if columns is not None else numeric_columns(df)
    x = {c: {"n": F.count(as_double(df, c)), "skew": bias_corrected_skew(as_double(df, c))} for c in names}
    return tidy(df, x).withColumn("distribution", S.skew_class(F.col("skew")))


def high_variability(stats: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Columns whose coefficient of variation passes `threshold` percent."""
    cv = S.variation(F.col("std"), F.col("mean"))
    return stats.withColumn("cv", cv).where((F.col("mean") != 0) & (F.col("cv") > threshold))


def volatility(stats: DataFrame) -> DataFrame:
    cv = S.variation(F.col("std"), F.col("mean"))
    return stats.withColumn("cv", cv).withColumn("band", S.volatility_band(F.col("cv")))
