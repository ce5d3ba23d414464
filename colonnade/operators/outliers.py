"""Values beyond the quartile fences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade import config
from colonnade.functions.columns import as_double, is_present, numeric_columns, quoted
from colonnade.operators.cleaning import Fence, iqr_fences
from colonnade.operators.statistics import tidy
from colonnade.session import empty_table

OUTLIER_SCHEMA = "dataset string, column string, outliers long"
SPIKE_SCHEMA = (
    "ordinal int, column string, value double, median double, iqr double, distance_iqr double, "
    "count long, is_high boolean"
)


def outlier_rows(df: DataFrame, column: str, *, direct_rows: int = config.DIRECT_ROWS) -> DataFrame:
    """Rows whose value lies outside the fences.  The fences are constants by the time the rows are
    read, so the comparison reaches the file scan."""
    fence = iqr_fences(df, [column], direct_rows=direct_rows).get(column)
    if fence is None or not fence.crossed:
        return df.limit(0)
    return df.where(is_present(df, column) & fence.outside(quoted(column)))


def iqr_outlier_counts(datasets: dict[str, DataFrame], *, direct_rows: int = config.DIRECT_ROWS) -> DataFrame:
    """(dataset, column, outliers) for the columns that have some."""
    out = None
    for name, df in datasets.items():
        fences = {c: f for c, f in iqr_fences(df, direct_rows=direct_rows).items() if f.crossed}
        if not fences:
            continue
        counted = tidy(
            df, {c: {"outliers": F.count_if(f.outside(as_double(df, c)))} for c, f in fences.items()}
        ).select(F.lit(name).alias("dataset"), "column", "outliers")
        out = counted if out is None else out.unionByName(counted)
    if out is None:
        session = next(iter(datasets.values())).sparkSession
        return empty_table(session, OUTLIER_SCHEMA)
    return out.where("outliers > 0")


def spike_value(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    min_values: int = 10,
    fences: dict[str, Fence] | None = None,
    direct_rows: int = config.DIRECT_ROWS,
) -> DataFrame:
    """Per column with at least `min_values` values, the outlier furthest from the median, how many
    outliers there are, and the distance in interquartile ranges (one decimal).  Of two equally far
    outliers the higher one is reported.  Fences that are known already save the quartile passes."""
    names = list(columns) if columns is not None else numeric_columns(df)
    if fences is None:
        fences = iqr_fences(df, names, direct_rows=direct_rows)
    fences = {c: f for c, f in fences.items() if f.crossed}
    if not fences:
        return empty_table(df.sparkSession, SPIKE_SCHEMA)
    metrics = {}
    for c, f in fences.items():
        v = as_double(df, c)
        far = F.when(f.outside(v), F.struct(F.abs(v - f.median).alias("gap"), v.alias("v")))
        metrics[c] = {
            "n": F.count(v),
            "value": F.max(far)["v"],
            "median": F.lit(f.median),
            "iqr": F.lit(f.iqr),
            "count": F.count(far),
        }
    found = tidy(df, metrics).where((F.col("n") >= min_values) & (F.col("count") > 0))
    return found.select(
        "ordinal", "column", "value", "median", "iqr",
        F.round(F.abs(F.col("value") - F.col("median")) / F.col("iqr"), 1).alias("distance_iqr"),
        "count", (F.col("value") > F.col("median")).alias("is_high"),
    )


def spike_severity(spikes: DataFrame, limit: float = 5.0) -> DataFrame:
    """(severity, metrics, records): severe spikes lie more than `limit` interquartile ranges out."""
    band = F.when(F.col("distance_iqr") > limit, "severe").otherwise("moderate")
    return spikes.groupBy(band.alias("severity")).agg(
        F.count(F.lit(1)).alias("metrics"), F.sum("count").alias("records")
    )
