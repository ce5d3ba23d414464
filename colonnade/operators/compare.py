"""Comparing sources within one frame, and datasets by the metrics they share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade import config
from colonnade.functions import scalars as S
from colonnade.functions import vocabulary as V
from colonnade.functions.columns import SOURCE, as_double, is_numeric, numeric_columns, quoted
from colonnade.functions.quantiles import group_quantiles
from colonnade.operators.cleaning import lenient_numeric_coercion
from colonnade.operators.profile import is_rate_name
from colonnade.operators.projections import find_matching_column
from colonnade.operators.sets import short_name
from colonnade.operators.statistics import column_stats


def unit_column(df: DataFrame) -> str | None:
    """The first numeric column in the common energy unit."""
    return next(
        (c for c in numeric_columns(df) if V.ENERGY_UNIT in c.lower() and not is_rate_name(c)), None
    )


def _raw_values(raw: dict[str, DataFrame], kpi: str) -> DataFrame | None:
    """(source, value, unit value) read from each raw dataset, columns matched by normalised name."""
    parts = []
    for name, df in raw.items():
        df = lenient_numeric_coercion(df)
        column, unit = find_matching_column(df, kpi), unit_column(df)
        held = column is not None and is_numeric(df.schema[column].dataType)
        blank = F.lit(None).cast("double")
        parts.append(
            df.select(
                F.lit(short_name(name)).alias(SOURCE),
                (as_double(df, column) if held else blank).alias("v"),
                (as_double(df, unit) if unit else blank).alias("unit"),
            )
        )
    return reduce(DataFrame.unionByName, parts) if parts else None


def source_comparison(
    df: DataFrame,
    kpi: str,
    raw: dict[str, DataFrame] | None = None,
    *,
    direct_rows: int = config.GROUP_DIRECT_ROWS,
) -> DataFrame:
    """Per source n, mean, median, sum, max and share of the grand sum of the metric, and mean and sum
    of the energy unit where the raw datasets have one.  Values come from the raw dataset of the
    source's name where there is one; raw datasets that are no source of `df` are left out, and a frame
    of fewer than two sources gives no rows."""
    values = df.select(
        quoted(SOURCE).alias(SOURCE), as_double(df, kpi).alias("v"), F.lit(None).cast("double").alias("unit")
    )
    if raw:
        found = values.select(SOURCE).where(quoted(SOURCE).isin([short_name(n) for n in raw])).distinct().collect()
        known = [r[SOURCE] for r in found]
        raw = {n: d for n, d in raw.items() if short_name(n) in known}
    if raw:
        values = values.where(~quoted(SOURCE).isin(known)).unionByName(_raw_values(raw, kpi))
    measures = [
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"),
        F.max("v").alias("max"),
        F.avg("unit").alias("toe_mean"),
        F.sum("unit").alias("toe_sum"),
    ]
    if values.select(SOURCE).where(quoted(SOURCE).isNotNull()).distinct().limit(2).count() < 2:
        values = values.limit(0)
    per = group_quantiles(values, [SOURCE], "v", (0.5,), extra=measures, direct_rows=direct_rows)
    total = values.where(quoted(SOURCE).isNotNull()).agg(F.sum("v")).scalar()
    return per.select(
        F.col(SOURCE).alias("source"), "n",
        *[F.coalesce(c, F.lit(0.0)).alias(a) for c, a in
          (("mean", "mean"), ("q0", "median"), ("sum", "sum"), ("max", "max"))],
        "toe_mean", "toe_sum", S.safe_ratio(F.col("sum") * 100, total).alias("share"),
    )


def gap_of_stats(stats: DataFrame, datasets: int) -> DataFrame:
    """From per-dataset column statistics, the metrics found in all datasets with the lowest and
    highest mean and their ratio (two decimals; NULL for a zero lowest mean)."""
    return (
        stats.groupBy("column")
        .agg(F.count_distinct("dataset").alias("datasets"), F.min("mean").alias("lowest"), F.max("mean").alias("highest"))
        .where(F.col("datasets") == datasets)
        .select("column", "lowest", "highest", F.round(F.try_divide("highest", "lowest"), 2).alias("gap_ratio"))
    )


def cross_dataset_gap(datasets: dict[str, DataFrame], columns: list[str] | None = None) -> DataFrame:
    parts = []
    for name, df in datasets.items():
        names = [c for c in (columns if columns is not None else numeric_columns(df)) if c in df.columns]
        if names:
            parts.append(column_stats(df, names).withColumn("dataset", F.lit(name)))
    return gap_of_stats(reduce(DataFrame.unionByName, parts), len(datasets))
