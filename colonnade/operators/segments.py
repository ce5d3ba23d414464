"""Choosing the metric and the dimension a dataset is read by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions import scalars as S
from colonnade.functions import vocabulary as V
from colonnade.functions.columns import SOURCE, categorical_columns
from colonnade.operators.quality import label_counts
from colonnade.operators.statistics import more_labels_than

# Most labels of a dimension, and the label count a dimension is best near to.
DIMENSION_MAX = 50
DIMENSION_IDEAL = 8


def dimension_candidates(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    labels: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """(ordinal, column, nunique, preferred, usable) of the label columns that could be a dimension.
    Label counts that are known already save the pass over the data."""
    names = list(columns) if columns is not None else categorical_columns(df)
    names = [c for c in names if c.lower() != SOURCE]
    if labels is None:
        # Columns proven to have more labels by their hashes are left out before any label is counted.
        crowded = more_labels_than(df, names, DIMENSION_MAX)
        places = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))]) if names else F.lit(None)
        labels = label_counts(df, [c for c in names if c not in crowded])
        labels = labels.withColumn("ordinal", places[F.col("column")]) if names else labels
    # At most half as many labels as rows, though two are always allowed.
    cap = min(DIMENSION_MAX, max(2, (df.count() if rows is None else rows) // 2))
    counted = labels.where(F.col("column").isin(names)).groupBy("ordinal", "column").agg(
        F.count(F.lit(1)).alias("nunique")
    )
    return counted.where(F.col("nunique").between(2, DIMENSION_MAX)).withColumns(
        {
            "preferred": S.contains_any(F.lower("column"), V.DIMENSION_WORDS),
            "usable": F.col("nunique") <= cap,
        }
    )


def primary_dimension(df: DataFrame, columns: Sequence[str] | None = None, **known) -> DataFrame:
    """The dimension to break a dataset down by: listed names first, then near eight labels, then the
    last name; where none is small enough for the data, the first with up to fifty labels."""
    c = dimension_candidates(df, columns, **known)
    near = F.abs(F.col("nunique") - DIMENSION_IDEAL)
    return c.orderBy(
        F.desc("usable"),
        F.when(F.col("usable"), ~F.col("preferred")),
        F.when(F.col("usable"), near),
        F.desc(F.when(F.col("usable"), F.col("column"))),
        "ordinal",
    ).limit(1).select("column", "nunique")


def is_energy_unit(column: Column) -> Column:
    return F.lower(column).contains(V.ENERGY_UNIT)


def kpi_order(domain: str | None) -> list[Column]:
    """Sort order that puts the primary metric first."""
    unit = is_energy_unit(F.col("column")) & F.lit(domain == V.ENERGY)
    return [F.desc(unit), F.desc(F.abs("sum")), F.desc(F.abs("mean")), F.col("ordinal")]


def primary_kpi(stats: DataFrame, domain: str | None = None) -> DataFrame:
    """The metric with the largest absolute sum; in the energy domain among those in the common
    energy unit, where there are any."""
    return stats.orderBy(*kpi_order(domain)).limit(1)


def rank_kpis_by_dataset(
    stats: DataFrame, trends: DataFrame, spikes: DataFrame, domain: str | None = None, limit: int = 3
) -> DataFrame:
    """(dataset, rank, column, ...) over tables of several datasets.  A window partition holds the
    metrics of one dataset."""
    first = F.row_number().over(Window.partitionBy("dataset").orderBy(*kpi_order(domain))) == 1
    on = ["dataset", "column"]
    signals = (
        stats.withColumn("primary", first)
        .join(trends.select(*on, F.abs("change_pct").alias("trend")), on, "left")
        .join(spikes.select(*on, "distance_iqr"), on, "left")
        .select(
            "dataset", "column", "ordinal", "primary",
            F.coalesce("trend", F.lit(0.0)).alias("trend"),
            F.coalesce("distance_iqr", F.lit(0.0)).alias("distance_iqr"),
            S.variation(F.col("std"), F.col("mean")).alias("cv"),
        )
    )
    order = [F.desc("primary"), F.desc("trend"), F.desc("distance_iqr"), F.desc("cv"), "ordinal"]
    place = F.row_number().over(Window.partitionBy("dataset").orderBy(*order))
    return signals.withColumn("rank", place).where(F.col("rank") <= limit)


def rank_kpis(
    stats: DataFrame, trends: DataFrame, spikes: DataFrame, domain: str | None = None, limit: int = 3
) -> DataFrame:
    """The primary metric, then the others by trend, outlier distance and variation."""
    one = [t.withColumn("dataset", F.lit("")) for t in (stats, trends, spikes)]
    return rank_kpis_by_dataset(*one, domain, limit).drop("dataset")


def metric_direction(column: Column) -> Column:
    """Whether a higher value is good, bad or neither, by the words in the name; good words win."""
    name = F.replace(F.lower(column), F.lit(" "), F.lit("_"))
    return (
        F.when(S.contains_any(name, V.HIGHER_IS_GOOD), "higher_is_good")
        .when(S.contains_any(name, V.HIGHER_IS_BAD), "higher_is_bad")
        .otherwise("neutral")
    )


def is_unfavourable(column: Column, direction: Column) -> Column:
    wanted = metric_direction(column)
    return ((direction == "increase") & (wanted == "higher_is_bad")) | (
        (direction == "decrease") & (wanted == "higher_is_good")
    )


def is_volumetric(column: Column, domain: str) -> Column:
    """An energy figure that is not in the common unit, so not comparable across fuels."""
    return F.lit(domain == V.ENERGY) & ~is_energy_unit(column)


def leading_segments(segments: DataFrame) -> DataFrame:
    """The largest segment of each dataset and how many are reported, over segment tables."""
    order = Window.partitionBy("dataset").orderBy(F.desc("sum"), "segment")
    placed = segments.withColumns(
        {"place": F.row_number().over(order), "reported": F.count(F.lit(1)).over(Window.partitionBy("dataset"))}
    )
    return placed.where("place = 1").drop("place")


def concentration(segments: DataFrame, share: float = 50.0) -> DataFrame:
    """The leading segment, when it holds at least `share` percent and is not alone."""
    top = leading_segments(segments.withColumn("dataset", F.lit("")))
    return top.where((F.col("share") >= share) & (F.col("reported") > 1)).select("segment", "share")
