"""Ranked recommendations from the findings of a set of datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions import scalars as S
from colonnade.operators import segments
from colonnade.plans.findings import Analysis
from colonnade.session import local_table


# Advice that always holds, given in this order where the findings call for less.
GENERAL = ("monitoring", "targets", "definitions", "schedule")


def recommendation_candidates(a: Analysis) -> DataFrame:
    """(score, kind, dataset, column, direction, value) of everything worth recommending."""
    spikes, trends, stats, nulls = (a.every(t) for t in ("spikes", "trends", "stats", "nulls"))
    none = F.lit(None).cast("string")
    cv = S.variation(F.col("std"), F.col("mean"))

    def rows(df, order, kind, score, column, value, direction=none):
        return df.select(
            "position", F.lit(order).alias("order"), F.col("ordinal").cast("int").alias("ordinal"), "dataset",
            F.lit(kind).alias("kind"), column.alias("column"), direction.alias("direction"),
            value.cast("double").alias("value"), score.cast("double").alias("score"),
        )

    gaps = nulls.groupBy("position", "dataset").agg(
        F.sum("nulls").alias("total"), F.min_by("column", F.struct(-F.col("nulls"), "ordinal")).alias("worst")
    ).withColumn("ordinal", F.lit(0))
    parts = [
        rows(
            spikes.where("distance_iqr > 3"), 0, "outlier", F.col("distance_iqr") * 10,
            F.col("column"), F.col("value"),
        ),
        rows(
            trends.where(segments.is_unfavourable(F.col("column"), F.col("direction")) & (F.abs("change_pct") >= 5)),
            1, "trend", F.abs("change_pct") + 20,
            F.col("column"), F.col("change_pct"), F.col("direction"),
        ),
        rows(
            stats.where((F.col("mean") != 0) & (cv > 80)), 2, "volatility", cv / 2,
            F.col("column"), cv,
        ),
        rows(
            gaps, 3, "missing", 15 + F.least(F.col("total"), F.lit(100)) / 10,
            F.col("worst"), F.col("total"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def _general(a: Analysis) -> DataFrame:
    places = range(len(GENERAL))
    table = local_table(a.spark, {"ordinal": list(places), "kind": list(GENERAL)}, "ordinal int, kind string")
    text, last = F.lit(None).cast("string"), F.lit((1 << 31) - 1)
    return table.select(
        last.alias("position"), F.lit(4).alias("order"), "ordinal", text.alias("dataset"), "kind", text.alias("column"),
        text.alias("direction"), F.lit(None).cast("double").alias("value"), F.lit(0.0).alias("score"),
    )


def recommendations(a: Analysis, limit: int = 4) -> DataFrame:
    """The best `limit` candidates, one for each kind and column: rank, score, kind, dataset, column, direction of
    a trend, value.  Where there are fewer, general ones with a score of 0 fill up to four."""
    found = recommendation_candidates(a).unionByName(_general(a))
    best_first = [F.desc("score"), "position", "order", "ordinal"]
    alike = Window.partitionBy("kind", "column").orderBy(*best_first)
    kept = found.withColumn("nth", F.row_number().over(alike)).where("nth = 1")
    # `limit` rows: numbering them needs one task.
    rank = F.row_number().over(Window.orderBy(*best_first)).alias("rank")
    return kept.orderBy(*best_first).limit(limit).select(rank, "score", "kind", "dataset", "column", "direction", "value")
