"""Overview of a collection of datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import SOURCE, is_numeric


def dataset_catalog(datasets: dict[str, DataFrame]) -> DataFrame:
    """One row per dataset and column: kind, position, rows and columns of the dataset."""
    parts = []
    for name, df in datasets.items():
        fields = [f for f in df.schema if f.name != SOURCE]
        listed = F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(f.name).alias("column"),
                    F.lit("numeric" if is_numeric(f.dataType) else "categorical").alias("kind"),
                )
                for i, f in enumerate(fields)
            ]
        )
        counted = df.agg(F.count(F.lit(1)).alias("rows"))
        parts.append(
            counted.select(
                F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).alias("cols"), F.inline(listed)
            )
        )
    return reduce(DataFrame.unionByName, parts)


def catalog_totals(datasets: dict[str, DataFrame]) -> DataFrame:
    """Datasets, columns and records over the whole collection."""
    per = dataset_catalog(datasets).groupBy("dataset").agg(
        F.first("rows").alias("rows"), F.first("cols").alias("cols")
    )
    return per.agg(
        F.count("dataset").alias("datasets"), F.sum("cols").alias("columns"), F.sum("rows").alias("records")
    )
