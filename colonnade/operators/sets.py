"""Unions of datasets, and the views built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import SOURCE, nan_to_null, numeric_columns, quoted
from colonnade.operators.projections import shared_columns

VIEW_A = "view_a"
VIEW_B = "view_b"
VIEW_BOTH = "view_intersection"
VIEW_ALL = "unified"


def short_name(name: str) -> str:
    """File name without its extension."""
    return name.rsplit(".", 1)[0] if "." in name else name


def tagged_union(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """Rows of both datasets over their shared columns, each tagged with its source.  Rows are
    appended, not intersected."""
    shared = shared_columns(a, b)
    if not shared:
        raise ValueError("the datasets share no column")
    sides = [
        df.select(*[quoted(c) for c in shared]).withColumn(SOURCE, F.lit(short_name(name)))
        for df, name in ((a, name_a), (b, name_b))
    ]
    return sides[0].unionByName(sides[1])


def union_numeric(datasets: dict[str, DataFrame], complete: bool = True) -> DataFrame:
    """Numeric columns of every dataset appended under one roof, tagged by dataset; a column missing
    from a dataset is null there.  By default only rows complete within their dataset are kept."""
    parts = []
    for name, df in datasets.items():
        names = [c for c in numeric_columns(df) if c != SOURCE]
        if not names:
            continue
        part = nan_to_null(df.select(*[quoted(c) for c in names]))
        if complete:
            part = part.na.drop()
        parts.append(part.withColumn(SOURCE, F.lit(name)))
    if not parts:
        raise ValueError("no dataset has a numeric column")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def build_views(datasets: dict[str, DataFrame]) -> dict[str, dict[str, DataFrame]]:
    """Two datasets give a view each and, where they share columns, one of both, in this order; any other number
    gives a single view holding all."""
    if len(datasets) != 2:
        return {VIEW_ALL: dict(datasets)}
    (name_a, a), (name_b, b) = datasets.items()
    views = {VIEW_A: {name_a: a}, VIEW_B: {name_b: b}}
    if shared_columns(a, b):
        views[VIEW_BOTH] = {VIEW_BOTH: tagged_union(a, b, name_a, name_b)}
    return views


def select_source(
    datasets: dict[str, DataFrame], raw: dict[str, DataFrame] | None = None
) -> tuple[dict[str, DataFrame], bool]:
    """Per dataset its raw frame where one of the same name exists, else the given one; and whether
    any raw frame is used."""
    if not raw:
        return dict(datasets), False
    if not datasets:
        return dict(raw), True
    return {n: raw.get(n, df) for n, df in datasets.items()}, any(n in raw for n in datasets)
