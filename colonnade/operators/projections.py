"""Column choices and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions import scalars as S
from colonnade.functions.columns import SOURCE, as_double, nan_to_null, numeric_columns, present, quoted


def numeric_projection(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in numeric_columns(df)])


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return sorted(set(a.columns) & set(b.columns))


def find_matching_column(df: DataFrame, target: str) -> str | None:
    """The column whose normalised name equals the normalised target."""
    wanted = S.normalize_name(target)
    return next((c for c in df.columns if S.normalize_name(c) == wanted), None)


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value among the numeric (or given) columns."""
    names = list(columns) if columns is not None else numeric_columns(df)
    return df.na.drop(subset=names) if names else df


def drop_nulls_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return nan_to_null(df.select(quoted(x), quoted(y))).na.drop()


def sort_xy(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs in x order, ties in y order.  The place in the input, as the last sort key, lets the sort
    spread many equal pairs over several tasks."""
    pairs = drop_nulls_pair(df, x, y)
    return pairs.orderBy(quoted(x), quoted(y), F.monotonically_increasing_id())


def status_filter(scored: DataFrame, status: str) -> DataFrame:
    return scored.where(F.col("status") == status)


def source_filter(df: DataFrame, source: str, metric: str) -> DataFrame:
    """Rows of one source that have the metric."""
    return df.where((quoted(SOURCE) == source) & present(df, metric).isNotNull())


def year_share(df: DataFrame, column: str) -> DataFrame:
    """Share of present values that are years, and whether that makes it a year column."""
    v = as_double(df, column)
    share = F.avg(F.when(v.isNotNull(), S.is_year(v).cast("int")))
    return df.agg(share.alias("share")).select(
        F.lit(column).alias("column"), "share", (F.col("share") > 0.8).alias("is_year")
    )
