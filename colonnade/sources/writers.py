"""Previews and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import config
from colonnade.functions.columns import quoted


def first_rows(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """The first rows by key.  With one plain key column, that column is read first, and the others only
    where the key is low enough."""
    order = [quoted(k) for k in keys]
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, (T.IntegralType, T.StringType)):
        key = order[0]
        head = [r[0] for r in df.select(key).orderBy(key).limit(rows).collect()]
        if len(head) == rows:
            df = df.where(key.isNull() if head[-1] is None else key.isNull() | (key <= F.lit(head[-1])))
    return df.orderBy(*order).limit(rows)


def preview(df: DataFrame, key: str | Sequence[str], rows: int = 10) -> DataFrame:
    """The first rows by key, each as one JSON record."""
    keys = [key] if isinstance(key, str) else list(key)
    head = first_rows(df, keys, rows)
    return head.select(*[quoted(k) for k in keys], F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def sample_values(df: DataFrame, column: str, key: str, rows: int = config.PREVIEW_ROWS) -> DataFrame:
    """The first non-null values of a column in key order."""
    held = df.select(quoted(key), quoted(column)).where(quoted(column).isNotNull())
    return first_rows(held, [key], rows)


def write_result(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    if kind not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown result format: {kind}")
    writer = df.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
        for side in ("Leading", "Trailing"):
            writer = writer.option(f"ignore{side}WhiteSpace", False)
    writer.format(kind).save(path)
