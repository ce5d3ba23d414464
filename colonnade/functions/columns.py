"""Column roles by data type, and NaN handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = "_source"

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers only: booleans are labels and timestamps stay timestamps."""
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, _TEMPORAL)


def is_profiled(dtype: T.DataType) -> bool:
    return not isinstance(dtype, _NESTED)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_profiled(f.dataType) and not is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_temporal(f.dataType)]


def profiled_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_profiled(f.dataType)]


def quoted(name: str) -> Column:
    """Column reference that is safe for names with dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    col = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    return col


def is_present(df: DataFrame, name: str) -> Column:
    """Condition for rows that have the column; its null test reaches the file scan."""
    col = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col.isNotNull() & ~F.isnan(col)
    return col.isNotNull()


def numbers_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns as doubles with NaN read as missing, worked out once per row."""
    return df.select(*[as_double(df, c).alias(c) for c in names])


def as_double(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {
        f.name: present(df, f.name)
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


def require(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
