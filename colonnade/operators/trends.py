"""Change of the means between the earlier and the later half of a dataset."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import config
from colonnade.functions import scalars as S
from colonnade.functions.columns import as_double, numeric_columns, quoted
from colonnade.functions.quantiles import order_statistic
from colonnade.operators.profile import as_date
from colonnade.operators.statistics import tidy
from colonnade.session import empty_table

TREND_SCHEMA = (
    "ordinal int, column string, first_avg double, second_avg double, change_pct double, direction string"
)


# Whole numbers up to this size are exact as doubles.
_EXACT = 1 << 53
_TEXT_STEP = 6


def _halves(number: Column) -> list[Column]:
    """A bigint as two doubles that order it, the first being the greater part."""
    return [F.shiftright(number, 32).cast("double"), number.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("double")]


def _key_parts(df: DataFrame, key: str) -> Iterator[Column]:
    """Doubles without nulls that order rows by key one after the other, null keys last."""
    kind, col = df.schema[key].dataType, quoted(key)
    yield col.isNull().cast("double")
    if isinstance(kind, T.StringType):
        raw = F.encode(F.coalesce(col, F.lit("")), "utf-8")
        longest = df.agg(F.max(F.octet_length(col))).first()[0] or 0
        for at in range(0, longest, _TEXT_STEP):
            part = F.substring(raw, at + 1, _TEXT_STEP)
            # Texts that end here are padded, and come before those that go on with zero bytes.
            yield F.conv(F.rpad(F.hex(part), 2 * _TEXT_STEP, "0"), 16, 10).cast("double")
            yield F.octet_length(part).cast("double")
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        yield from _halves(F.coalesce(_micros(col), F.lit(0).cast("long")))
    elif isinstance(kind, T.LongType):
        yield from _halves(F.coalesce(col, F.lit(0).cast("long")))
    else:
        yield F.coalesce(as_double(df, key), F.lit(0.0))


def _micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def earlier_half(
    df: DataFrame, date_column: str, key: str, *, direct_rows: int = config.DIRECT_ROWS
) -> Column | None:
    """Condition that holds for the first n // 2 rows by (date, key), null dates and null keys last.

    The dividing date is found as an order statistic, and where rows share it the dividing key among
    those, part by part: no row is numbered or sorted.  Rows equal in date and key cannot be told apart;
    where the middle falls between such rows this raises."""
    at = _micros(as_date(df, date_column))
    rows, dated, first, last = df.agg(F.count(F.lit(1)), F.count(at), F.min(at), F.max(at)).first()
    half = rows // 2
    if half == 0:
        return None
    if half <= dated:
        before, tied, ties, wanted = F.lit(False), at.isNotNull(), dated, half
        small = max(abs(first), abs(last)) < _EXACT
        dates = [(at.cast("double"), (float(first), float(last)))] if small else [(p, None) for p in _halves(at)]
    else:
        before, tied, ties, wanted = at.isNotNull(), at.isNull(), rows - dated, half - dated
        dates = []
    parts = chain(dates, ((p, None) for p in _key_parts(df, key)))
    while wanted < ties:
        part, ends = next(parts, (None, None))
        if part is None:
            raise ValueError(f"{ties} rows in the middle are equal in {date_column} and {key}; give a key that tells them apart")
        among = df.where(tied)
        if ends is None:
            ends = among.agg(F.min(part), F.max(part)).first() if ties > direct_rows else (None, None)
        value, below, equal = order_statistic(among, part, wanted - 1, (ties, *ends), direct_rows)
        before = before | (tied & (part < F.lit(value)))
        tied = tied & (part == F.lit(value))
        ties, wanted = equal, wanted - below
    return F.coalesce(before | tied, F.lit(False))


def half_split_trend(
    df: DataFrame,
    date_column: str,
    key: str,
    columns: Sequence[str] | None = None,
    *,
    min_change: float = 0.5,
    direct_rows: int = config.DIRECT_ROWS,
) -> DataFrame:
    """Per column the means of the earlier and later half and the change in percent (one decimal),
    kept when it is at least `min_change` percent either way."""
    names = list(columns) if columns is not None else [c for c in numeric_columns(df) if c != key]
    first = earlier_half(df, date_column, key, direct_rows=direct_rows)
    if first is None or not names:
        return empty_table(df.sparkSession, TREND_SCHEMA)
    halves = {
        c: {
            "first_avg": F.avg(F.when(first, as_double(df, c))),
            "second_avg": F.avg(F.when(~first, as_double(df, c))),
        }
        for c in names
    }
    change = S.pct_change(F.col("first_avg"), F.col("second_avg"))
    table = tidy(df, halves).withColumn("change", change).where(F.abs("change") >= min_change)
    return table.select(
        "ordinal", "column", "first_avg", "second_avg", F.round("change", 1).alias("change_pct"),
        F.when(F.col("change") > 0, "increase").otherwise("decrease").alias("direction"),
    )
