"""Cleaning: names, duplicates, typing, imputation, capping - in that order - and its reports.

Each step decides from one wide aggregation and ends as a projection, so the cleaned frame is a
single lazy projection over the (deduplicated) input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import config
from colonnade.functions import scalars as S
from colonnade.functions.columns import (
    as_double,
    is_numeric,
    nan_to_null,
    numeric_columns,
    present,
    profiled_columns,
    quoted,
    string_columns,
)
from colonnade.functions.quantiles import Bounds, extremes, quantiles
from colonnade.operators.aggregates import mode_values
from colonnade.session import empty_table, local_table, stage

NO_MODE = "Unknown"


class NameCollision(ValueError):
    pass


@dataclass
class CleaningLog:
    """What one cleaning run did."""

    rows_in: int = 0
    rows: int = 0
    duplicates: int = 0
    converted: list[str] = field(default_factory=list)
    filled: dict[str, tuple[int, str, object]] = field(default_factory=dict)
    capped: dict[str, int] = field(default_factory=dict)
    columns: int = 0
    nulls_left: int = 0


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trimmed, lower-case names with underscores.  Two names falling together are an error."""
    names = [S.normalize_name(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise NameCollision(f"columns share a normalised name: {', '.join(twice)}")
    return df.toDF(*names)


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def _comparable(df: DataFrame) -> dict[str, Column]:
    """For columns that cannot be grouped by, something that can: a map's entries in order, and the JSON text of
    what holds maps or variants further down."""
    found = {}
    for f in df.schema:
        if isinstance(f.dataType, T.MapType) and not _holds_map(f.dataType.keyType) and not _holds_map(f.dataType.valueType):
            found[f.name] = F.array_sort(F.map_entries(quoted(f.name)))
        elif _holds_map(f.dataType):
            found[f.name] = F.to_json(F.struct(quoted(f.name)))
    return found


def has_duplicates(df: DataFrame) -> tuple[int, bool]:
    """(rows, may hold duplicates).  Equal rows share both hashes, so as many distinct hash pairs as
    rows proves that no row repeats; this shuffles 16 bytes per row instead of the row."""
    special = _comparable(df)
    cols = [special.get(c, quoted(c)) for c in df.columns]
    row = df.agg(
        F.count(F.lit(1)),
        F.count_distinct(F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)),
    ).first()
    return row[0], row[0] != row[1]


def dedupe_rows(df: DataFrame) -> DataFrame:
    """One row of every set of equal rows; nulls count as equal, and so do maps of equal entries."""
    special = _comparable(df)
    if not special:
        return df.dropDuplicates()
    named = {f"__same_{i}": col for i, col in enumerate(special.values())}
    plain = [c for c in df.columns if c not in special]
    return df.withColumns(named).dropDuplicates([*plain, *named]).drop(*named)


def numeric_text_columns(df: DataFrame) -> dict[str, str]:
    """{column: type} for the text columns in which every present value is a number: bigint where all
    are whole numbers, else double.  The empty text counts as missing; a column without values stays
    text."""
    names = string_columns(df)
    if not names:
        return {}
    checks = []
    for c in names:
        x = quoted(c)
        held = x.isNotNull() & (x != "")
        checks += [
            F.count(x),
            F.count_if(held & ~S.is_number_text(x)),
            F.count_if(held & ~S.is_whole_text(x)),
        ]
    row = df.agg(*[c.alias(f"n{i}") for i, c in enumerate(checks)]).first()
    return {
        c: "bigint" if row[3 * i + 2] == 0 else "double"
        for i, c in enumerate(names)
        if row[3 * i] > 0 and row[3 * i + 1] == 0
    }


def type_columns(df: DataFrame) -> DataFrame:
    """Turn wholly numeric text columns into numbers; every other column stays as it is."""
    return _as_numbers(df, numeric_text_columns(df))


def _as_numbers(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    new = {c: S.to_number(quoted(c), kind) for c, kind in kinds.items()}
    return df.withColumns(new) if new else df


def gap_facts(df: DataFrame) -> tuple[int, dict[str, int], Bounds]:
    """Rows, missing values per column that has some, and the extremes of the numeric columns."""
    names, numbers = profiled_columns(df), numeric_columns(df)
    parts = [F.count_if(present(df, c).isNull()) for c in names]
    parts += [f(as_double(df, c)) for c in numbers for f in (F.count, F.min, F.max)]
    row = df.agg(F.count(F.lit(1)), *[x.alias(f"n{i}") for i, x in enumerate(parts)]).first()
    missing = {c: row[i + 1] for i, c in enumerate(names) if row[i + 1]}
    first = len(names) + 1
    bounds = {c: tuple(row[first + 3 * i:first + 3 * i + 3]) for i, c in enumerate(numbers)}
    return row[0], missing, bounds


def impute_values(
    df: DataFrame, facts: tuple | None = None, *, direct_rows: int = config.DIRECT_ROWS
) -> tuple[DataFrame, dict]:
    """Fill numeric gaps with the column's median and other gaps with its smallest most frequent
    value.  Returns the frame and {column: (missing, method, value)}."""
    rows, missing, bounds = gap_facts(df) if facts is None else facts
    if not missing:
        return df, {}
    numbers = [c for c in missing if is_numeric(df.schema[c].dataType)]
    others = [c for c in missing if c not in numbers]
    middle = quantiles(df, numbers, (0.5,), rows=rows, bounds=bounds, direct_rows=direct_rows)
    usual = {r["column"]: r["value"] for r in mode_values(df, others).collect()} if others else {}
    done, new = {}, {}
    for c in numbers:
        value = middle[c][0]
        done[c] = (missing[c], "median", value)
        if value is not None:
            new[c] = F.coalesce(as_double(df, c), F.lit(value))
    for c in others:
        kind = df.schema[c].dataType
        text = c in string_columns(df)
        value = usual.get(c, NO_MODE if text else None)
        done[c] = (missing[c], "mode", value)
        if value is not None:
            new[c] = F.coalesce(quoted(c), F.lit(value).cast(kind))
    return (df.withColumns(new) if new else df), done


@dataclass(frozen=True)
class Fence:
    """Limits of ordinary values of one column."""

    q1: float
    median: float
    q3: float
    low: float
    high: float
    lowest: float = -math.inf
    highest: float = math.inf

    @property
    def iqr(self) -> float:
        return self.q3 - self.q1

    @property
    def crossed(self) -> bool:
        """Whether the extremes, where they are known, lie outside."""
        return self.lowest < self.low or self.highest > self.high

    @classmethod
    def around(
        cls, q1: float, median: float, q3: float, *extremes: float, multiplier: float = config.FENCE_MULTIPLIER
    ) -> Fence:
        reach = multiplier * (q3 - q1)
        return cls(q1, median, q3, q1 - reach, q3 + reach, *extremes)

    def outside(self, value: Column) -> Column:
        return (value < F.lit(self.low)) | (value > F.lit(self.high))


def iqr_fences(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    multiplier: float = config.FENCE_MULTIPLIER,
    *,
    rows: int | None = None,
    bounds: Bounds | None = None,
    direct_rows: int = config.DIRECT_ROWS,
) -> dict[str, Fence]:
    """Quartile fences of every numeric column with a non-zero interquartile range, and the extremes
    of the column."""
    names = list(columns) if columns is not None else numeric_columns(df)
    rows = df.count() if rows is None else rows
    if bounds is None and names and rows > direct_rows:
        bounds = extremes(df, names)
    if bounds is None:
        found = quantiles(df, names, (0.25, 0.5, 0.75, 0.0, 1.0), rows=rows, direct_rows=direct_rows)
    else:
        quarts = quantiles(df, names, rows=rows, bounds=bounds, direct_rows=direct_rows)
        found = {c: [*qs, *bounds[c][1:]] for c, qs in quarts.items()}
    return {
        c: Fence.around(*qs, multiplier=multiplier)
        for c, qs in found.items()
        if qs[0] is not None and qs[2] - qs[0] != 0
    }


def cap_columns(df: DataFrame, fences: dict[str, Fence]) -> DataFrame:
    new = {
        c: S.clip(as_double(df, c), F.lit(f.low), F.lit(f.high)) for c, f in fences.items()
    }
    return df.withColumns(new) if new else df


def iqr_cap(df: DataFrame, *, direct_rows: int = config.DIRECT_ROWS) -> DataFrame:
    """Pull outlying values back to the fences; columns without spread stay as they are."""
    return cap_columns(df, iqr_fences(df, direct_rows=direct_rows))


def _outlier_counts(df: DataFrame, fences: dict[str, Fence]) -> dict[str, int]:
    fences = {c: f for c, f in fences.items() if f.crossed}
    if not fences:
        return {}
    row = df.agg(
        *[F.count_if(f.outside(as_double(df, c))).alias(f"n{i}") for i, (c, f) in enumerate(fences.items())]
    ).first()
    return {c: row[i] for i, c in enumerate(fences) if row[i]}


def clean(
    df: DataFrame, *, key: str | None = None, direct_rows: int = config.DIRECT_ROWS
) -> tuple[DataFrame, CleaningLog]:
    """The whole cleaning run.  Duplicate rows are dropped before typing, so '1' and '1.0' differ.  A `key`
    column is neither filled nor capped.

    When rows do repeat, the deduplicated frame is written once to the checkpoint folder: the
    statistics passes and the result then read it instead of shuffling the input again.
    """
    log = CleaningLog()
    df = normalize_columns(nan_to_null(df))
    log.rows_in, repeated = has_duplicates(df)
    log.rows = log.rows_in
    if repeated:
        df = stage(dedupe_rows(df))
        log.rows = df.count()
    log.duplicates = log.rows_in - log.rows
    kinds = numeric_text_columns(df)
    log.converted = list(kinds)
    df = _as_numbers(df, kinds)
    rows, missing, bounds = gap_facts(df)
    if key is not None:
        missing, bounds = ({c: x for c, x in facts.items() if c != S.normalize_name(key)} for facts in (missing, bounds))
    df, log.filled = impute_values(df, (rows, missing, bounds), direct_rows=direct_rows)
    # A median lies between the extremes, so filling changes the counts only.
    bounds = {c: (rows if n else 0, low, high) for c, (n, low, high) in bounds.items()}
    fences = iqr_fences(df, list(bounds), rows=rows, bounds=bounds, direct_rows=direct_rows)
    log.capped = _outlier_counts(df, fences)
    df = cap_columns(df, {c: f for c, f in fences.items() if c in log.capped})
    log.columns = len(df.columns)
    log.nulls_left = sum(n for n, _, value in log.filled.values() if value is None)
    return df, log


def clean_table(df: DataFrame, **options) -> DataFrame:
    return clean(df, **options)[0]


def prep_report(df: DataFrame, **options) -> DataFrame:
    """(ordinal, step, column, n, value) rows telling what a cleaning run did."""
    log = clean(df, **options)[1]
    rows: list[tuple] = [("rename", None, log.columns, None), ("dedupe", None, log.duplicates, None)]
    rows += [("convert", c, None, "numeric") for c in log.converted]
    for c, (n, method, value) in log.filled.items():
        shown = f"{value:.2f}" if method == "median" and value is not None else value
        rows.append((f"fill_{method}", c, n, shown))
    rows += [("cap", c, n, None) for c, n in log.capped.items()]
    rows += [
        ("final_rows", None, log.rows, None),
        ("final_columns", None, log.columns, None),
        ("final_nulls", None, log.nulls_left, None),
    ]
    listed = [list(x) for x in zip(*[(i, *r) for i, r in enumerate(rows)])]
    names = ("ordinal", "step", "column", "n", "value")
    return local_table(
        df.sparkSession, dict(zip(names, listed)), "ordinal int, step string, column string, n long, value string"
    )


def lenient_counts(names: Sequence[str]) -> list[Column]:
    """Per text column the number of real values and of those that become numbers."""
    counts = []
    for c in names:
        text = F.trim(quoted(c))
        counts += [F.count(S.null_tokens(text)), F.count(S.clean_number(text))]
    return counts


def lenient_numeric_columns(df: DataFrame, share: float = 0.8) -> list[str]:
    """Text columns in which at least `share` of the real values become numbers once separators and
    currency marks are gone."""
    names = string_columns(df)
    if not names:
        return []
    row = df.agg(*[x.alias(f"n{i}") for i, x in enumerate(lenient_counts(names))]).first()
    return [
        c for i, c in enumerate(names) if row[2 * i] > 0 and row[2 * i + 1] / row[2 * i] >= share
    ]


def as_lenient_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({c: S.clean_number(F.trim(quoted(c))) for c in names}) if names else df


def lenient_numeric_coercion(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Mostly numeric text columns as doubles; their remaining values become NULL."""
    return as_lenient_numbers(df, lenient_numeric_columns(df, share))


def capping_audit(raw: DataFrame, cleaned: DataFrame, key: str) -> DataFrame:
    """(column, changed): numeric cells present on both sides whose value differs after cleaning.
    Rows are matched by `key`, which cleaning should be told to leave alone, columns by normalised name.  A row
    without column counts the rows of `raw` that have no partner, if there are any."""
    raw = lenient_numeric_coercion(raw)
    raw = raw.toDF(*[S.normalize_name(c) for c in raw.columns])
    cleaned = cleaned.toDF(*[S.normalize_name(c) for c in cleaned.columns])
    key = S.normalize_name(key)
    shared = [
        c for c in numeric_columns(raw) if c != key and c in numeric_columns(cleaned)
    ]
    schema = "column string, changed long"
    if not shared:
        return empty_table(raw.sparkSession, schema)
    a = raw.select(key, *[as_double(raw, c).alias(f"a{i}") for i, c in enumerate(shared)])
    b = cleaned.select(key, *[as_double(cleaned, c).alias(f"b{i}") for i, c in enumerate(shared)])
    both = a.join(b.withColumn("__met", F.lit(True)), key, "left")
    changed = [F.count_if(~S.near_equal(F.col(f"a{i}"), F.col(f"b{i}"))) for i in range(len(shared))]
    lost = F.count_if(F.col("__met").isNull()).alias("lost")
    wide = both.agg(lost, *[x.alias(f"n{i}") for i, x in enumerate(changed)])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("changed")) for i, c in enumerate(shared)],
        F.struct(F.lit(None).cast("string").alias("column"), F.col("lost").alias("changed")),
    )
    return wide.select(F.inline(rows)).where("changed > 0")
