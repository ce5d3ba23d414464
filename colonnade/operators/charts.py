"""The tidy rows behind each chart, and the rules that choose a chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade import config
from colonnade.functions import scalars as S
from colonnade.functions.columns import (
    SOURCE,
    as_double,
    is_numeric,
    nan_to_null,
    numeric_columns,
    present,
    profiled_columns,
    quoted,
    require,
    temporal_columns,
)
from colonnade.functions.quantiles import group_quantiles, quantiles
from colonnade.operators.aggregates import AGGREGATES, group_agg, value_counts
from colonnade.operators.projections import sort_xy
from colonnade.operators.statistics import bias_corrected_skew, nunique, tidy
from colonnade.session import empty_table

CHARTS = ("histogram", "box", "bar", "line", "scatter", "pie")

# Up to this many groups their fences are small enough to hand to every task.
_BROADCAST_GROUPS = 100_000


def _with_total(df: DataFrame, x: str, chart: DataFrame) -> DataFrame:
    total = df.agg(F.count_distinct(present(df, x))).scalar()
    return chart.withColumn("total_categories", total)


def bar_counts(df: DataFrame, x: str, limit: int = config.BAR_TOP_N) -> DataFrame:
    """Most frequent values, with the number of all categories."""
    return _with_total(df, x, value_counts(df, x, limit))


def bar_agg(df: DataFrame, x: str, y: str, func: str = "mean", limit: int = config.BAR_TOP_N) -> DataFrame:
    return _with_total(df, x, group_agg(df, x, y, func, limit))


def _slices(top: DataFrame, value: str) -> DataFrame:
    """Share of each shown slice among the shown slices."""
    total = top.agg(F.sum(value)).scalar()
    return top.withColumn("share", F.try_divide(F.col(value), total) * 100)


def pie_counts(df: DataFrame, x: str, limit: int = config.PIE_MAX_CATEGORIES) -> DataFrame:
    return _slices(value_counts(df, x, limit), "count")


def pie_agg(df: DataFrame, x: str, y: str, func: str = "mean", limit: int = config.PIE_MAX_CATEGORIES) -> DataFrame:
    return _slices(group_agg(df, x, y, func, limit), "value")


def _binned(df: DataFrame, x: str, bins: int) -> tuple[Column, DataFrame]:
    """Bin number of a value, and the table of all bins.  Equal widths between the finite extremes; the last
    bin is closed.  Infinite values have bin -1 or `bins`, which the table leaves out."""
    v = as_double(df, x)
    finite = F.when(F.abs(v) < float("inf"), v)
    low, high = df.agg(F.min(finite), F.max(finite)).first()
    beyond = F.when(v == float("-inf"), -1).when(v == float("inf"), bins)
    if low is None:
        return beyond, empty_table(df.sparkSession, "bin int, low double, high double")
    width = high / bins - low / bins
    place = F.floor(finite / width - low / width).cast("int") if width > 0 else F.when(finite.isNotNull(), F.lit(0))
    edges = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(low) + F.col("id") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("id") + 1) * F.lit(width)).alias("high"),
    )
    inner = F.when(finite.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)))
    return F.coalesce(beyond, inner), edges


def _with_bins(edges: DataFrame, per_bin: DataFrame, bins: int, value: str) -> DataFrame:
    """All bins, and those of infinite values where there are any."""
    joined = edges.join(per_bin.where("bin is not null"), "bin", "full")
    edge = F.when(F.col("bin") == -1, float("-inf")).when(F.col("bin") == bins, float("inf"))
    return joined.select(
        "bin", F.coalesce("low", edge).alias("low"), F.coalesce("high", edge).alias("high"), value
    ).orderBy("bin")


def histogram(df: DataFrame, x: str, bins: int = config.HISTOGRAM_BINS) -> DataFrame:
    """(bin, low, high, count), empty bins included."""
    place, edges = _binned(df, x, bins)
    counted = df.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return _with_bins(edges, counted, bins, "count").na.fill(0, ["count"])


def histogram_agg(df: DataFrame, x: str, y: str, func: str = "mean", bins: int = config.HISTOGRAM_BINS) -> DataFrame:
    """y aggregated per x bin; a median is shown as the mean."""
    place, edges = _binned(df, x, bins)
    v = as_double(df, y)
    value = {
        "count": F.count(v).cast("double"), "sum": F.sum(v), "min": F.min(v), "max": F.max(v),
    }.get(func, F.avg(v))
    per_bin = df.groupBy(place.alias("bin")).agg(value.alias("value"))
    return _with_bins(edges, per_bin, bins, "value")


def _box_measures(v: Column, low: Column, high: Column) -> list[Column]:
    inside = (v >= low) & (v <= high)
    return [
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if((v < low) | (v > high)).alias("outliers"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count(v).alias("n"),
    ]


def box_stats(df: DataFrame, x: str, *, direct_rows: int = config.DIRECT_ROWS) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 interquartile ranges, outliers beyond."""
    q1, q2, q3 = quantiles(df, [x], direct_rows=direct_rows)[x]
    q1, q2, q3 = (F.lit(q).cast("double") for q in (q1, q2, q3))
    reach = config.FENCE_MULTIPLIER * (q3 - q1)
    return df.agg(*_box_measures(as_double(df, x), q1 - reach, q3 + reach)).select(
        F.lit(x).alias("column"), q1.alias("q1"), q2.alias("median"), q3.alias("q3"), "*"
    )


def box_by_group(df: DataFrame, x: str, y: str, *, direct_rows: int = config.GROUP_DIRECT_ROWS) -> DataFrame:
    """The box of y for each x."""
    require(df, [x, y])
    rows = df.select(present(df, x).alias("group"), as_double(df, y).alias("v")).na.drop()
    boxes = group_quantiles(rows, ["group"], "v", direct_rows=direct_rows).select(
        "group", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    if rows.select("group").distinct().count() <= _BROADCAST_GROUPS:
        boxes = F.broadcast(boxes)
    reach = config.FENCE_MULTIPLIER * (F.col("q3") - F.col("q1"))
    return (
        rows.join(boxes, "group")
        .withColumns({"lo": F.col("q1") - reach, "hi": F.col("q3") + reach})
        .groupBy("group", "q1", "median", "q3")
        .agg(*_box_measures(F.col("v"), F.col("lo"), F.col("hi")))
    )


def line_xy(df: DataFrame, x: str, y: str, max_points: int | None = None) -> DataFrame:
    """Pairs in x order.  Above `max_points` rows, on request, the means of equal-width x bins."""
    require(df, [x, y])
    if max_points and df.count() > max_points:
        pairs = df.select(as_double(df, x).alias(x), as_double(df, y).alias(y)).na.drop()
        place, _ = _binned(pairs, x, max_points)
        return pairs.groupBy(place.alias("_bin")).agg(
            F.avg(quoted(x)).alias(x), F.avg(quoted(y)).alias(y)
        ).drop("_bin").orderBy(quoted(x))
    return sort_xy(df, x, y)


def line_agg(df: DataFrame, x: str, y: str, func: str = "mean") -> DataFrame:
    return group_agg(df, x, y, func)


def line_series(df: DataFrame, y: str, key: str | Sequence[str]) -> DataFrame:
    """y in key order."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*[quoted(k) for k in keys]).select(*[quoted(k) for k in keys if k != y], present(df, y).alias(y))


def _thinned(df: DataFrame, key: Column, max_points: int | None) -> DataFrame:
    """All points, or on request about `max_points` of them picked by a seeded hash of their key, the
    same ones on every run."""
    if not max_points:
        return df
    rows = df.count()
    if rows <= max_points:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(config.FOREST_SEED), key), F.lit(1 << 30)) < int((1 << 30) * max_points / rows))


def scatter_xy(df: DataFrame, x: str, y: str, max_points: int | None = None, key: str | None = None) -> DataFrame:
    point = quoted(key) if key else F.struct(quoted(x), quoted(y))
    return nan_to_null(_thinned(df, point, max_points).select(quoted(x), quoted(y)))


def scatter_series(df: DataFrame, y: str, key: str, max_points: int | None = None) -> DataFrame:
    """Each value against its row key."""
    return nan_to_null(_thinned(df, quoted(key), max_points).select(quoted(key), quoted(y)))


def chart_rows(
    df: DataFrame,
    chart: str,
    x: str,
    y: str | None = None,
    func: str = "count",
    key: str | Sequence[str] | None = None,
) -> DataFrame:
    """The rows for a chart of the user's choice."""
    if chart not in CHARTS:
        raise ValueError(f"unknown chart: {chart}; known: {', '.join(CHARTS)}")
    require(df, [c for c in (x, y) if c])
    func = func if func in AGGREGATES else "mean"
    paired = y is not None and is_numeric(df.schema[y].dataType)
    if chart == "histogram":
        return histogram_agg(df, x, y, func) if paired else histogram(df, x)
    if chart == "box":
        return box_by_group(df, x, y) if paired else box_stats(df, x)
    if chart == "pie":
        return pie_agg(df, x, y, func) if paired else pie_counts(df, x)
    if chart == "bar":
        return bar_agg(df, x, y, func) if paired else bar_counts(df, x)
    if chart == "line":
        if not paired:
            return line_series(df, x, key or x)
        return line_xy(df, x, y) if is_numeric(df.schema[x].dataType) else line_agg(df, x, y, func)
    return scatter_xy(df, x, y) if paired else scatter_series(df, x, key if isinstance(key, str) else x)


def fallback_chart(kind: Column, distribution: Column) -> Column:
    return (
        F.when(kind == "categorical", "pie")
        .when(distribution.isin("right-skewed", "left-skewed"), "histogram")
        .when(distribution == "roughly normal", "box")
        .otherwise("bar")
    )


def guard_chart(chart: Column, kind: Column, unique: Column, time_like: Column) -> tuple[Column, Column]:
    """(chart, reason): the first rule that objects replaces the chart, once."""
    number = kind == "numeric"
    rules = [
        ((chart == "pie") & (unique > config.PIE_MAX_CATEGORIES), "bar", "too many slices"),
        (chart.isin("pie", "bar") & number & (unique > config.BAR_MAX_NUMERIC_UNIQUES), "histogram", "numeric with many values"),
        ((chart == "histogram") & (unique < config.HISTOGRAM_MIN_UNIQUES), "bar", "too few values"),
        ((chart == "line") & ~time_like & ~number, "bar", "no time column"),
        (chart.isin("histogram", "box") & ~number, "bar", "needs numbers"),
    ]
    final, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for hit, better, why in rules[1:]:
        final, reason = final.when(hit, better), reason.when(hit, why)
    return final.otherwise(chart), reason


def _column_facts(df: DataFrame) -> DataFrame:
    """(ordinal, column, kind, nunique, std, distribution): one pass for the moments, one for the distinct values."""
    names = [c for c in profiled_columns(df) if c != SOURCE]
    numbers = set(numeric_columns(df))
    metrics = {}
    for c in names:
        if c in numbers:
            x = as_double(df, c)
            std, skew = F.stddev_samp(x), bias_corrected_skew(x)
        else:
            std, skew = F.lit(None).cast("double"), F.lit(None).cast("double")
        metrics[c] = {
            "kind": F.lit("numeric" if c in numbers else "categorical"),
            "std": std,
            "skew": skew,
        }
    facts = tidy(df, metrics).join(F.broadcast(nunique(df, names).drop("ordinal")), "column")
    facts = facts.select("ordinal", "column", "kind", "nunique", "std", "skew")
    return facts.withColumn("distribution", S.skew_class(F.col("skew")))


def chart_choices(df: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Per column the chart the rules suggest (or the one wanted), the chart kept after the guards,
    and why it changed."""
    facts = _column_facts(df)
    first = wanted if wanted is not None else fallback_chart(F.col("kind"), F.col("distribution"))
    facts = facts.withColumn("suggested", first)
    chart, reason = guard_chart(
        F.col("suggested"), F.col("kind"), F.col("nunique"), F.lit(bool(temporal_columns(df)))
    )
    return facts.withColumns({"chart": chart, "reason": reason})


def best_y_for_category(df: DataFrame) -> DataFrame:
    """The numeric column with the largest standard deviation; the first one on ties."""
    names = [c for c in numeric_columns(df) if c != SOURCE]
    spread = tidy(df, {c: {"std": F.coalesce(F.stddev_samp(as_double(df, c)), F.lit(0.0))} for c in names})
    return spread.orderBy(F.desc("std"), "ordinal").limit(1).select("column", "std")


def best_pair_for_scatter(df: DataFrame, x: str) -> DataFrame:
    """The other numeric column most strongly correlated with x, either way."""
    v = as_double(df, x)
    names = [c for c in numeric_columns(df) if c not in (x, SOURCE)]
    strength = tidy(
        df,
        {c: {"strength": F.coalesce(F.nanvl(F.abs(F.corr(v, as_double(df, c))), F.lit(0.0)), F.lit(0.0))} for c in names},
    )
    return strength.orderBy(F.desc("strength"), "ordinal").limit(1).select("column", "strength")


def auto_charts(df: DataFrame, key: str | Sequence[str] | None = None) -> dict[str, tuple[str, str | None, DataFrame]]:
    """{column: (chart, paired column, rows)} for every column: suggestion, guards, pairing, rows."""
    choices = chart_choices(df).select("column", "kind", "chart").collect()
    numbers = [c for c in numeric_columns(df) if c != SOURCE]
    tallest = best_y_for_category(df).first()["column"] if numbers else None
    charts = {}
    for row in choices:
        column, chart, y = row["column"], row["chart"], None
        if row["kind"] == "categorical" and chart in ("bar", "line", "pie"):
            y = tallest
        elif chart == "scatter" and len(numbers) > 1:
            y = best_pair_for_scatter(df, column).first()["column"]
        charts[column] = (chart, y, chart_rows(df, chart, column, y, "mean", key))
    return charts


def auto_chart_rows(df: DataFrame, key: str | Sequence[str] | None = None) -> DataFrame:
    """All automatic charts as one tidy table: column, chart, paired column, label, value."""
    forms = {
        "bar": lambda r, c, y: (quoted(c).cast("string"), F.col("value" if y else "count")),
        "pie": lambda r, c, y: (quoted(c).cast("string"), F.col("value" if y else "count")),
        "histogram": lambda r, c, y: (F.col("bin").cast("string"), F.col("count")),
    }
    out = None
    for column, (chart, y, rows) in auto_charts(df, key).items():
        if chart in forms:
            label, value = forms[chart](rows, column, y)
            part = rows.select(label.alias("label"), value.cast("double").alias("value"))
        else:
            measures = [c for c in rows.columns if c != "column"]
            part = rows.select(*[quoted(c).cast("double").alias(c) for c in measures]).unpivot(
                [], measures, "label", "value"
            )
        part = part.select(
            F.lit(column).alias("column"), F.lit(chart).alias("chart"),
            F.lit(y).cast("string").alias("paired"), "label", "value",
        )
        out = part if out is None else out.unionByName(part)
    return out
