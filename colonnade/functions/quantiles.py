"""Exact quantiles that hold at any size.

The built-in `percentile` keeps every distinct value of a group in one aggregation buffer, so it is
used only for groups of few rows.  A larger group is narrowed down instead: each pass counts the
group's rows in equal-width buckets between a lower and an upper bound, keeps the bucket holding the
wanted rank and tightens the bounds to the values seen in it.  A pass is one column-pruned scan with
map-side partial counts; the group's rows are neither shuffled nor sorted.  Once few rows lie between
the bounds, the last pass counts single values.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade import config
from colonnade.functions.columns import as_double, quoted
from colonnade.session import local_table, stage

_HUGE = sys.float_info.max
QUARTILES = (0.25, 0.5, 0.75)
# Up to this many large groups their bounds are kept on the driver.
_FEW_GROUPS = 1_000
# Up to this many rows a table of bounds is handed to every task; more are joined by a shuffle.
_BROADCAST_ROWS = 500_000

# lo and hi enclose the values that may hold the rank; `below` rows lie under them, `inside` within.
Bounds = dict[str, tuple[int, float, float]]


def _bounded(value: Column) -> Column:
    """Infinite values stand in as the largest finite ones, so that widths stay finite."""
    return F.greatest(F.lit(-_HUGE), F.least(F.lit(_HUGE), value))


def _unbounded(value: float) -> float:
    return math.copysign(math.inf, value) if abs(value) >= _HUGE else value


def _small_side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= _BROADCAST_ROWS else df


def _narrow(rows: DataFrame, spans: DataFrame, targets: DataFrame, keys: list[str], by_value: bool) -> DataFrame:
    """One pass: `targets` (keys, probe, rank, lo, below) with tighter bounds.  `spans` are the
    different bounds (keys, lo, hi) among them; within a group they do not overlap, so a lower bound
    names its span."""
    hits = rows.join(spans, keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
    if by_value:
        bucket = F.col("v")
    else:
        buckets = config.REFINE_BUCKETS
        width = F.col("hi") / buckets - F.col("lo") / buckets
        width = F.when(width > 0, width).otherwise(F.col("hi") - F.col("lo"))
        place = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, width / 2)
        bucket = F.least(F.lit(buckets - 1), F.floor(F.coalesce(place, F.lit(0.0))).cast("int"))
    bins = hits.groupBy(*keys, "lo", bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("inside"), F.min("v").alias("lo2"), F.max("v").alias("hi2")
    )
    # A window partition holds the buckets or the last few values between one pair of bounds.
    run = Window.partitionBy(*keys, "lo").orderBy("bucket")
    bins = bins.withColumn("before", F.sum("inside").over(run) - F.col("inside"))
    start = F.col("below") + F.col("before")
    picked = bins.join(targets, [*keys, "lo"]).where(
        (start <= F.col("rank")) & (F.col("rank") < start + F.col("inside"))
    )
    return picked.select(
        *keys, "probe", "rank", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), start.alias("below"), "inside"
    )


#: Up to this many brackets are constants of the pass; their buckets, or this many single rows, go to the driver.
_INLINE_SPANS = 48
_INLINE_ROWS = 1 << 16


def _narrow_inline(rows: DataFrame, spans: list[tuple[int, float, float]], targets: list[dict], by_value: bool) -> list[dict]:
    """The same pass with the bounds as constants: one scan, one shuffle of bucket counts, no join.  Where a rank falls
    among a bracket's buckets is found on the driver, from at most 4,096 counts a bracket."""
    place = None
    for k, (g, lo, hi) in enumerate(spans):
        held = (F.col("g") == g) & F.col("v").between(lo, hi)
        place = F.when(held, k) if place is None else place.when(held, k)
    hits = rows.select("v", place.alias("s")).where("s is not null")
    if by_value:
        bucket = F.col("v")
    else:
        buckets = config.REFINE_BUCKETS
        lows, widths = [lo for _, lo, _ in spans], []
        for _, lo, hi in spans:
            width = hi / buckets - lo / buckets
            widths.append(width if width > 0 else hi - lo)
        low, width = (F.element_at(F.array(*map(F.lit, values)), F.col("s") + 1) for values in (lows, widths))
        at = F.try_divide(F.col("v") / 2 - low / 2, width / 2)
        bucket = F.least(F.lit(buckets - 1), F.floor(F.coalesce(at, F.lit(0.0))).cast("int"))
    bins = hits.groupBy("s", bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi")
    ).toArrow().sort_by([("s", "ascending"), ("bucket", "ascending")])
    span, inside, lo, hi = (bins[c].to_numpy() for c in ("s", "inside", "lo", "hi"))
    out = []
    for t in targets:
        mine = slice(*np.searchsorted(span, [k := spans.index((t["g"], t["lo"], t["hi"])), k + 1]))
        ends = np.cumsum(inside[mine]) + t["below"]
        k = mine.start + int(np.searchsorted(ends, t["rank"], side="right"))
        out.append(t | {"lo": float(lo[k]), "hi": float(hi[k]), "below": int(ends[k - mine.start] - inside[k]), "inside": int(inside[k])})
    return out


_TARGET = "g int, probe int, rank long, lo double, below long"
_SPAN = "g int, lo double, hi double"


def _search(rows: DataFrame, targets: list[dict], direct_rows: int) -> list[dict]:
    """Order statistics of few groups.  `rows` has a group number `g` and a finite double `v`; a target
    has g, probe, rank, lo, hi, below, inside and comes back with lo = hi = the value at its rank,
    `below` rows under it and `inside` rows equal to it."""
    spark = rows.sparkSession
    while open_ones := [t for t in targets if t["lo"] < t["hi"]]:
        settled = [t for t in targets if t["lo"] >= t["hi"]]
        by_value = max(t["inside"] for t in open_ones) <= direct_rows
        if len(different := sorted({(t["g"], t["lo"], t["hi"]) for t in open_ones})) <= _INLINE_SPANS:
            rows_left = sum({(t["g"], t["lo"], t["hi"]): t["inside"] for t in open_ones}.values())
            targets = settled + _narrow_inline(rows, different, open_ones, by_value and rows_left <= _INLINE_ROWS)
            continue
        wanted = {c: [t[c] for t in open_ones] for c in ("g", "probe", "rank", "lo", "below")}
        spans = dict(zip(("g", "lo", "hi"), map(list, zip(*different))))
        tables = local_table(spark, spans, _SPAN), local_table(spark, wanted, _TARGET)
        found = _narrow(rows, *map(F.broadcast, tables), ["g"], by_value)
        targets = settled + [r.asDict() for r in found.collect()]
    return targets


def _few_quantiles(
    rows: DataFrame, bounds: dict[int, tuple[int, float, float]], probs: Sequence[float], direct_rows: int
) -> dict[int, list[float]]:
    """Quantiles per group number, from each group's (count, minimum, maximum)."""
    targets = []
    for g, (n, low, high) in bounds.items():
        for i, p in enumerate(probs):
            place = p * (n - 1)
            for side, rank in ((0, math.floor(place)), (1, math.ceil(place))):
                targets.append(
                    {"g": g, "probe": 2 * i + side, "rank": rank, "lo": low, "hi": high, "below": 0, "inside": n}
                )
    at = {(t["g"], t["probe"]): _unbounded(t["lo"]) for t in _search(rows, targets, direct_rows)}
    out = {}
    for g, (n, _, _) in bounds.items():
        out[g] = []
        for i, p in enumerate(probs):
            part = p * (n - 1) % 1
            low, high = at[g, 2 * i], at[g, 2 * i + 1]
            out[g].append(low * (1 - part) + high * part if part else low)
    return out


def _many_quantiles(rows: DataFrame, keys: list[str], probs: Sequence[float], direct_rows: int) -> DataFrame:
    """Quantiles of many large groups: the bounds live in staged tables."""
    sizes = stage(
        rows.groupBy(*keys).agg(F.count("v").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )
    places = [F.lit(float(p)) * (F.col("inside") - 1) for p in probs]
    ranks = F.array(*[f(x).cast("long") for x in places for f in (F.floor, F.ceil)])
    targets = sizes.select(
        *keys, F.posexplode(ranks).alias("probe", "rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), "inside"
    )
    targets = stage(targets)
    while True:
        open_ones = targets.where("lo < hi")
        widest, waiting = open_ones.agg(F.max("inside"), F.count(F.lit(1))).first()
        if not waiting:
            break
        spans = _small_side(open_ones.select(*keys, "lo", "hi").distinct(), waiting)
        wanted = _small_side(open_ones.drop("hi", "inside"), waiting)
        narrowed = _narrow(rows, spans, wanted, keys, by_value=widest <= direct_rows)
        targets = stage(targets.where("lo >= hi").unionByName(narrowed))
    value = F.when(F.abs("lo") >= _HUGE, F.signum("lo") * float("inf")).otherwise(F.col("lo"))
    picks = [F.max(F.when(F.col("probe") == i, value)).alias(f"v{i}") for i in range(2 * len(probs))]
    table = targets.groupBy(*keys).agg(*picks).join(sizes.select(*keys, "inside"), keys)
    out = []
    for i, place in enumerate(places):
        part, low, high = place - F.floor(place), F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        out.append(F.when(part > 0, low * (1 - part) + high * part).otherwise(low).alias(f"q{i}"))
    return table.select(*keys, *out)


def extremes(df: DataFrame, names: Sequence[str]) -> Bounds:
    """(count, minimum, maximum) of each column."""
    parts = [f(as_double(df, c)) for c in names for f in (F.count, F.min, F.max)]
    row = df.agg(*[x.alias(f"b{i}") for i, x in enumerate(parts)]).first()
    return {c: tuple(row[3 * i:3 * i + 3]) for i, c in enumerate(names)}


def _refined(
    df: DataFrame, names: list[str], probs: Sequence[float], bounds: Bounds | None, direct_rows: int
) -> dict[str, list[float | None]]:
    bounds = extremes(df, names) if bounds is None else bounds
    values = F.array(*[_bounded(as_double(df, c)) for c in names])
    long = df.select(F.posexplode(values).alias("g", "v")).where("v is not null")
    clipped = {
        i: (n, max(low, -_HUGE), min(high, _HUGE))
        for i, (n, low, high) in enumerate(bounds[c] for c in names) if n
    }
    found = _few_quantiles(long, clipped, probs, direct_rows)
    return {c: found.get(i, [None] * len(probs)) for i, c in enumerate(names)}


def joint_quantiles(
    asked: dict[str, tuple[DataFrame, Bounds]], probs: Sequence[float] = QUARTILES, direct_rows: int = config.DIRECT_ROWS
) -> dict[str, dict[str, list[float | None]]]:
    """Quantiles of columns of several frames, given each column's (count, minimum, maximum), by passes over all frames
    at once."""
    frames, bounds, place = [], {}, {}
    for name, (df, known) in asked.items():
        columns = list(known)
        first = len(place)
        for c in columns:
            n, low, high = known[c]
            if n:
                bounds[len(place)] = (n, max(low, -_HUGE), min(high, _HUGE))
            place[name, c] = len(place)
        if columns:
            values = F.array(*[_bounded(as_double(df, c)) for c in columns])
            long = df.select(F.posexplode(values).alias("g", "v")).where("v is not null")
            frames.append(long.select((F.col("g") + first).alias("g"), "v"))
    found = _few_quantiles(reduce(DataFrame.union, frames), bounds, probs, direct_rows) if bounds else {}
    return {
        name: {c: found.get(place[name, c], [None] * len(probs)) for c in known} for name, (_, known) in asked.items()
    }


def _built_in(df: DataFrame, names: list[str], probs: Sequence[float]) -> dict[str, list[Column]]:
    points = F.array(*[F.lit(float(p)) for p in probs])
    return {c: [F.percentile(as_double(df, c), points)[i] for i in range(len(probs))] for c in names}


def quantile_columns(
    df: DataFrame,
    names: Sequence[str],
    probs: Sequence[float] = QUARTILES,
    *,
    rows: int | None = None,
    direct_rows: int = config.DIRECT_ROWS,
) -> dict[str, list[Column]]:
    """Per column, the quantiles as expressions for one `agg` over `df`: built-in aggregates for a
    small frame, already computed constants for a large one."""
    names = list(names)
    if not names:
        return {}
    if (df.count() if rows is None else rows) <= direct_rows:
        return _built_in(df, names, probs)
    found = _refined(df, names, probs, None, direct_rows)
    return {c: [F.lit(q).cast("double") for q in qs] for c, qs in found.items()}


def quantiles(
    df: DataFrame,
    names: Sequence[str],
    probs: Sequence[float] = QUARTILES,
    *,
    rows: int | None = None,
    bounds: Bounds | None = None,
    direct_rows: int = config.DIRECT_ROWS,
) -> dict[str, list[float | None]]:
    """Per column, the quantiles as numbers.  `bounds` are the (count, minimum, maximum) of the columns
    where they are known; they save a pass over a large frame."""
    names = list(names)
    if not names:
        return {}
    if (df.count() if rows is None else rows) > direct_rows:
        return _refined(df, names, probs, bounds, direct_rows)
    flat = [q for qs in _built_in(df, names, probs).values() for q in qs]
    row = df.agg(*[q.alias(f"q{i}") for i, q in enumerate(flat)]).first()
    width = len(probs)
    return {c: list(row[i * width:(i + 1) * width]) for i, c in enumerate(names)}


def _all_present(keys: Sequence[str]) -> Column:
    held = F.lit(True)
    for k in keys:
        held = held & quoted(k).isNotNull()
    return held


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float] = QUARTILES,
    *,
    extra: Sequence[Column] = (),
    sizes: DataFrame | None = None,
    direct_rows: int = config.GROUP_DIRECT_ROWS,
) -> DataFrame:
    """(keys, extra aggregates, q0, q1, ...) per group; groups with a null key are left out.  `sizes`
    (keys, n, lo, hi) are the count, minimum and maximum per group; where known they save a pass."""
    keys = list(keys)
    df = df.where(_all_present(keys))
    v = as_double(df, value)
    points = F.array(*[F.lit(float(p)) for p in probs])
    direct = [F.percentile(v, points)[i].alias(f"q{i}") for i in range(len(probs))]
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    sizes = sizes.withColumns({"lo": _bounded(F.col("lo")), "hi": _bounded(F.col("hi"))})
    largest = sizes.orderBy(F.desc("n")).limit(_FEW_GROUPS + 1).toArrow()
    counts = largest["n"].to_pylist()
    if not counts or counts[0] <= direct_rows:
        return df.groupBy(*keys).agg(*extra, *direct)
    big = sum(n > direct_rows for n in counts)
    values = df.select(*keys, _bounded(v).alias("v")).where("v is not null")
    if big <= _FEW_GROUPS:
        spark = df.sparkSession
        head = largest.slice(0, big)
        numbers = list(range(big))
        numbered = spark.createDataFrame(head.select(keys).append_column("g", [numbers]))
        bounds = dict(zip(numbers, zip(counts, head["lo"].to_pylist(), head["hi"].to_pylist())))
        rows = values.join(F.broadcast(numbered), keys).select(F.col("g").cast("int").alias("g"), "v")
        found = _few_quantiles(rows, bounds, probs, direct_rows)
        table = {"g": numbers} | {f"q{i}": [found[g][i] for g in numbers] for i in range(len(probs))}
        schema = "g long, " + ", ".join(f"q{i} double" for i in range(len(probs)))
        large_part = numbered.join(F.broadcast(local_table(spark, table, schema)), "g").drop("g")
        large = F.broadcast(numbered.select(*keys))
    else:
        large = stage(sizes.where(F.col("n") > direct_rows).select(*keys))
        large = _small_side(large, large.count())
        large_part = _many_quantiles(values.join(large, keys), keys, probs, direct_rows)
    # Unless all groups were listed and all are large, the others go the built-in way.
    if big < len(counts) or len(counts) > _FEW_GROUPS:
        small = df.join(large, keys, "left_anti").groupBy(*keys).agg(*direct)
        large_part = small.unionByName(large_part)
    return df.groupBy(*keys).agg(*extra).join(large_part, keys) if extra else large_part


def order_statistic(
    df: DataFrame,
    value: Column,
    rank: int,
    bounds: tuple[int, float | None, float | None],
    direct_rows: int = config.DIRECT_ROWS,
) -> tuple[float, int, int]:
    """(value at 0-based `rank`, rows below it, rows equal to it) over the non-null values, given their
    (count, minimum, maximum); the extremes may be None where the rows are few."""
    values = df.select(F.lit(0).alias("g"), _bounded(value.cast("double")).alias("v")).where("v is not null")
    rows, low, high = bounds
    low, high = (-_HUGE if low is None else low), (_HUGE if high is None else high)
    start = {"g": 0, "probe": 0, "rank": rank, "lo": low, "hi": high, "below": 0, "inside": rows}
    (found,) = _search(values, [start], direct_rows)
    return found["lo"], found["below"], found["inside"]
