"""Isolation forest (Liu, Ting, Zhou 2008) on Spark.

Each tree sees a small hash sample of the rows, so all training data together is a few ten thousand
rows; trees are trained in parallel, one group each.  Scoring is a narrow pass over the full data
with the trees broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade import config
from colonnade.functions.columns import SOURCE, as_double, is_present, nan_to_null, numeric_columns, quoted
from colonnade.functions.quantiles import quantiles
from colonnade.session import stage

KEY = "_key"
SCORE = "anomaly_score"
STATUS = "status"
ANOMALY, NORMAL = "Anomaly", "Normal"

_EULER = 0.5772156649015329
_NODE_SCHEMA = "tree int, slot int, feature int, split double, depth double"


def mean_path(n: int) -> float:
    """Average path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator, levels: int) -> list[tuple]:
    """(slot, feature, split, depth) rows of a tree laid out as a complete binary tree: the children of
    slot i are 2i + 1, for values up to the split, and 2i + 2.  A leaf stands at the leftmost slot of
    the last level below it, with the path its points would still need added to its depth; the unset
    slots on the way pass everything to the left."""
    nodes: list[tuple] = []
    waiting = [(0, np.arange(len(x)), 0)]
    while waiting:
        slot, members, depth = waiting.pop()
        part = x[members]
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= levels or len(members) <= 1 or len(varied) == 0:
            last = (slot + 1) * 2 ** (levels - depth) - 1
            nodes.append((last, 0, math.inf, depth + mean_path(len(members))))
            continue
        feature = int(rng.choice(varied))
        split = float(rng.uniform(low[feature], high[feature]))
        if split >= high[feature]:
            split = float(low[feature])
        goes_left = part[:, feature] <= split
        nodes.append((slot, feature, split, 0.0))
        waiting.append((2 * slot + 1, members[goes_left], depth + 1))
        waiting.append((2 * slot + 2, members[~goes_left], depth + 1))
    return nodes


def lay_out(nodes: pd.DataFrame, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, split, depth) by slot."""
    slots = 2 ** (levels + 1) - 1
    feature = np.zeros(slots, dtype=np.int32)
    split, depth = np.full(slots, np.inf), np.zeros(slots)
    at = nodes["slot"].to_numpy()
    feature[at], split[at], depth[at] = nodes["feature"], nodes["split"], nodes["depth"]
    return feature, split, depth


def path_lengths(x: np.ndarray, trees: list, levels: int) -> np.ndarray:
    """Summed path length of each row over the trees."""
    flat, start = x.ravel(), np.arange(len(x), dtype=np.int32) * x.shape[1]
    total = np.zeros(len(x))
    for feature, split, depth in trees:
        slot = np.zeros(len(x), dtype=np.int32)
        for _ in range(levels):
            right = flat.take(start + feature.take(slot)) > split.take(slot)
            slot = 2 * slot + 1 + right
        total += depth.take(slot)
    return total


def _draw(
    rows: DataFrame, key: Column, names: list[str], n: int, trees: int, sample: int, seed: int, unique: bool = True
) -> DataFrame:
    """(tree, features): of every tree the `sample` rows with the least draws, a draw being an exponential number
    hashed from tree and key.  The same at every size, and neither the partitioning nor a retry changes it.

    Where the key is not `unique`, equal rows are counted first; of m equal rows the least draw is the first one's
    divided by m, and the next ones follow in steps that are divided by m - 1, m - 2 and so on."""
    points = [f"x{i}" for i in range(len(names))]
    values = rows.select(key.alias("k"), *[F.col(c).alias(x) for c, x in zip(names, points)])
    if unique:
        counted = values.withColumn("m", F.lit(1))
    else:
        counted = values.withColumn("k", F.xxhash64("k", *points)).groupBy("k", *points).agg(F.count(F.lit(1)).alias("m"))
    # Only draws that can be among the least go on: eight deviations above the expected number of them.
    rate = min(1.0, (sample + 8 * math.sqrt(sample) + 16) / n)

    def uniform(*copy: str) -> Column:
        hashed = F.xxhash64(F.lit(seed), "tree", "k", *copy)
        return F.shiftrightunsigned(hashed, 11).cast("double") / float(1 << 53)

    each = counted.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    near = each.where(uniform() < (F.lit(rate) if unique else 1 - F.pow(F.lit(1 - rate), F.col("m"))))
    # Rows that share key and values come together, and as at most `sample` copies, so that they cannot flood a tree.
    met = near.groupBy("tree", "k", *points).agg(F.sum("m").alias("m"))
    copies = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("m"), F.lit(sample)).cast("int"))))
    turn = F.when(F.col("copy") == 1, uniform()).otherwise(uniform("copy"))
    step = -F.log1p(-turn) / (F.col("m") - F.col("copy") + 1)
    upward = Window.partitionBy("tree", "k", *points).orderBy("copy").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("tree").orderBy("draw", "k", *points, "copy")
    drawn = copies.withColumn("draw", F.sum(step).over(upward))
    return drawn.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("tree", "r", *points)


def isolation_forest(
    df: DataFrame,
    key: str | Sequence[str] | None = None,
    features: Sequence[str] | None = None,
    *,
    unique: bool = True,
    contamination: float = config.CONTAMINATION,
    trees: int = config.FOREST_TREES,
    sample: int = config.FOREST_SAMPLE,
    seed: int = config.FOREST_SEED,
    direct_rows: int = config.DIRECT_ROWS,
) -> DataFrame:
    """Rows complete in the features with `anomaly_score` in (0, 1) and `status`: the rows scoring
    above the (1 - contamination) quantile are anomalies.  `key` names columns that tell rows apart;
    without it, or where it is not `unique`, rows equal in key and features are told apart by number."""
    keys = [key] if isinstance(key, str) else list(key or [])
    names = list(features) if features is not None else [c for c in numeric_columns(df) if c not in keys]
    if not names:
        raise ValueError("no numeric feature")
    held = reduce(and_, [is_present(df, c) for c in names])
    rows = df.where(held)
    plain = rows.select(
        (F.xxhash64(*[quoted(k) for k in keys]) if keys else F.lit(0)).alias(KEY),
        *[as_double(df, c).alias(f"f{i}") for i, c in enumerate(names)],
    )
    inputs = [f"f{i}" for i in range(len(names))]
    n = rows.count()
    if n == 0:
        return rows.withColumns({SCORE: F.lit(0.0), STATUS: F.lit(NORMAL)})
    width = len(inputs)
    levels = math.ceil(math.log2(max(min(sample, n), 2)))
    expected = mean_path(min(sample, n))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        tree = int(pdf["tree"].iloc[0])
        x = pdf[[f"x{i}" for i in range(width)]].to_numpy(dtype=float)
        grown = grow_tree(x, np.random.default_rng([seed, tree]), levels)
        out = pd.DataFrame(grown, columns=["slot", "feature", "split", "depth"])
        out.insert(0, "tree", tree)
        return out

    drawn = _draw(plain, F.col(KEY), inputs, n, trees, sample, seed, unique and bool(keys))
    # At most 2 * sample nodes per tree: the whole forest is a few megabytes at any data size.
    forest = drawn.groupBy("tree").applyInPandas(train, _NODE_SCHEMA).toPandas()
    packed = [lay_out(nodes, levels) for _, nodes in forest.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            depth = path_lengths(x, shared.value, levels) / len(shared.value)
            yield pd.Series(np.exp2(-depth / expected) if expected > 0 else np.full(len(x), 0.5))

    # Scoring is the costly step and its result is needed by the threshold and by the caller.
    point = F.struct(*[as_double(df, c).alias(f"f{i}") for i, c in enumerate(names)])
    scored = stage(rows.withColumn(SCORE, score(point)))
    spread = {SCORE: (n, 0.0, 1.0)}
    limit = quantiles(scored, [SCORE], (1 - contamination,), rows=n, bounds=spread, direct_rows=direct_rows)[SCORE][0]
    return scored.withColumn(STATUS, F.when(F.col(SCORE) > F.lit(limit), ANOMALY).otherwise(NORMAL))


def _numeric_part(name: str, df: DataFrame, key: str | Sequence[str] | None) -> DataFrame | None:
    names = [c for c in numeric_columns(df) if c != SOURCE]
    if not names:
        return None
    told_apart = names if key is None else [key] if isinstance(key, str) else key
    told_apart = [quoted(k) for k in told_apart]
    tag = F.xxhash64(F.lit(name), *told_apart).alias(KEY)
    part = nan_to_null(df.select(tag, *[quoted(c) for c in names])).na.drop(subset=names)
    return part.withColumn(SOURCE, F.lit(name))


def unified_anomaly(
    datasets: dict[str, DataFrame], keys: dict[str, str | Sequence[str]] | None = None, **options
) -> tuple[DataFrame, list[str]]:
    """The numeric rows of all datasets, complete within their dataset, scored by one forest on the
    columns common to all; or by a forest per dataset where none is common.  Without a key equal rows
    are told apart by number.  Returns the scored rows and the common columns."""
    keys = keys or {}
    parts = {n: _numeric_part(n, df, keys.get(n)) for n, df in datasets.items()}
    parts = {n: p for n, p in parts.items() if p is not None}
    if not parts:
        raise ValueError("no dataset has a numeric column")
    common = sorted(set.intersection(*[set(p.columns) for p in parts.values()]) - {SOURCE, KEY})
    if not common:
        return isolation_forest_per_source(datasets, keys, **options), []
    pooled = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values())
    unique = all(keys.get(n) is not None for n in parts)
    return isolation_forest(pooled, KEY, common, unique=unique, **options).drop(KEY), common


def isolation_forest_per_source(
    datasets: dict[str, DataFrame], keys: dict[str, str | Sequence[str]] | None = None, **options
) -> DataFrame:
    """A forest of its own for each dataset, results appended."""
    keys = keys or {}
    scored = []
    for name, df in datasets.items():
        part = _numeric_part(name, df, keys.get(name))
        if part is not None:
            features = [c for c in part.columns if c not in (KEY, SOURCE)]
            scored.append(isolation_forest(part, KEY, features, unique=keys.get(name) is not None, **options).drop(KEY))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scored)


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """Scanned, anomalies, normal and rate in percent, over all and per source."""
    flagged = F.count_if(F.col(STATUS) == ANOMALY)
    return (
        scored.rollup(SOURCE)
        .agg(F.count(F.lit(1)).alias("scanned"), flagged.alias("anomalies"))
        .select(
            F.coalesce(SOURCE, F.lit("all")).alias("source"), "scanned", "anomalies",
            (F.col("scanned") - F.col("anomalies")).alias("normal"),
            (F.col("anomalies") / F.col("scanned") * 100).alias("rate"),
        )
    )


def anomaly_contrast(scored: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature mean and deviation of normal and anomalous rows and the difference of the means in
    normal deviations, largest first."""
    odd = F.col(STATUS) == ANOMALY
    wide = scored.agg(
        *[
            F.struct(
                F.avg(F.when(~odd, as_double(scored, c))).alias("normal_mean"),
                F.stddev_samp(F.when(~odd, as_double(scored, c))).alias("normal_std"),
                F.avg(F.when(odd, as_double(scored, c))).alias("anomaly_mean"),
                F.stddev_samp(F.when(odd, as_double(scored, c))).alias("anomaly_std"),
            ).alias(f"s{i}")
            for i, c in enumerate(features)
        ]
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("s")) for i, c in enumerate(features)]
    )
    gap = F.try_divide(F.col("anomaly_mean") - F.col("normal_mean"), F.col("normal_std"))
    return (
        wide.select(F.explode(rows).alias("r"))
        .select("r.feature", "r.s.*")
        .withColumn("difference", gap)
        .orderBy(F.desc_nulls_last(F.abs("difference")), "feature")
    )
