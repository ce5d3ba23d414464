"""Rows most like a given row."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade import config
from colonnade.functions.columns import as_double, is_present, numeric_columns, quoted


def similar_rows(
    df: DataFrame,
    key: str,
    key_value: object,
    top_n: int = config.SIMILAR_TOP_N,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The rows closest to the row with that key: cosine of standard scores (population deviation)
    over the rows complete in the numeric columns.  Scores have four decimals, ties go by key, a zero
    vector scores 0, and an unknown or incomplete target gives no rows."""
    names = list(columns) if columns is not None else [c for c in numeric_columns(df) if c != key]
    if not names:
        raise ValueError("no numeric column to compare by")
    complete = reduce(and_, [is_present(df, c) for c in names])
    rows = df.where(complete)
    centre = rows.agg(
        *[F.avg(as_double(df, c)).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev_pop(as_double(df, c)).alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    target = rows.where(quoted(key) == F.lit(key_value)).select(
        *[as_double(df, c).alias(f"t{i}") for i, c in enumerate(names)]
    ).first()
    scored = rows.select(F.lit(0.0).alias("similarity_score"), "*")
    if target is None:
        return scored.limit(0)
    k = len(names)
    scale = [s if s else 1.0 for s in centre[k:]]
    wanted = [(target[i] - centre[i]) / scale[i] for i in range(k)]
    length = math.sqrt(sum(t * t for t in wanted))
    z = [(as_double(df, c) - F.lit(centre[i])) / F.lit(scale[i]) for i, c in enumerate(names)]
    dot = reduce(add, [x * F.lit(t) for x, t in zip(z, wanted)])
    norm = F.sqrt(reduce(add, [x * x for x in z])) * F.lit(length)
    cosine = F.coalesce(F.try_divide(dot, norm), F.lit(0.0))
    others = rows.where(quoted(key) != F.lit(key_value)).select(cosine.alias("similarity_score"), "*")
    # Nine decimals keep equal directions equal whatever the order of additions was.
    order = [F.desc(F.round("similarity_score", 9)), quoted(key)]
    # The ranking reads the key and the features only; the other columns are read for the best rows,
    # whose keys reach the scan.
    best = others.select("similarity_score", quoted(key)).orderBy(*order).limit(top_n)
    keys = sorted({r[1] for r in best.collect()})
    found = others.where(quoted(key).isin(keys)).orderBy(*order).limit(top_n)
    return found.withColumn("similarity_score", F.round("similarity_score", 4))
