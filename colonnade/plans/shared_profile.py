"""One profile of all datasets of a report: facts, moments, quartiles, spikes and labels, each in passes over all at once.

Frames of different columns become one frame of numbered metrics, so that a pass is one Spark job whatever the number of
datasets, and the search for quartiles narrows all brackets of all datasets together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade import config
from colonnade.functions import scalars as S
from colonnade.functions.columns import as_double, numeric_columns, present, profiled_columns, quoted, string_columns, temporal_columns
from colonnade.functions.quantiles import QUARTILES, joint_quantiles
from colonnade.operators.cleaning import Fence, as_lenient_numbers, lenient_counts
from colonnade.operators.outliers import SPIKE_SCHEMA, spike_value
from colonnade.operators.profile import Survey, date_share, date_share_needed
from colonnade.operators.quality import label_counts
from colonnade.operators.statistics import STATS_SCHEMA, moment_metrics, tidy
from colonnade.session import empty_table, local_table, settle


#: Columns whose facts and moments are aggregated side by side.
TOGETHER = 3


def tagged(parts: dict[str, DataFrame]) -> DataFrame:
    """Frames of one schema as one, with the dataset's name."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("dataset"), "*") for n, df in parts.items()])


@dataclass
class Profile:
    """Surveys of all datasets, and the moments of every column that is or reads as a number."""

    surveys: dict[str, Survey]
    moments: dict[str, dict[str, dict]]


def _measured(df: DataFrame) -> DataFrame:
    """(ordinal, column, rows, nulls, real, parsed, dated, and the moments): one aggregation over a frame.  The moments of
    a text column are those of its values read as numbers, so that no second pass is needed where it turns numeric."""
    numbers, texts = set(numeric_columns(df)), set(string_columns(df))
    names = profiled_columns(df)
    # Read once a row, however many aggregates use it.
    read = {f"__number_{i}": S.clean_number(F.trim(quoted(c))) for i, c in enumerate(names) if c in texts}
    rows, metrics = df.withColumns(read) if read else df, {}
    for i, c in enumerate(names):
        real, parsed = (lenient_counts([c])[0], F.count(f"__number_{i}")) if c in texts else (F.lit(0).cast("long"), F.lit(0).cast("long"))
        x = as_double(df, c) if c in numbers else F.col(f"__number_{i}") if c in texts else F.lit(None).cast("double")
        metrics[c] = {
            "rows": F.count(F.lit(1)), "nulls": F.count_if(present(df, c).isNull()), "real": real, "parsed": parsed,
            "dated": date_share(c) if c in texts else F.lit(None).cast("double"),
            **{k: m.cast("long" if k == "n" else "double") for k, m in moment_metrics(x).items()},
        }
    # Aggregates of many columns side by side make code too large to be compiled: a few columns each, in one job.
    parts = [
        tidy(rows, {c: metrics[c] for c in names[at : at + TOGETHER]}).withColumn("ordinal", F.col("ordinal") + at)
        for at in range(0, len(names), TOGETHER)
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("needed", date_share_needed(F.col("column")))


def profile_all(datasets: dict[str, DataFrame], share: float = 0.8) -> Profile:
    """One job over all datasets."""
    rows = sorted(tagged({n: _measured(df) for n, df in datasets.items()}).collect(), key=lambda r: r["ordinal"])
    surveys, moments = {}, {}
    for name, df in datasets.items():
        mine = [r for r in rows if r["dataset"] == name]
        coerced = {r["column"] for r in mine if r["real"] and r["parsed"] / r["real"] >= share}
        numbers = set(numeric_columns(df)) | coerced
        dates = temporal_columns(df) or [
            r["column"] for r in mine if r["column"] not in coerced and r["dated"] is not None and r["dated"] >= r["needed"]
        ]
        facts = {
            "ordinal": [r["ordinal"] for r in mine], "column": [r["column"] for r in mine], "rows": [r["rows"] for r in mine],
            "nulls": [r["rows"] - r["n"] if r["column"] in coerced else r["nulls"] for r in mine],
            "mean": [r["mean"] if r["column"] in numbers else None for r in mine],
        }
        table = local_table(df.sparkSession, facts, "ordinal int, column string, rows long, nulls long, mean double")
        surveys[name] = Survey(as_lenient_numbers(df, sorted(coerced)), table, mine[0]["rows"], dates[0] if dates else None)
        moments[name] = {r["column"]: r.asDict() for r in mine if r["column"] in numbers}
    return Profile(surveys, moments)


def stats_of_all(
    profile: Profile, kpis: dict[str, Sequence[str]], min_values: int = 3, direct_rows: int = config.DIRECT_ROWS
) -> dict[str, DataFrame]:
    """The tables of `column_stats`, from the moments at hand and one joint search for all quartiles."""
    spark = next(iter(profile.surveys.values())).df.sparkSession
    asked = {}
    for name, columns in kpis.items():
        found = profile.moments[name]
        asked[name] = (profile.surveys[name].df, {c: (found[c]["n"], found[c]["min"], found[c]["max"]) for c in columns})
    quarts = joint_quantiles(asked, QUARTILES, direct_rows)
    names = [f.split()[0] for f in STATS_SCHEMA.split(", ")]
    out = {}
    for name, columns in kpis.items():
        rows = []
        for place, c in enumerate(columns):
            m = profile.moments[name][c]
            if m["n"] >= min_values:
                q1, median, q3 = quarts[name][c]
                rows.append((place, c, *[m[k] for k in ("n", "sum", "mean", "std", "min", "max", "skew")], q1, median, q3, q3 - q1))
        listed = list(map(list, zip(*rows))) or [[] for _ in names]
        out[name] = local_table(spark, dict(zip(names, listed)), STATS_SCHEMA)
    return out


def spikes_of_all(profile: Profile, stats: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The furthest outlier of every metric: one pass over all datasets."""
    parts = {}
    for name, table in stats.items():
        rows = [r for r in table.collect() if r["iqr"]]
        fences = {r["column"]: Fence.around(r["q1"], r["median"], r["q3"], r["min"], r["max"]) for r in rows}
        if fences:
            parts[name] = spike_value(profile.surveys[name].df, [r["column"] for r in table.collect()], fences=fences)
    spark = next(iter(profile.surveys.values())).df.sparkSession
    found = settle(tagged(parts)) if parts else empty_table(spark, "dataset string, " + SPIKE_SCHEMA)
    return {n: found.where(F.col("dataset") == n).drop("dataset") for n in profile.surveys}


def labels_of_all(profile: Profile, columns: dict[str, Sequence[str]]) -> DataFrame:
    """(dataset, ordinal, column, label, n) of all label columns."""
    return tagged({n: label_counts(profile.surveys[n].df, list(columns[n])) for n in columns})


def among(names: Sequence[str]) -> Column:
    return F.col("column").isin(list(names)) if names else F.lit(False)
