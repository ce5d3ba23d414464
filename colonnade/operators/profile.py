"""What a dataset is: shape, kinds and roles of its columns, dates, business domain."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import config
from colonnade.functions import scalars as S
from colonnade.functions import vocabulary as V
from colonnade.functions.columns import (
    as_double,
    numeric_columns,
    present,
    profiled_columns,
    quoted,
    string_columns,
    temporal_columns,
)
from colonnade.functions.quantiles import quantile_columns
from colonnade.operators.cleaning import as_lenient_numbers, lenient_counts
from colonnade.operators.statistics import moment_metrics, tidy
from colonnade.session import empty_table, local_table, settle

# A numeric column whose mean passes this is taken for epoch milli- or nanoseconds.
EPOCH_MEAN = 1e11
# Share of parsed values that makes a text column a date, by whether its name says so.
DATE_SHARE_NAMED = 0.6
DATE_SHARE = 0.9


def dataset_profile(df: DataFrame, *, direct_rows: int = config.DIRECT_ROWS) -> DataFrame:
    """One row per column: kind, rows, missing values, and for numbers the description and the shape
    of the distribution."""
    numbers = numeric_columns(df)
    quarts = quantile_columns(df, numbers, direct_rows=direct_rows)
    blank = F.lit(None).cast("double")
    metrics = {}
    for c in profiled_columns(df):
        held = {"rows": F.count(F.lit(1)), "nulls": F.count_if(present(df, c).isNull())}
        if c in quarts:
            m = moment_metrics(as_double(df, c))
            m.pop("n"), m.pop("sum")
            m.update(zip(("p25", "p50", "p75"), quarts[c]))
        else:
            m = {k: blank for k in ("mean", "std", "min", "max", "skew", "p25", "p50", "p75")}
        kind = F.lit("numeric" if c in quarts else "categorical")
        metrics[c] = {"kind": kind, **held, **m}
    table = tidy(df, metrics)
    return table.withColumn(
        "distribution", F.when(F.col("kind") == "numeric", S.skew_class(F.col("skew")))
    )


def analysis_plan(df: DataFrame) -> DataFrame:
    """The steps that apply to a dataset, in order.  The step names are fixed values."""
    n_num = len(numeric_columns(df))
    n_cat = len(profiled_columns(df)) - n_num
    gaps = F.lit(False)
    for c in profiled_columns(df):
        gaps = gaps | F.coalesce(F.bool_or(present(df, c).isNull()), F.lit(False))
    steps = [
        (F.col("gaps"), "handle_missing_values"),
        (F.lit(n_num > 0), "descriptive_statistics"),
        (F.lit(n_num > 0), "outlier_detection"),
        (F.lit(n_num >= 2), "correlation_analysis"),
        (F.lit(n_num >= 2), "anomaly_detection"),
        (F.lit(n_cat > 0), "categorical_analysis"),
        (F.lit(True), "visualization"),
        (F.lit(True), "ai_insight_generation"),
    ]
    listed = F.array_compact(F.array(*[F.when(on, step) for on, step in steps]))
    return df.agg(gaps.alias("gaps")).select(F.posexplode(listed).alias("position", "step"))


def is_time_like(df: DataFrame) -> bool:
    return bool(temporal_columns(df))


def date_share(column: str) -> Column:
    """Share of the present values of a text column that read as dates."""
    text = quoted(column)
    return F.avg(F.when(text.isNotNull(), S.parse_date(text).isNotNull().cast("int")))


def date_share_needed(name: Column) -> Column:
    return F.when(S.contains_any(F.lower(name), V.DATE_WORDS), DATE_SHARE_NAMED).otherwise(DATE_SHARE)


def date_candidates(df: DataFrame) -> DataFrame:
    """Per text column the share of its present values that read as dates, and the share needed."""
    names = string_columns(df)
    if not names:
        raise ValueError("no text column")
    shares = tidy(df, {c: {"share": date_share(c)} for c in names})
    needed = date_share_needed(F.col("column"))
    return shares.withColumn("needed", needed).withColumn(
        "is_date", F.coalesce(F.col("share") >= F.col("needed"), F.lit(False))
    )


def detect_date_column(df: DataFrame) -> str | None:
    """The first date or timestamp column, else the first text column that reads as dates."""
    typed = temporal_columns(df)
    if typed:
        return typed[0]
    if not string_columns(df):
        return None
    row = date_candidates(df).where("is_date").orderBy("ordinal").first()
    return row["column"] if row else None


def as_date(df: DataFrame, column: str):
    """The column as a timestamp, parsed where it is text."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return S.parse_date(quoted(column))
    return quoted(column)


def date_range(df: DataFrame, column: str | None = None) -> DataFrame:
    """(column, first, last) of the date column."""
    column = column or detect_date_column(df)
    if column is None:
        return empty_table(df.sparkSession, "column string, first date, last date")
    d = as_date(df, column)
    return df.agg(F.min(d).alias("a"), F.max(d).alias("b")).select(
        F.lit(column).alias("column"), F.to_date("a").alias("first"), F.to_date("b").alias("last")
    )


def detect_epoch_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean of each numeric column and whether it looks like epoch milli- or nanoseconds."""
    names = list(columns) if columns is not None else numeric_columns(df)
    means = tidy(df, {c: {"mean": F.avg(as_double(df, c))} for c in names})
    return means.withColumn("is_epoch", F.coalesce(F.col("mean") > EPOCH_MEAN, F.lit(False)))


def is_rate_name(name: str) -> bool:
    plain = name.lower().replace(" ", "_").replace("-", "_")
    return any(word in plain for word in V.RATE_WORDS)


def detect_rate_columns(df: DataFrame) -> list[str]:
    """Numeric columns named like a fixed conversion rate or factor."""
    return [c for c in numeric_columns(df) if is_rate_name(c)]


def column_facts(df: DataFrame) -> DataFrame:
    """(ordinal, column, rows, nulls, mean) of every column in one pass; no mean for labels."""
    numbers = set(numeric_columns(df))
    return tidy(
        df,
        {
            c: {
                "rows": F.count(F.lit(1)),
                "nulls": F.count_if(present(df, c).isNull()),
                "mean": F.avg(as_double(df, c)) if c in numbers else F.lit(None).cast("double"),
            }
            for c in profiled_columns(df)
        },
    )


@dataclass
class Survey:
    """What one pass tells of a dataset: the frame with its mostly numeric texts read as numbers, its
    facts, rows and date column."""

    df: DataFrame
    facts: DataFrame
    rows: int
    date_column: str | None


def survey(df: DataFrame, share: float = 0.8) -> Survey:
    """Facts, number texts and date texts from the same pass; a second one only where texts turn into
    numbers."""
    numbers, texts = set(numeric_columns(df)), set(string_columns(df))
    blank = F.lit(None).cast("double")
    metrics = {}
    for c in profiled_columns(df):
        real, parsed = lenient_counts([c]) if c in texts else (F.lit(0).cast("long"), F.lit(0).cast("long"))
        metrics[c] = {
            "rows": F.count(F.lit(1)),
            "nulls": F.count_if(present(df, c).isNull()),
            "mean": F.avg(as_double(df, c)) if c in numbers else blank,
            "real": real,
            "parsed": parsed,
            "dated": date_share(c) if c in texts else blank,
        }
    facts = settle(tidy(df, metrics).withColumn("needed", date_share_needed(F.col("column"))))
    rows = facts.orderBy("ordinal").collect()
    coerced = [r["column"] for r in rows if r["real"] and r["parsed"] / r["real"] >= share]
    dates = temporal_columns(df) or [
        r["column"] for r in rows if r["column"] not in coerced and r["dated"] is not None and r["dated"] >= r["needed"]
    ]
    if coerced:
        df = as_lenient_numbers(df, coerced)
        facts = settle(column_facts(df))
    return Survey(df, facts, rows[0]["rows"], dates[0] if dates else None)


def column_roles(df: DataFrame, date_column: str | None = None, facts: DataFrame | None = None) -> DataFrame:
    """(ordinal, column, role): date, timestamp, rate, kpi or category.  With the facts at hand the date
    column is taken as given."""
    if facts is None:
        facts, date_column = column_facts(df), date_column or detect_date_column(df)
    numbers = [c for c in numeric_columns(df) if c != date_column]
    number = F.col("column").isin(numbers)
    rate = F.col("column").isin([c for c in numbers if is_rate_name(c)])
    role = (
        F.when(F.col("column") == F.lit(date_column), "date")
        .when(number & (F.col("mean") > EPOCH_MEAN), "timestamp")
        .when(rate, "rate")
        .when(number, "kpi")
        .otherwise("category")
    )
    return facts.select("ordinal", "column", role.alias("role"))


def year_span(df: DataFrame) -> DataFrame:
    """(column, first, last) of numeric columns named like a year of which over 80 % of the values
    are years."""
    names = [c for c in numeric_columns(df) if "year" in c.lower()]
    if not names:
        return empty_table(df.sparkSession, "ordinal int, column string, first int, last int")
    metrics = {}
    for c in names:
        v = as_double(df, c)
        metrics[c] = {
            "share": F.avg(F.when(v.isNotNull(), S.is_year(v).cast("int"))),
            "first": F.min(v).cast("int"),
            "last": F.max(v).cast("int"),
        }
    return tidy(df, metrics).where("share > 0.8").drop("share")


def alternation(words: Sequence[str]) -> str:
    """A regular expression for the longest of the words that begins at a place, shaped like their trie, so that a place
    is left after as many characters as it shares with a word."""
    branches: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        branches.setdefault(w[:1], []).append(w[1:])
    ends = branches.pop("", None)
    parts = [re.escape(first) + alternation(rest) for first, rest in branches.items()]
    if len(parts) < 2 and not ends:
        return "".join(parts)
    return f"(?:{'|'.join(parts)})" + "?" * bool(ends) if parts else ""


def keyword_hits(datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, keyword) for every keyword found in a column name or text value.  Whole columns are
    read."""
    words = sorted({w for ws in V.DOMAIN_KEYWORDS.values() for w in ws})
    parts = []
    for name, df in datasets.items():
        texts = string_columns(df)
        heading = " ".join(c.lower() for c in df.columns)
        named = [w for w in words if w in heading]
        found = local_table(df.sparkSession, {"keyword": named}, "keyword string")
        # A blank between the values cannot make a keyword, as no keyword holds one.
        text = F.lower(F.concat_ws(" ", *[quoted(c) for c in texts]))
        unnamed = [w for w in words if w not in named]
        if texts and unnamed:
            # At each place the longest keyword that begins there; those it begins with itself are implied, and those
            # that begin later are met at their own places.
            met = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({alternation(unnamed)}))"), 1))
            seen = df.select(F.explode(met).alias("longest")).distinct()
            within = [(w, v) for w in unnamed for v in unnamed if w.startswith(v)]
            implied = local_table(df.sparkSession, dict(zip(("longest", "keyword"), map(list, zip(*within)))), "longest string, keyword string")
            found = found.unionByName(seen.join(F.broadcast(implied), "longest").select("keyword").distinct())
        parts.append(found.select(F.lit(name).alias("dataset"), "keyword"))
    return reduce(DataFrame.unionByName, parts)


def domain_scores(datasets: dict[str, DataFrame]) -> DataFrame:
    """(ordinal, domain, score): keyword hits per domain over all datasets."""
    hits = keyword_hits(datasets)
    listed = [(i, d, w) for i, (d, ws) in enumerate(V.DOMAIN_KEYWORDS.items()) for w in ws]
    table = local_table(
        hits.sparkSession,
        dict(zip(("ordinal", "domain", "keyword"), map(list, zip(*listed)))),
        "ordinal int, domain string, keyword string",
    )
    return table.join(hits, "keyword", "left").groupBy("ordinal", "domain").agg(F.count("dataset").alias("score"))


def detect_domain(datasets: dict[str, DataFrame]) -> str:
    """The domain with most hits, the first listed on ties."""
    best = domain_scores(datasets).orderBy(F.desc("score"), "ordinal").first()
    return best["domain"] if best["score"] > 0 else V.NO_DOMAIN
