"""The ranked report of a set of datasets, as plain tables.

`analyse` makes a fixed number of passes over all datasets together and keeps the results as small tables with
one row per column, metric, label or segment; every report table is derived from those.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade import config
from colonnade.functions import scalars as S
from colonnade.functions.columns import SOURCE, categorical_columns, string_columns
from colonnade.operators import label_links, profile, quality, segments, trends
from colonnade.operators.aggregates import segment_breakdown
from colonnade.operators.cleaning import capping_audit
from colonnade.operators.compare import gap_of_stats, source_comparison
from colonnade.operators.sets import select_source
from colonnade.plans import shared_profile
from colonnade.session import empty_table, local_table, settle, stage

PAIR_SCHEMA = "column string, a string, b string, rows_a long, rows_b long, edits int"
#: Near-duplicate labels shown of each dataset where nothing else is asked for; all are counted.
SHOWN_PAIRS = 5
SEGMENT_SCHEMA = "segment string, count long, sum double, mean double, median double, share double"


@dataclass
class DatasetFindings:
    """Small tables about one dataset."""

    name: str
    rows: int
    cols: int
    date_column: str | None
    roles: DataFrame
    nulls: DataFrame
    stats: DataFrame
    spikes: DataFrame
    trends: DataFrame
    labels: DataFrame
    label_pairs: int
    primary: str | None
    dimension: str | None
    segments: DataFrame


@dataclass
class Analysis:
    spark: SparkSession
    domain: str
    datasets: dict[str, DatasetFindings]
    gaps: DataFrame
    sources: dict[str, DataFrame]
    capped: DataFrame
    _every: dict[str, DataFrame] = field(default_factory=dict)

    def every(self, table: str) -> DataFrame:
        """One table of every dataset, tagged with the dataset's name and position."""
        if table not in self._every:
            parts = [
                getattr(d, table).select(F.lit(i).alias("position"), F.lit(d.name).alias("dataset"), "*")
                for i, d in enumerate(self.datasets.values())
            ]
            self._every[table] = reduce(DataFrame.unionByName, parts)
        return self._every[table]

    def overview(self) -> DataFrame:
        found = list(self.datasets.values())
        return local_table(
            self.spark,
            {
                "position": list(range(len(found))),
                "dataset": [d.name for d in found],
                "rows": [d.rows for d in found],
                "cols": [d.cols for d in found],
                "date_column": [d.date_column for d in found],
                "dimension": [d.dimension for d in found],
                "primary": [d.primary for d in found],
                "label_pairs": [d.label_pairs for d in found],
            },
            "position int, dataset string, rows long, cols int, date_column string, dimension string, primary string, label_pairs long",
        )


def _kpis(about: profile.Survey, measures: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    roles = profile.column_roles(about.df, about.date_column, about.facts)
    found = [r["column"] for r in sorted(roles.collect(), key=lambda r: r["ordinal"]) if r["role"] == "kpi"]
    return roles, [c for c in measures if c in found] if measures is not None else found


def _pairs(
    labels: DataFrame, texts: dict[str, list[str]], limit: int | None
) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The first near-duplicate labels of each dataset, or without a `limit` all, and how many pairs there are; all labels
    are searched together.  All pairs are a plan to be run where they are read, and never gathered."""
    place = {n: i for i, n in enumerate(texts)}
    wanted = reduce(lambda x, y: x | y, [(F.col("dataset") == n) & shared_profile.among(cs) for n, cs in texts.items()])
    # The column names the dataset too, and the order puts one dataset after the other.
    number = F.create_map(*[F.lit(x) for n, i in place.items() for x in (n, i)])[F.col("dataset")]
    named = F.concat(number.cast("string"), F.lit("\x1f"), F.col("column"))
    found = label_links.linked(labels.where(wanted).select((number * 100_000 + F.col("ordinal")).alias("ordinal"), named.alias("column"), "label", "n"))
    mine = lambda df, i: df.where(F.startswith("column", F.lit(f"{i}\x1f"))).withColumn("column", F.substring_index("column", "\x1f", -1))
    if not found.labels.limit(1).count():
        blank = empty_table(labels.sparkSession, PAIR_SCHEMA)
        return {n: blank for n in texts}, dict.fromkeys(texts, 0)
    links = label_links.link_counts(found).groupBy(F.substring_index("column", "\x1f", 1).cast("int").alias("d")).agg(F.sum("links").alias("links"))
    totals = {r["d"]: r["links"] // 2 for r in links.collect()}
    if limit is None:
        table = quality.near_pairs(found.labels)
        return {n: mine(table, i) for n, i in place.items()}, {n: totals.get(i, 0) for n, i in place.items()}
    shown = []
    for i in totals:
        own = label_links.Linked(found.labels.where(F.startswith("column", F.lit(f"{i}\x1f"))), found.ties, found.pairs)
        shown.append(label_links.first_pairs(own, limit))
    table = settle(reduce(DataFrame.unionByName, shown))
    return {n: mine(table, i) for n, i in place.items()}, {n: totals.get(i, 0) for n, i in place.items()}


def analyse(
    datasets: dict[str, DataFrame],
    keys: dict[str, str],
    measures: dict[str, Sequence[str]] | None = None,
    raw: dict[str, DataFrame] | None = None,
    *,
    domain: str | None = None,
    prefer_raw: bool = False,
    shown_pairs: int | None = SHOWN_PAIRS,
    direct_rows: int = config.DIRECT_ROWS,
) -> Analysis:
    """`measures` names a dataset's metrics; by default every numeric column but rates and epochs is one.  `keys` order
    rows of equal date.  Segments follow the primary metric.  `shown_pairs` near-duplicate labels of a dataset are listed, all
with None.

    With `prefer_raw` a dataset is read from its frame in `raw` where there is one, so that the report is of values as
    they came, and its cells that cleaning has changed are counted against the frame given."""
    chosen = select_source(datasets, raw)[0] if prefer_raw else datasets
    shared = shared_profile.profile_all(chosen)
    surveys = shared.surveys
    spark = next(iter(surveys.values())).df.sparkSession
    domain = domain or profile.detect_domain({n: s.df for n, s in surveys.items()})
    roles, kpis = {}, {}
    for n, about in surveys.items():
        roles[n], kpis[n] = _kpis(about, (measures or {}).get(n))
    stats = shared_profile.stats_of_all(shared, kpis, direct_rows=direct_rows)
    spikes = shared_profile.spikes_of_all(shared, stats)
    labelled = {n: [c for c in categorical_columns(s.df) if c not in (s.date_column, SOURCE)] for n, s in surveys.items()}
    labels = stage(shared_profile.labels_of_all(shared, labelled))
    texts = {n: [c for c in cs if c in string_columns(surveys[n].df)] for n, cs in labelled.items()}
    pairs, totals = _pairs(labels, texts, shown_pairs)
    dims = shared_profile.tagged({
        n: segments.primary_dimension(s.df, labelled[n], labels=labels.where(F.col("dataset") == n).drop("dataset"), rows=s.rows)
        for n, s in surveys.items()
    })
    dimension = {r["dataset"]: r["column"] for r in dims.collect()}
    found, moves, parts = {}, {}, {}
    primary = {}
    for n, about in surveys.items():
        best = segments.primary_kpi(stats[n], domain).first()
        primary[n] = best["column"] if best else None
        moves[n] = empty_table(spark, trends.TREND_SCHEMA)
        if kpis[n] and about.date_column:
            moves[n] = trends.half_split_trend(about.df, about.date_column, keys[n], kpis[n], direct_rows=direct_rows)
        parts[n] = empty_table(spark, SEGMENT_SCHEMA)
        if dimension.get(n) and primary[n]:
            split = segment_breakdown(about.df, dimension[n], primary[n], row_count=about.rows, direct_rows=direct_rows)
            parts[n] = split.withColumn("segment", F.col("segment").cast("string"))
    every_move, every_part = settle(shared_profile.tagged(moves)), settle(shared_profile.tagged(parts))
    for n, about in surveys.items():
        mine = lambda table: table.where(F.col("dataset") == n).drop("dataset")  # noqa: B023, E731
        nulls = about.facts.where("nulls > 0").select("ordinal", "column", "nulls")
        found[n] = DatasetFindings(
            n, about.rows, len(about.df.columns), about.date_column, roles[n], nulls, stats[n], spikes[n], mine(every_move),
            pairs[n], totals[n], primary[n], dimension.get(n), mine(every_part),
        )
    # A gap needs two datasets to lie between.
    gaps = settle(gap_of_stats(shared_profile.tagged(stats), max(2, len(found))))
    sources = {
        n: settle(source_comparison(s.df, primary[n], raw, direct_rows=direct_rows))
        for n, s in surveys.items()
        if SOURCE in s.df.columns and primary[n]
    }
    capped = {
        n: capping_audit(chosen[n], df, keys[n]) for n, df in datasets.items() if prefer_raw and chosen[n] is not df
    }
    blank = empty_table(spark, "dataset string, column string, changed long")
    return Analysis(spark, domain, found, gaps, sources, settle(shared_profile.tagged(capped)) if capped else blank)


def _concentrations(a: Analysis, share: float = 50.0) -> DataFrame:
    top = segments.leading_segments(a.every("segments"))
    held = top.where((F.col("share") >= share) & (F.col("reported") > 1))
    return held.join(a.overview().select("dataset", "primary"), "dataset")


def _candidate(
    rows: DataFrame, tier: int, kind: str, order: int, score: Column, column: Column, value: Column
) -> DataFrame:
    return rows.select(
        F.lit(tier).alias("tier"), "position", "dataset", F.lit(order).alias("order"),
        F.col("ordinal").cast("int").alias("ordinal"), F.lit(kind).alias("kind"), column.alias("column"),
        value.cast("double").alias("value"), score.cast("double").alias("score"),
    )


def headline_candidates(a: Analysis) -> DataFrame:
    """Everything that could be the headline, with its score.  A gap counts only where no dataset has
    a spike, trend or concentration, and a plain mean only where there is no gap either."""
    column = F.col("column")
    bonus = F.when(segments.is_unfavourable(column, F.col("direction")), 15.0).otherwise(0.0)
    first = F.lit(0).alias("ordinal")
    heads = _concentrations(a).select("*", first)
    gaps = a.gaps.where("gap_ratio <> 0").select(
        "*", F.lit(0).alias("position"), F.lit(None).cast("string").alias("dataset"), first
    )
    leads = a.every("stats").join(
        a.overview().select("dataset", F.col("primary").alias("column")), ["dataset", "column"]
    )
    parts = [
        _candidate(a.every("spikes"), 0, "spike", 0, F.col("distance_iqr") * 8, column, F.col("value")),
        _candidate(a.every("trends"), 0, "trend", 1, F.abs("change_pct") + bonus, column, F.col("change_pct")),
        _candidate(heads, 0, "concentration", 2, F.col("share"), F.col("primary"), F.col("share")),
        _candidate(gaps, 1, "gap", 3, F.col("gap_ratio"), column, F.col("gap_ratio")),
        _candidate(leads, 2, "mean", 4, F.lit(1.0), column, F.col("mean")),
    ]
    return reduce(DataFrame.unionByName, parts)


def headline(a: Analysis) -> DataFrame:
    """The one best candidate: by tier, then score; the first found wins ties."""
    return (
        headline_candidates(a)
        .orderBy("tier", F.desc("score"), "position", "order", "ordinal", "column")
        .limit(1)
        .select("dataset", "kind", "column", "value", "score")
    )


def _fact(
    section: str, metric: str, value=None, column=None, text=None, when: Column | None = None
) -> Column:
    name = F.lit(metric) if when is None else F.when(when, metric)
    return F.struct(
        F.lit(section).alias("section"), name.alias("metric"),
        F.lit(column).cast("string").alias("column"),
        F.lit(value).cast("double").alias("value"),
        F.lit(text).cast("string").alias("text"),
    )


def _facts(rows: DataFrame, *facts: Column) -> DataFrame:
    """The facts that hold of each row, one output row each."""
    return rows.select("dataset", F.inline(F.array(*facts))).where("metric is not null")


def findings_table(a: Analysis, ranked: int = 3) -> DataFrame:
    """The report as (dataset, section, metric, column, value, text) rows."""
    column = F.col("column")
    overview = a.overview()
    spikes, moves, stats = a.every("spikes"), a.every("trends"), a.every("stats")
    top = segments.rank_kpis_by_dataset(stats, moves, spikes, a.domain, ranked).select(
        "dataset", "column", F.lit(True).alias("ranked")
    )
    stats, spikes, moves = (t.join(top, ["dataset", "column"], "left") for t in (stats, spikes, moves))
    in_top = F.coalesce("ranked", F.lit(False))
    cv = S.variation(F.col("std"), F.col("mean"))
    severity = F.when(F.col("distance_iqr") > quality.SEVERE_IQR, "severe").otherwise("moderate")
    pairs = overview.select("dataset", F.col("label_pairs").alias("duplicate_labels"))
    # Pairs are counted already: none need be listed for it.
    unlisted = a.every("labels").where(F.lit(False))
    issues = quality.issue_counts(a.every("nulls"), a.every("spikes"), unlisted).drop("duplicate_labels")
    ratings = quality.rate(pairs.join(issues, "dataset", "left").na.fill(0))
    parts = [
        _facts(
            overview,
            _fact("overview", "rows", F.col("rows")),
            _fact("overview", "columns", F.col("cols")),
            _fact("overview", "domain", text=a.domain),
            _fact("overview", "dimension", column=F.col("dimension")),
            _fact("overview", "date_column", column=F.col("date_column")),
        ),
        _facts(a.every("roles"), _fact("overview", "role", column=column, text=F.col("role"))),
        _facts(
            stats,
            *[_fact("findings", m, F.col(m), column, when=in_top) for m in ("mean", "median", "n", "min", "max", "iqr", "std")],
            _fact("findings", "skew", F.col("skew"), column, S.skew_class(F.col("skew")),
                  in_top & (F.abs("skew") >= config.SKEW_NORMAL)),
            _fact("findings", "cv", cv, column, S.volatility_band(cv), in_top),
            _fact("findings", "direction", None, column, segments.metric_direction(column), in_top),
            _fact("findings", "volumetric", None, column, None, in_top & segments.is_volumetric(column, a.domain)),
            _fact("quality", "high_variability", cv, column, None, (F.col("mean") != 0) & (cv > 50)),
        ),
        _facts(
            spikes,
            _fact("findings", "spike", F.col("value"), column, None, in_top),
            _fact("quality", "outliers", F.col("count"), column, severity),
        ),
        _facts(moves, _fact("findings", "trend", F.col("change_pct"), column, F.col("direction"), in_top)),
        _facts(
            a.every("segments").join(overview.select("dataset", "primary"), "dataset"),
            _fact("findings", "segment_share", F.col("share"), F.col("primary"), F.col("segment")),
        ),
        _facts(
            _concentrations(a),
            _fact("findings", "concentration", F.col("share"), F.col("primary"), F.col("segment")),
        ),
        _facts(a.every("nulls"), _fact("quality", "nulls", F.col("nulls"), column)),
        _facts(a.every("labels"), _fact("quality", "near_duplicate", F.col("edits"), column, F.concat_ws(" | ", "a", "b"))),
        _facts(pairs, _fact("quality", "near_duplicate_pairs", F.col("duplicate_labels"), when=F.col("duplicate_labels") > 0)),
        _facts(a.capped, _fact("quality", "capped", F.col("changed"), column)),
        _facts(ratings, _fact("quality", "rating", F.col("issues"), None, F.col("rating"))),
    ]
    for name, per in a.sources.items():
        parts.append(
            _facts(
                per.withColumn("dataset", F.lit(name)),
                _fact("findings", "source_share", F.col("share"), a.datasets[name].primary, F.col("source")),
            )
        )
    gaps = a.gaps.where("gap_ratio <> 0").withColumn("dataset", F.lit(None).cast("string"))
    parts.append(_facts(gaps, _fact("findings", "cross_dataset_gap", F.col("gap_ratio"), column)))
    totals = summary_totals(a)
    parts.append(
        _facts(
            totals.withColumn("dataset", F.lit(None).cast("string")),
            *[_fact("summary", m, F.col(m).cast("double")) for m in totals.columns],
        )
    )
    return reduce(DataFrame.unionByName, parts)


def summary_totals(a: Analysis) -> DataFrame:
    """Counts over all datasets, the strongest concentration and the widest gap."""
    blank = F.lit(None).cast("double")
    tops = segments.leading_segments(a.every("segments"))
    rows = [
        a.overview().select(F.lit("dataset").alias("kind"), F.col("rows").cast("double").alias("x")),
        a.every("stats").select(F.lit("kpi").alias("kind"), blank.alias("x")),
        a.every("trends").select(F.lit("trend").alias("kind"), blank.alias("x")),
        a.every("spikes").select(
            F.when(F.col("distance_iqr") > quality.SEVERE_IQR, "severe").otherwise("moderate").alias("kind"),
            F.col("count").cast("double").alias("x"),
        ),
        tops.where("share >= 50").select(F.lit("share").alias("kind"), F.col("share").alias("x")),
        a.overview().select(F.lit("label").alias("kind"), F.col("label_pairs").cast("double").alias("x")),
        a.gaps.where("gap_ratio > 3").select(F.lit("gap").alias("kind"), F.col("gap_ratio").alias("x")),
    ]

    def count(*kinds: str) -> Column:
        return F.count_if(F.col("kind").isin(*kinds))

    def of(*kinds: str) -> Column:
        return F.when(F.col("kind").isin(*kinds), F.col("x"))

    return reduce(DataFrame.unionByName, rows).agg(
        count("dataset").cast("int").alias("datasets"),
        F.sum(of("dataset")).cast("long").alias("records"),
        count("kpi").alias("kpis"),
        count("trend").alias("trends"),
        count("severe", "moderate").alias("metrics_with_outliers"),
        F.coalesce(F.sum(of("severe", "moderate")), F.lit(0)).cast("long").alias("records_flagged"),
        count("severe").alias("severe"),
        F.max(of("share")).alias("top_concentration"),
        F.sum(of("label")).cast("long").alias("duplicate_labels"),
        F.max(of("gap")).alias("max_gap"),
    )
