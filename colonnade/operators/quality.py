"""Data quality: labels that look mistyped, and an overall rating."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions import scalars as S
from colonnade.functions.columns import SOURCE, present, string_columns
from colonnade.operators import label_arrays
from colonnade.session import empty_table, local_table, stage

MAX_EDITS = 2
MIN_LABEL = 5
# Labels up to SHORT_LABEL meet in arrays where their lengths are equal and by deletions where not, those from LONG_LABEL on
# by parts; labels two characters apart in length are always together in one of them.
SHORT_LABEL = 32
LONG_LABEL = 31
SEVERE_IQR = 5.0
LABEL_SCHEMA = "ordinal int, column string, label string, n long"
PAIR_SCHEMA = "ordinal int, column string, a string, b string, rows_a long, rows_b long, edits int"
# Labels of a block when pairs are listed: no fewer than these, and where there are many about as many as those.
BLOCK_LEAST = 256
BLOCK_LABELS = 2048


def label_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(ordinal, column, label, n) of all labels of the columns."""
    names = list(columns)
    if not names:
        return empty_table(df.sparkSession, LABEL_SCHEMA)
    texts = df.select(*[present(df, c).cast("string").alias(f"c{i}") for i, c in enumerate(names)])
    long = texts.unpivot([], list(texts.columns), "k", "label").where("label is not null")
    counted = long.groupBy("k", "label").agg(F.count(F.lit(1)).alias("n"))
    place = F.create_map(
        *[x for i, c in enumerate(names) for x in (F.lit(f"c{i}"), F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")))]
    )[F.col("k")]
    return counted.select(place["i"].alias("ordinal"), place["c"].alias("column"), "label", "n")


def with_lengths(labels: DataFrame) -> DataFrame:
    """Labels with the lengths (`lengths`) there are in their column: one row a column is broadcast, of short labels only."""
    some = labels.where(F.length("label") <= SHORT_LABEL)
    each = some.groupBy("column").agg(F.array_sort(F.collect_set(F.length("label"))).alias("lengths"))
    return labels.join(F.broadcast(each), "column")


def _without(text: Column, place: Column) -> Column:
    """The text without the character at the place; whole where the place is 0."""
    return F.when(place == 0, text).otherwise(
        F.concat(F.substring(text, F.lit(1), place - 1), F.substring(text, place + 1, F.length(text)))
    )


def _deletions(labels: DataFrame, fewest: int = 0, most: int = MAX_EDITS) -> DataFrame:
    """For short labels a hash of every text that is left when up to two characters go, or as many as said.  Two labels at
    most two edits apart have one in common: leave out what either has changed, inserted or lost."""
    texts = labels.where(F.length("label") <= SHORT_LABEL).select("column", "label", F.col("label").alias("text"))
    for k in range(most):
        spots = F.sequence(F.lit(1 if most - k <= fewest else 0), F.length("text"))
        cut = F.array_distinct(F.transform(spots, lambda at: _without(F.col("text"), at)))
        texts = texts.select("column", "label", F.explode(cut).alias("text"))
    return texts.select("column", "label", F.xxhash64("text").alias("mark")).distinct()


def _part(text: Column, length: Column, part: Column, shift: Column) -> Column:
    """The text where the given fourth of a label of that length would stand, moved by `shift`."""
    fourth = F.floor(length / 4).cast("int")
    size = F.when(part < 3, fourth).otherwise(length - 3 * fourth)
    return F.substring(text, F.greatest(F.lit(1), part * fourth + 1 + shift), size)


# Two of four parts, and how far each may have moved by two edits.
_SHIFTS = range(-MAX_EDITS, MAX_EDITS + 1)
_PLACES = [
    (a, b, s, t) for a, b in combinations(range(4), 2) for s in _SHIFTS for t in _SHIFTS if abs(s) + abs(t - s) <= MAX_EDITS
]


def _two_parts(labels: DataFrame, longer: Sequence[int], places: Sequence[tuple[int, ...]]) -> DataFrame:
    """A hash of two of four parts of a label, with its length: as they stand in the label, or as they would in
    others that are longer by so many characters, where the parts stand moved."""
    each = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(p, "abst")]) for p in places])
    spots = labels.select(
        "column", "label", F.explode(F.array(*map(F.lit, longer))).alias("longer")
    ).select("*", F.explode(each).alias("p"), (F.length("label") + F.col("longer")).alias("length"))
    first, second = (_part(F.col("label"), F.col("length"), F.col(f"p.{k}"), F.col(f"p.{m}")) for k, m in ("as", "bt"))
    mark = F.xxhash64("length", "p.a", "p.b", first, second)
    return spots.where(F.col("length") >= LONG_LABEL).select("column", "label", mark.alias("mark")).distinct()


def _unequal(labels: DataFrame, lengths: dict[str, Collection[int]]) -> DataFrame:
    """(column, p, q) of short labels of one column and different lengths that have a mark in common: the longer one without
    two characters, the shorter one whole or without one.  Labels without others of a length that near take no part."""
    def beside(steps: Sequence[int]) -> DataFrame:
        wanted = [F.lit(f"{n} {c}") for c, ns in lengths.items() for n in ns if any(n + k in ns for k in steps)]
        return labels.where(F.array_contains(F.array(*wanted).cast("array<string>"), F.concat_ws(" ", F.length("label"), "column")))

    longer, shorter = _deletions(beside([-1, -2]), fewest=2), _deletions(beside([1, 2]), most=1)
    met = longer.alias("x").join(shorter.alias("y").hint("merge"), ["mark", "column"])
    return met.select("column", F.least("x.label", "y.label").alias("p"), F.greatest("x.label", "y.label").alias("q"))


def near_candidates(labels: DataFrame, lengths: dict[str, Collection[int]] | None = None) -> DataFrame:
    """(column, p, q, edits) of labels of one column at most two edits apart, p < q, of which one at least is longer than the
    short ones; with the `lengths` of each column's short labels also short ones of different lengths.

    Short labels meet by what is left without two characters, long ones by two intact parts of four: a common start alone
    brings no two labels together, and no pair can be missed.

    A small file of labels makes marks of a thousand times its size, and no estimate says so: they are shuffled and merged,
    never broadcast, so that nothing of them passes the driver."""
    long = labels.where(F.length("label") >= LONG_LABEL - MAX_EDITS)
    here = _two_parts(long, [0], [p for p in _PLACES if p[2] == p[3] == 0])
    probes = _two_parts(long, _SHIFTS, _PLACES).withColumnRenamed("label", "other")
    beyond = (F.length("label") > SHORT_LABEL) | (F.length("other") > SHORT_LABEL)
    found = here.join(probes.hint("merge"), ["mark", "column"]).where((F.col("label") != F.col("other")) & beyond).select(
        "column", F.least("label", "other").alias("p"), F.greatest("label", "other").alias("q")
    )
    if lengths is not None:
        found = found.union(_unequal(labels, lengths))
    # Several marks and both directions may lead to one pair.
    return (
        found.distinct()
        .withColumn("edits", S.edit_distance(F.col("p"), F.col("q"), MAX_EDITS))
        .where(F.col("edits").between(1, MAX_EDITS))
    )


def _blocks(labels: DataFrame) -> tuple[DataFrame, int]:
    """Labels in the order in which pairs name them first, with a number in that order (`id`) and that of a block of
    neighbours (`block`), and the number of blocks: some for each core, and more where they would be large."""
    spark = labels.sparkSession
    total = labels.count()
    blocks = max(1, min(total // BLOCK_LEAST, max(4 * spark.sparkContext.defaultParallelism, total // BLOCK_LABELS)))
    order = ["ordinal", F.desc("n"), "label"]
    placed = labels.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    return stage(placed.select("*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("id"))), blocks


def _all_pairs(labels: DataFrame) -> DataFrame:
    """Pairs of labels, all of them and in their order, with the place of their column (`ordinal`).

    There are far more of them than labels: no pair is shuffled.  Each task has a block of labels that come first in pairs,
    meets the short ones of later places in turn, a few thousand at a time, and merges its pairs with the few found by marks.
    A block holds its pairs as numbers until it sorts them, and the labels that are in one."""
    short = F.length("label") <= SHORT_LABEL
    found, blocks = _blocks(labels)
    lengths = found.where(short).groupBy("column").agg(F.collect_set(F.length("label")).alias("lengths"))
    near = near_candidates(found, {r["column"]: set(r["lengths"]) for r in lengths.collect()})
    own = found.select("column", "label", "n", "ordinal", "id", "block")
    for k in ("p", "q"):
        side = own.withColumnsRenamed({"label": k, "n": f"n_{k}", "id": f"id_{k}", "block": f"block_{k}"})
        near = near.join((side if k == "p" else side.drop("ordinal")).hint("merge"), ["column", k])
    first = F.col("id_p") < F.col("id_q")
    one, other = (lambda x: F.when(first, F.col(f"{x}p")).otherwise(F.col(f"{x}q"))), (lambda x: F.when(first, F.col(f"{x}q")).otherwise(F.col(f"{x}p")))
    of = lambda block, kind: [block.cast("int").alias("block"), F.lit(kind).alias("kind")]
    none = F.lit(None)
    rows = (
        found.select(*of(F.col("block"), 0), "ordinal", "column", "id", "label", "n", none.cast("long").alias("first"), none.cast("int").alias("edits"))
        .union(near.select(*of(one("block_"), 1), "ordinal", none.cast("string"), other("id_"), other(""), other("n_"), one("id_"), "edits"))
        .union(
            found.where(short).select(F.explode(F.sequence(F.lit(0), "block")).alias("to"), "*")
            .select(*of(F.col("to"), 2), "ordinal", none.cast("string"), "id", "label", "n", none.cast("long"), none.cast("int"))
        )
    )
    # Ranges of blocks keep the order from one task to the next.
    dealt = rows.repartitionByRange(blocks, "block").sortWithinPartitions("block", "kind", "id")
    return dealt.mapInArrow(label_arrays.listed, PAIR_SCHEMA)


def near_pairs(labels: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs of labels of one column, five characters or longer, at most two edits apart, the more
    frequent label first; all of them unless a display `limit` is asked for.  Counting them takes no pairs
    (`label_links`)."""
    pairs = _all_pairs(labels.select("ordinal", "column", "label", "n").where(F.length("label") >= MIN_LABEL))
    if limit:
        pairs = pairs.orderBy("ordinal", F.desc("rows_a"), "a", F.desc("rows_b"), "b").limit(limit)
    return pairs.select("column", "a", "b", "rows_a", "rows_b", "edits")


def near_duplicate_labels(
    df: DataFrame, columns: Sequence[str] | None = None, *, limit: int | None = None
) -> DataFrame:
    """Labels of a text column that are probably one value mistyped, in all text columns or the given ones."""
    names = [c for c in (columns if columns is not None else string_columns(df)) if c.lower() != SOURCE]
    return near_pairs(stage(label_counts(df, names)), limit)


def issue_counts(nulls: DataFrame, spikes: DataFrame, labels: DataFrame) -> DataFrame:
    """Per dataset the columns with gaps, severe and moderate spikes, and label pairs."""
    kinds = [
        nulls.select("dataset", F.lit("null").alias("kind")),
        spikes.select("dataset", F.when(F.col("distance_iqr") > SEVERE_IQR, "severe").otherwise("moderate").alias("kind")),
        labels.select("dataset", F.lit("label").alias("kind")),
    ]
    counted = [("null_columns", "null"), ("severe", "severe"), ("moderate", "moderate"), ("duplicate_labels", "label")]
    return reduce(DataFrame.unionByName, kinds).groupBy("dataset").agg(
        *[F.count_if(F.col("kind") == kind).alias(name) for name, kind in counted]
    )


def rate(counts: DataFrame) -> DataFrame:
    """Issues and reliability from the issue counts."""
    issues = (
        F.col("null_columns") + F.col("severe") + F.when(F.col("moderate") > 0, 1).otherwise(0)
        + F.col("duplicate_labels")
    )
    rating = (
        F.when((F.col("severe") > 0) | (F.col("duplicate_labels") > 0), "Low")
        .when(F.col("issues") == 0, "High")
        .when(F.col("issues") <= 2, "Medium")
        .otherwise("Low")
    )
    return counts.withColumn("issues", issues.cast("long")).withColumn("rating", rating)


def quality_rating(name: str, nulls: DataFrame, spikes: DataFrame, labels: DataFrame) -> DataFrame:
    """Issue counts and reliability of one dataset from its null report, spikes and label pairs."""
    tag = F.lit(name).alias("dataset")
    counts = issue_counts(*[t.select(tag, "*") for t in (nulls, spikes, labels)])
    one = local_table(counts.sparkSession, {"dataset": [name]}, "dataset string")
    return rate(one.join(counts, "dataset", "left").na.fill(0))
