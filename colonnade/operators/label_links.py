"""How many labels each label is close to, and the groups they form, without listing pairs.

Names with numbers make pairs by the square: a hundred million of them have thousands of close ones each.  Here the cost
of a label depends on its length alone.  Strip from two labels at most two edits apart their common start and end: the
edits left stand at both ends of what remains, in one of a few ways.  For each place and way the labels that fit are all
that agree with this one where nothing was edited, which is one count; those where an edit changes nothing are taken off
again, by other counts.  So every label enters a table of counts whole, without each one and without each two characters,
and its number of links is a sum of entries of that table, with signs.

That is how labels of different lengths are counted.  Those of one length take far fewer rows, in arrays (`label_arrays`).
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colonnade.functions.columns import SOURCE, string_columns
from colonnade.functions.components import connected
from colonnade.operators import label_arrays, quality
from colonnade.session import empty_table, stage

#: Labels up to this length are counted; pairs with a longer one are found one by one, as there are few.
COUNTED = quality.SHORT_LABEL


def _cut(a: str, i: int) -> str:
    return a[:i] + a[i + 1 :]


def _alike(a: str) -> bool:
    return a == a[0] * len(a)


def _whole(a: str) -> str:
    return "0|" + a


def _one(i: int, rest: str) -> str:
    """Entry of a label that is `rest` without its i-th character."""
    return f"1,{i}|{rest}"


def _two(i: int, j: int, rest: str) -> str:
    return f"2,{i},{j}|{rest}"


def entries(a: str) -> Iterator[str]:
    """What a label counts for: the whole of it, it without each character, and without each two."""
    yield _whole(a)
    for i in range(len(a)):
        rest = _cut(a, i)
        yield _one(i, rest)
        for j in range(i, len(rest)):
            yield _two(i, j + 1, _cut(rest, j))


def links(a: str, lengths: Collection[int] | None = None) -> tuple[dict[str, int], int]:
    """The entries whose counts, with these signs, and a constant add up to the number of labels one or two edits away.
    Every entry counts labels of one length; with `lengths`, those of the column, entries of other lengths are left out."""
    out: dict[str, int] = {}

    def add(sign: int, key: str) -> None:
        out[key] = out.get(key, 0) + sign

    n = len(a)
    two_less, one_less, same, one_more, two_more = (lengths is None or n + k in lengths for k in range(-2, 3))
    less = [_cut(a, i) for i in range(n)]
    twice = [a[: i + 1] + a[i:] for i in range(n)]
    here = [_one(i, a) for i in range(n + 1)]
    constant = n * (n - 1) // 2 - n
    for i in range(n):
        # One character replaced, each also taken off by the pairs of places below; one left out; one inserted.
        if same:
            add(1 - (n - 1), _one(i, less[i]))
        if one_less and (i == 0 or a[i] != a[i - 1]):
            add(1, _whole(less[i]))
        if one_more:
            add(1, here[i])
            add(-1, _whole(twice[i]))
    if one_more:
        add(1, here[n])
    gone = set()
    for i in range(n if same or two_less else 0):
        for j in range(i + 1, n):
            rest = less[i][: j - 1] + a[j + 1 :]
            if two_less:
                gone.add(rest)
            if not same:
                continue
            # Two replaced.
            add(1, _two(i, j, rest))
            if j < i + 2:
                continue
            # Left out here and inserted there: what lies between moves to the left, or to the right.
            left = a[i + 1] != a[i] and not _alike(a[i + 1 : j + 1])
            right = a[j - 1] != a[j] and not _alike(a[i:j])
            if left:
                add(1, _one(j, less[i]))
                add(-1, _whole(less[i][:j] + a[j] + less[i][j:]))
            if right:
                add(1, _one(i, less[j]))
                add(-1, _whole(less[j][:i] + a[i] + less[j][i:]))
            if left and right and a[i + 2 : j + 1] == a[i : j - 1]:
                add(-1, _whole(a[:i] + a[i + 1 : j + 1] + a[j - 1] + a[j + 1 :]))
    for rest in gone:
        # Two left out.
        add(1, _whole(rest))
    for i in range(n if one_more else 0):
        for j in range(i, n):
            # One inserted and one replaced, in either order.
            add(1, _two(i, j + 1, less[j]))
            add(-1, _one(j + 1, a[: i + 1] + a[i:j] + a[j + 1 :]))
            add(-1, here[i])
            add(1, _whole(twice[i]))
            if i < j and not _alike(a[i : j + 1]):
                add(1, _two(i, j + 1, less[i]))
                add(-1, here[j + 1])
                add(-1, _one(i, a[:i] + a[i + 1 : j + 1] + a[j:]))
                add(1, _whole(twice[j]))
    for i in range(n - 1 if one_less else 0):
        # One left out and one replaced, in either order: side by side, or apart.
        add(1, _one(i, a[:i] + a[i + 2 :]))
        add(-1, _whole(less[i]))
        if a[i] != a[i + 1]:
            add(-1, _whole(less[i + 1]))
        for j in range(i + 1, n - 1):
            rest = less[i][:j] + a[j + 2 :]
            first, last = a[i] != a[i + 1], a[j] != a[j + 1]
            if first:
                add(1, _one(j, rest))
                add(-1, _whole(less[i]))
            if last:
                add(1, _one(i, rest))
                add(-1, _whole(less[j + 1]))
            if first and last and _alike(a[i + 1 : j + 1]):
                add(-1, _whole(a[:i] + a[i + 1] * (j - i + 1) + a[j + 2 :]))
    for i in range(n + 1 if two_more else 0):
        # Two inserted.
        add(1, _two(i, i + 1, a))
        if i < n:
            add(-1, _one(i + 1, twice[i]))
        for j in range(i + 1, n + 1):
            add(1, _two(i, j + 1, a))
            add(-1, _one(j + 1, twice[i]))
            add(-1, _one(i, twice[j - 1]))
            add(1, _whole(a[: i + 1] + a[i:j] + a[j - 1 :]))
    return out, constant


def ties(a: str, lengths: Collection[int] | None = None) -> Iterator[tuple[bool, str]]:
    """Sets of labels in which all are at most two edits apart, and whether this one is of the kind it takes one of:
    left without a character, replaced in two places, left without one and replaced in another, left without two.
    With `lengths`, those of the column, sets are left out that would join labels of lengths it doesn't have."""
    n = len(a)
    two_less, one_less, one_more, two_more = (lengths is None or n + k in lengths for k in (-2, -1, 1, 2))
    if one_more:
        yield True, "d|" + a
    if two_more:
        yield True, "e|" + a
    for i in range(n):
        rest = _cut(a, i)
        yield True, "d|" + rest
        if one_more:
            yield True, f"x,{i}|{rest}"
        if one_less and (i == 0 or a[i] != a[i - 1]):
            for k in range(n - 1):
                yield False, f"x,{k}|{_cut(rest, k)}"
        for j in range(i, n - 1):
            both = _cut(rest, j)
            yield True, f"w,{i},{j}|{both}"
            if two_less:
                yield False, "e|" + both


def _keyed(labels: DataFrame, of: Callable[[str, Collection[int]], Iterator[tuple]], extra: str = "") -> DataFrame:
    """Rows (`id`, `column`, `one`, `two` and one more column) made from every label and the lengths there are in its
    column; `one` and `two` are a 128-bit hash of the key, so that keys don't travel as texts."""
    kinds = [n.split() for n in ("key string", extra) if n]
    arrow = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                columns: list[list] = [[], [], *[[] for _ in kinds]]
                for i, c, a, lengths in zip(*(part.column(k).to_pylist() for k in range(4))):
                    rows = list(zip(*of(a, lengths)))
                    if not rows:
                        continue
                    columns[0] += [i] * len(rows[0])
                    columns[1] += [c] * len(rows[0])
                    for out, more in zip(columns[2:], rows):
                        out += more
                types = [pa.int64(), pa.string(), *[arrow[kind] for _, kind in kinds]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], ["id", "column", *[n for n, _ in kinds]])

    rows = labels.select("id", "column", "label", "lengths").mapInArrow(run, ", ".join(["id long", "column string", *map(" ".join, kinds)]))
    return rows.select(
        "id", "column", F.xxhash64("key").alias("one"), F.xxhash64(F.lit(1), "key").alias("two"), *[n for n, _ in kinds[1:]]
    )


def _parts(spark: SparkSession) -> int:
    """Labels are few megabytes where they make gigabytes of keys: they are dealt over all cores."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _beside(labels: DataFrame) -> DataFrame:
    """Labels that others of their column come near in length without having it; the lengths there are go with them."""
    near = F.arrays_overlap("lengths", F.array(*[F.length("label") + k for k in (-2, -1, 1, 2)]))
    return quality.with_lengths(labels).where(near).repartition(_parts(labels.sparkSession), "column", "label")


def _entered(a: str, _: Collection[int]) -> Iterator[tuple]:
    return ((key,) for key in entries(a))


def _asked(a: str, lengths: Collection[int]) -> Iterator[tuple]:
    """Entries for the labels of other lengths; those of its own are counted in arrays."""
    found, _ = links(a, [n for n in lengths if n != len(a)])
    return (row for row in found.items() if row[1])


def _tied(a: str, lengths: Collection[int]) -> Iterator[tuple]:
    """Sets that may join the label with one of another length."""
    # A label that is of both kinds in one set counts as the one it takes one of.
    kinds: dict[str, bool] = {}
    for base, key in ties(a, lengths):
        if key.startswith("w") or key.startswith("d") and key != "d|" + a and len(a) - 1 not in lengths:
            continue
        kinds[key] = kinds.get(key, False) or base
    return iter(kinds.items())


def _segments(labels: DataFrame) -> dict[tuple[int, int], dict[int, int]]:
    """By ordinal and length of the labels the places at which they differ, each with a segment: four that tell labels apart
    about as well as each other.  One row comes back for a column, length and place."""
    counts = labels.mapInArrow(label_arrays.letter_counts, "ordinal int, length int, place int, letter long, count long")
    place = ["ordinal", "length", "place"]
    counts = counts.groupBy(*place, "letter").agg(F.sum("count").alias("count"))
    alike = F.sum(F.col("count").cast("double") * F.col("count")) / F.pow(F.sum("count"), 2)
    weights: dict[tuple[int, int], dict[int, float]] = {}
    for r in counts.groupBy(*place).agg((-F.log2(alike)).alias("weight"), F.count("*").alias("letters")).where("letters > 1").collect():
        weights.setdefault((r["ordinal"], r["length"]), {})[r["place"]] = r["weight"]
    return {k: label_arrays.segments(w) for k, w in weights.items()}


def _of_one_length(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For short labels (`id`, `ordinal`, `label`) the number of close ones of the same length (`id`, `links`), and what ties
    them (`id`, `least`).

    Labels that differ in one place, or by a character that goes and one that comes, have a rest in common: a row for every
    place that differs in their column.  Labels that differ in two places agree in two of four segments at least: a row for
    each two segments, whose buckets are compared in arrays where they are found.  So a label makes a few rows more than it has
    such places, and no key for two places, unless a bucket is too large for a task: then its rows do.  What the rests tie is
    known before, and of buckets only ties between different roots are kept."""
    kinds = _segments(labels.select("ordinal", "label"))
    labels = labels.repartition(_parts(labels.sparkSession), "id")
    counted = "id long, links long, other long"
    rests = labels.mapInArrow(label_arrays.rests_of(kinds), "one long, two long, id long")
    met = stage(rests.repartition("one").sortWithinPartitions("one", "two").mapInArrow(label_arrays.rest_counts, counted))
    roots = connected(met.where("other < id").select(F.col("id").alias("u"), F.col("other").alias("v")))
    rooted = labels.join(roots.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    buckets = rooted.mapInArrow(label_arrays.buckets_of(kinds), "mark long, route int, ordinal int, id long, root long, label string")
    buckets = buckets.repartition("route", "mark").sortWithinPartitions("route", "mark")
    found = stage(buckets.mapInArrow(label_arrays.bucket_counts(kinds), f"{counted}, one long, two long, letters long"))
    large = found.where("one IS NOT NULL").repartition("one").sortWithinPartitions("one", "two")
    differ = found.where("one IS NULL").select("id", "links", "other").union(stage(large.mapInArrow(label_arrays.place_counts, counted)))
    links = met.select("id", "links").union(differ.where("links IS NOT NULL").select("id", "links"))
    ties = roots.union(differ.where("links IS NULL").select("id", "other")).toDF("id", "least")
    return stage(links.groupBy("id").agg(F.sum("links").alias("links")).where("links > 0")), stage(ties)


def _long_pairs(labels: DataFrame) -> DataFrame:
    """Pairs of labels, as ids, of which one at least is longer than the counted ones."""
    long = labels.where(F.length("label") > COUNTED - quality.MAX_EDITS)
    pairs = quality.near_candidates(long)
    ids = long.select("column", "label", "id")
    met = pairs.join(ids.withColumnsRenamed({"label": "p", "id": "u"}).hint("merge"), ["column", "p"])
    return met.join(ids.withColumnsRenamed({"label": "q", "id": "v"}).hint("merge"), ["column", "q"]).select("u", "v")


@dataclass
class Linked:
    """Labels that are close to another one of their column, by number (`id`), and what ties them.

    `labels`: those labels.  `ties`: labels with another one of their group, which all are connected by; `pairs`: those with a
    long label; `counts`: the number of close labels of the same length."""

    labels: DataFrame
    ties: DataFrame
    pairs: DataFrame
    counts: DataFrame | None = None


def linked(labels: DataFrame) -> Linked:
    """Find the labels of `label_counts` that have links: those close to one of the same length are counted; of different
    lengths, a set of labels within two edits of each other has two members, and one of the kind it asks for.  The work for a
    label depends on its length alone."""
    labels = labels.where(F.length("label") >= quality.MIN_LABEL)
    labels = stage(labels.withColumn("id", F.monotonically_increasing_id()))
    short = labels.where(F.length("label") <= COUNTED)
    counts, ties = _of_one_length(short.select("id", "ordinal", "label"))
    member = _keyed(_beside(short), _tied, "base boolean")
    together = Window.partitionBy("column", "one", "two")
    sets = member.select(
        "id", F.min("id").over(together).alias("least"), F.count("*").over(together).alias("members"),
        F.bool_or("base").over(together).alias("based"),
    )
    across = stage(sets.where("based AND members > 1").select("id", "least").distinct())
    if labels.where(F.length("label") > COUNTED).limit(1).count():
        pairs = stage(_long_pairs(labels))
    else:
        pairs = empty_table(labels.sparkSession, "u long, v long")
    ids = counts.select("id").union(across.select("id")).union(pairs.select("u")).union(pairs.select("v")).distinct()
    return Linked(stage(labels.join(ids.hint("merge"), "id", "left_semi")), ties.union(across), pairs, counts)


def link_counts(found: Linked) -> DataFrame:
    """(id, ordinal, column, label, n, links) of every linked label: the number of labels of its column, five characters
    or longer, one or two edits away.  No pair of labels up to 32 characters is formed."""
    short = _beside(found.labels.where(F.length("label") <= COUNTED))
    key = ["column", "one", "two"]
    # Small files of labels make tables of a thousand times their size: these must not be broadcast.
    table = _keyed(short, _entered).groupBy(*key).agg(F.count("*").alias("count")).hint("merge")
    across = _keyed(short, _asked, "sign int").join(table, key).groupBy("id").agg(F.sum(F.col("sign") * F.col("count")).alias("links"))
    either = found.pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    links = found.counts.union(across).union(either).groupBy("id").agg(F.sum("links").alias("links"))
    return found.labels.join(links.hint("merge"), "id").select("id", "ordinal", "column", "label", "n", "links")


def groups(found: Linked) -> DataFrame:
    """(id, first, size): the least label that each linked one is connected with by close ones, and how many these are."""
    stars = found.ties.where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    roots = connected(stars.union(found.pairs)).withColumnRenamed("node", "id")
    named = found.labels.join(roots.hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    each = named.groupBy("root").agg(F.min("label").alias("first"), F.count("*").alias("size"))
    return named.join(each.hint("merge"), "root").select("id", "first", "size")


def first_pairs(found: Linked, limit: int) -> DataFrame:
    """The first pairs in the order of `near_pairs`: the first 2 * limit linked labels take part in `limit` pairs at
    least, and come first in those or after another of them; only these few meet the other linked labels."""
    order = ["ordinal", F.desc("n"), "label"]
    few = found.labels.orderBy(*order).limit(2 * limit).select("column", "ordinal", F.col("label").alias("a"), F.col("n").alias("rows_a"))
    other = found.labels.select(F.col("column").alias("of"), F.col("label").alias("b"), F.col("n").alias("rows_b"))
    later = (F.col("rows_a") > F.col("rows_b")) | ((F.col("rows_a") == F.col("rows_b")) & (F.col("a") < F.col("b")))
    close = F.abs(F.length("a") - F.length("b")) <= quality.MAX_EDITS
    met = other.join(F.broadcast(few), (F.col("column") == F.col("of")) & later & close)
    met = met.withColumn("edits", F.levenshtein("a", "b", quality.MAX_EDITS)).where(F.col("edits") > 0)
    shown = met.orderBy("ordinal", F.desc("rows_a"), "a", F.desc("rows_b"), "b").limit(limit)
    return shown.select("column", "a", "b", "rows_a", "rows_b", "edits")


def near_duplicate_link_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Labels of all text columns, or the given ones, that are probably one value mistyped: (column, label, n, links,
    first, size), the rows, the number of close labels, and the least label and size of the group they form."""
    names = [c for c in (columns if columns is not None else string_columns(df)) if c.lower() != SOURCE]
    found = linked(quality.label_counts(df, names))
    return link_counts(found).join(groups(found).hint("merge"), "id").drop("id", "ordinal")
