"""Runs of lines that occurred before, found by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import column, spread_join

#: So many lines in a row make a run, and so does a single line of this many characters.
RUN_LINES = 3
LONG_LINE = 200

_BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def _line_arrays(text: Column) -> Column:
    """Of every line with something in it: its place among all lines, its hash and whether it is long."""
    described = F.transform(
        _lines(text),
        lambda line, at: F.struct(
            at.alias("line"), F.xxhash64(_trimmed(line)).alias("hash"), F.char_length(_trimmed(line)).alias("chars")
        ),
    )
    return F.filter(described, lambda x: x["chars"] > 0)


def _selected(hashes: Column, size: int) -> Column:
    """The places (from 1) that are the rightmost least hash of some window of `size` neighbours.

    Equal windows select the same place, so a run of `size` equal lines always shares a selected one."""

    def least(start: Column) -> Column:
        window = F.transform(F.slice(hashes, start, size), lambda h, k: F.struct(h.alias("h"), (-k).alias("k")))
        return start - F.array_min(window)["k"]

    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - size + 1, F.lit(1)))
    none = F.array().cast("array<int>")
    return F.when(F.size(hashes) >= size, F.array_distinct(F.transform(starts, least))).otherwise(none)


def repeated_runs(rows: DataFrame, size: int, long_line: int) -> DataFrame:
    """`id`, `print` and `gone`: the places, among all lines of a text, of lines in a run that occurred before.

    `rows` holds `id`, `print` (a hash of the text) and `text`.
    """
    described = rows.filter("text is not null").select("id", "print", _line_arrays(F.col("text")).alias("lines"))
    described = described.select("id", "print", "lines", F.col("lines.hash").alias("hashes"))
    far = size - 1
    # Fingerprints: what winnowing selects, and all long lines; each with its neighbours on both sides.
    long = F.filter(
        F.transform(F.col("lines"), lambda x, k: F.when(x["chars"] >= long_line, k + 1).otherwise(F.lit(0))), lambda k: k > 0
    )
    chosen = F.array_union(_selected(F.col("hashes"), size), long)

    def fingerprint(at: Column) -> Column:
        first = F.greatest(at - far, F.lit(1))
        return F.struct(
            at.alias("at"), F.get("hashes", at - 1).alias("hash"), F.slice("hashes", first, at + far - first + 1).alias("near"),
            first.alias("first"), (F.get("lines.chars", at - 1) >= long_line).alias("long"),
        )

    found = described.select("id", "print", F.explode(F.transform(chosen, fingerprint)).alias("f")).select("id", "print", "f.*")
    # Positions meet by fingerprint; only those met twice go on.
    met = found.groupBy("hash").agg(F.count("*").alias("times")).filter("times > 1").select("hash")
    shared = spread_join(found, met, ["hash"], ["id", "print", "at"])

    # From there runs extend both ways: every window of `size` lines through the fingerprint, and a long line itself.
    def window(start: Column) -> Column:
        lines = F.slice(F.col("near"), start, size)
        return F.struct(
            (F.col("first") + start - 1).alias("start"), F.lit(size).alias("lines"), F.xxhash64(lines).alias("low"),
            F.xxhash64(F.lit(1), lines).alias("high"),
        )

    room = F.size("near") - size + 1
    windows = F.when(room >= 1, F.transform(F.sequence(F.lit(1), F.greatest(room, F.lit(1))), window))
    alone = F.struct(
        F.col("at").alias("start"), F.lit(1).alias("lines"), F.col("hash").alias("low"), F.lit(0).cast("long").alias("high")
    )
    alone = F.when(F.col("long"), F.array(alone))
    none = F.array().cast("array<struct<start:int,lines:int,low:bigint,high:bigint>>")
    runs = shared.select(
        "id", "print", F.explode(F.concat(F.coalesce(windows, none), F.coalesce(alone, none))).alias("r")
    ).select("id", "print", "r.*")
    # The first place of each run stays; ids come in order, null last.
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "print", "start")
    run = ["lines", "low", "high"]
    first = runs.groupBy(*run).agg(F.min(place).alias("least"), F.max(place).alias("most")).filter("least <> most")
    later = spread_join(runs, first.select(*run, "least"), run, ["id", "print", "start"]).filter(place != F.col("least"))
    gone = later.groupBy("id", "print").agg(F.collect_set(F.struct("start", "lines")).alias("runs"))
    places = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["lines"] - 1)))
    return gone.select("id", "print", F.array_distinct(places).alias("gone"))


def dedup_lines(
    docs: DataFrame, size: int = RUN_LINES, long_line: int = LONG_LINE, id_column: str = "doc_id",
    text_column: str = "text", drop_emptied: bool = False, count_columns: tuple[str, str] | None = None,
) -> DataFrame:
    """`docs` without the lines of runs that occurred before, in documents with smaller ids or further up.

    A run is `size` consecutive lines, or one line of `long_line` characters, each compared without white space
    around it; empty lines don't count and stay.  Every line of a run goes wherever the whole run stood earlier, by
    (id, text hash, place); null ids come last.  Rows equal in id and text are one document and share its result.
    Null and empty texts, and all other columns, stay as they are.  With `drop_emptied`, documents that lose every
    line they had go; with `count_columns`, two columns of these names tell how many lines a text had and lost.
    """
    text = column(text_column).cast("string")
    rows = docs.select(column(id_column).alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))
    gone = repeated_runs(rows, size, long_line).select(
        F.col("id").alias("__id"), F.col("print").alias("__print"), F.col("gone").alias("__gone")
    )
    joined = docs.join(gone, column(id_column).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__print")), "left")
    lines = _lines(text)
    full = F.transform(_line_arrays(text), lambda x: x["line"])
    removed = F.transform(F.col("__gone"), lambda k: F.get(F.col("__full"), k - 1))
    joined = joined.withColumn("__full", F.when(F.col("__gone").isNotNull(), full))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    rest = F.array_join(F.transform(left, lambda k: F.get(F.col("__lines"), k)), "\n")
    joined = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), lines))
    if drop_emptied:
        joined = joined.filter(F.col("__gone").isNull() | (F.size("__gone") < F.size("__full")))
    if count_columns:
        joined = joined.withColumns({
            count_columns[0]: F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(lines)).cast("long"),
            count_columns[1]: F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
        })
    return joined.withColumn(text_column, F.when(F.col("__gone").isNotNull(), rest).otherwise(column(text_column))).drop(
        "__id", "__print", "__gone", "__full", "__lines"
    )
