"""Records of delimited text files read in parallel splits, with line breaks inside quotes.

Spark's text source cuts files into splits at line ends.  Whether a split begins inside a quoted value depends on all that
stands before it in its file, but a split is a map of two states onto two, and maps are chained without the text:

1. every split says where it ends if it begins outside or inside quotes, and what of it would belong to the records
   that cross its bounds (one row a split);
2. the maps of a file are chained in order, which settles every split's true state, and the crossing records are put
   together from their pieces;
3. every split cuts its own records; those that cross bounds are added.

Where no record crosses a line end, which step 1 also tells, the records are the lines and Spark's own reader is used.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colonnade.session import stage

#: Tasks are told all splits and which begin inside quotes, eight bytes each; beyond this many, splits are too small.
MOST_SPLITS = 4_000_000
_OPENS = re.compile(r'(?:\A|,)"')
_CLOSED = re.compile(r'"[^"]*+(?:""[^"]*+)*+"')

#: Text of a record that crosses the bounds of a split is kept by the first pass up to so many characters; longer pieces
#: are fetched by a pass of their own where they turn out to be needed.
HOLD = 1 << 20

_MAP = (
    "file long, start long, from_outside boolean, from_inside boolean, crossed boolean, begun boolean, "
    "outside_lost boolean, inside_lost boolean, head string, outside_tail string, inside_tail string"
)
_PIECES = "file long, start long, part int, text string"


def ends_inside(line: str) -> bool:
    """Whether a line that begins outside quotes leaves a quoted value open.  A quote opens one only where a field
    begins; two in a row inside one stand for one."""
    at = 0
    while opened := _OPENS.search(line, at):
        closed = _CLOSED.match(line, opened.end() - 1)
        if not closed:
            return True
        at = closed.end()
    return False


class Cutter:
    """Cuts the consecutive lines of a split into records, from a given state.

    `head` is what belongs to the record that was open at the start, `tail` begins the one that is open at the end; each
    is None where there is none, and `lost` where it is longer than `hold`."""

    def __init__(self, inside: bool, hold: int | None = None):
        self.inside, self.owed, self.hold = inside, inside, hold
        self.crossed = self.lost = False
        self.head: str | None = None
        self.pieces: list[str] = []
        self.size = 0

    def _take(self, lines: list[str]) -> None:
        self.size += sum(map(len, lines)) + len(lines)
        if self.hold is None or self.size <= self.hold:
            self.pieces += lines
        else:
            self.pieces = []

    def _taken(self) -> str | None:
        gone = self.hold is not None and self.size > self.hold
        text = None if gone else "\n".join(self.pieces)
        self.pieces, self.size = [], 0
        return text

    def feed(self, lines: list[str], quotes: bool = True) -> list[str]:
        """The records that end in these lines, but for the one that was open at the start.  Without `quotes` the
        lines are known to hold none."""
        if not quotes:
            if self.inside:
                self._take(lines)
            return [] if self.inside else lines
        out = []
        for line in lines:
            if not self.inside:
                if '"' in line and ends_inside(line):
                    self.inside = self.crossed = True
                    self._take([line])
                else:
                    out.append(line)
                continue
            self._take([line])
            if '"' in line and not ends_inside('"' + line):
                self.inside = False
                record = self._taken()
                if self.owed:
                    self.owed, self.head, self.lost = False, record, self.lost or record is None
                else:
                    out.append(record)
        return out

    def close(self) -> str | None:
        """The tail, after the last line; a split that is one piece of a value has it as its head."""
        if not self.inside:
            return None
        text = self._taken()
        self.lost = self.lost or text is None
        if self.owed:
            self.head = text
            return None
        return text


class _Summary:
    """What one split says of itself under both assumptions."""

    def __init__(self, file: int, start: int):
        self.key, self.begun = (file, start), False
        self.outside, self.inside = Cutter(False, HOLD), Cutter(True, HOLD)

    def feed(self, array: pa.Array) -> None:
        quotes = bool(pc.any(pc.match_substring(array, '"')).as_py())
        if not quotes and self.begun and not self.outside.inside and not self.inside.inside:
            return
        lines = array.to_pylist()
        found = self.outside.feed(lines, quotes)
        self.begun = self.begun or any(r is None or r.strip() for r in found)
        self.inside.feed(lines, quotes)

    def row(self) -> pa.RecordBatch:
        tails = self.outside.close(), self.inside.close()
        values = (*self.key, self.outside.inside, self.inside.inside, self.outside.crossed, self.begun, self.outside.lost,
                  self.inside.lost, self.inside.head, *tails)
        types = [pa.int64()] * 2 + [pa.bool_()] * 6 + [pa.string()] * 3
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [f.split()[0] for f in _MAP.split(", ")])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array]]:
    """Lines of a batch by split, in order."""
    if not batch.num_rows:
        return
    file, start = (batch.column(k).to_numpy() for k in (1, 2))
    new = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *new], [*new, batch.num_rows]):
        yield int(file[a]), int(start[a]), batch.column(0).slice(a, b - a)


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    summary = None
    for batch in batches:
        for file, start, lines in _runs(batch):
            if not summary or summary.key != (file, start):
                if summary:
                    yield summary.row()
                summary = _Summary(file, start)
            summary.feed(lines)
    if summary:
        yield summary.row()


def _place(file: int, start: int) -> int:
    """One number for a split, the same in every task."""
    return (file * 0x9E3779B97F4A7C15 + start * 0xBF58476D1CE4E5B9 + (file >> 17)) & 0x7FFFFFFFFFFFFFFF


class Splits:
    """The splits of the files of a path, and the records that cross their bounds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.lines = _lines(spark, path)
        found = stage(self.lines.mapInArrow(_summaries, _MAP))
        size = found.agg(F.count("*").alias("n"), F.bool_or("crossed").alias("crossed")).first()
        #: How many splits there are, and whether every line is a record.
        self.count, self.plain = size["n"], not size["crossed"]
        if self.count > MOST_SPLITS:
            raise ValueError(f"{self.count} splits: raise spark.sql.files.maxPartitionBytes")
        self.starts = self.places = np.zeros(0, np.int64)
        if not self.plain:
            self.places = _places(found)
            self._chain(found)

    def _chain(self, found: DataFrame) -> None:
        """The true state of every split: that of the last one before it whose end does not depend on its beginning,
        turned over by as many as swap the two since."""
        order = Window.partitionBy("file").orderBy("start")
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        fixed, swaps = F.col("from_outside") == F.col("from_inside"), (F.col("from_outside") & ~F.col("from_inside")).cast("long")
        found = found.withColumn("swaps", F.sum(swaps).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        last = lambda c: F.last(F.when(fixed, c), ignorenulls=True).over(earlier)
        since = F.coalesce(F.lag("swaps").over(order), F.lit(0)) - F.coalesce(last(F.col("swaps")), F.lit(0))
        inside = F.coalesce(last(F.col("from_outside")), F.lit(False)) != (since % 2 == 1)
        known = stage(found.withColumn("inside", inside))
        self.starts = _places(known.filter("inside"))
        lost = F.when(F.col("inside"), F.col("inside_lost")).otherwise(F.col("outside_lost"))
        held = known.filter(~lost)
        heads = held.filter("inside").select("file", "start", F.lit(0).alias("part"), F.col("head").alias("text"))
        tail = F.when(F.col("inside"), F.col("inside_tail")).otherwise(F.col("outside_tail"))
        pieces = heads.union(held.select("file", "start", F.lit(1).alias("part"), tail.alias("text"))).filter("text IS NOT NULL")
        if known.filter(lost).limit(1).count():
            pieces = pieces.union(self._fetched(known.filter(lost)))
        # A record begins with the tail of one split and takes every piece up to the next tail.
        begins = F.sum("part").over(Window.partitionBy("file").orderBy("start", "part"))
        each = pieces.withColumn("record", begins).groupBy("file", "record").agg(
            F.sort_array(F.collect_list(F.struct("start", "part", "text"))).alias("pieces"), F.min("start").alias("start")
        )
        joined = each.select("file", "start", F.array_join(F.transform("pieces", lambda p: p["text"]), "\n").alias("text"))
        headers = known.filter("start = 0 AND NOT begun").select("file", "start")
        self.crossing = stage(joined.join(headers, ["file", "start"], "left_anti").select(F.col("text").alias("record")))

    def _fetched(self, wanted: DataFrame) -> DataFrame:
        """The long pieces of some splits, whose state is known by now."""
        shared = self.spark.sparkContext.broadcast((_places(wanted), self.starts))

        def run(batches):
            key, cutter = None, None

            def done():
                tail = cutter.close()
                rows = [(*key, part, text) for part, text in ((0, cutter.head), (1, tail)) if text is not None]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
                return pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["file", "start", "part", "text"]
                )

            for batch in batches:
                for file, start, lines in _runs(batch):
                    if key != (file, start):
                        if cutter:
                            yield done()
                        asked, inside = (_has(places, file, start) for places in shared.value)
                        key, cutter = (file, start), Cutter(inside) if asked else None
                    if cutter:
                        cutter.feed(lines.to_pylist())
            if cutter:
                yield done()

        return self.lines.mapInArrow(run, _PIECES)

    def records(self) -> DataFrame:
        """All records but the files' headers, as one text each; blank ones are left out."""
        shared = self.spark.sparkContext.broadcast((self.places, self.starts))

        def run(batches):
            key, cutter, header = None, None, False
            for batch in batches:
                for file, start, lines in _runs(batch):
                    if key != (file, start):
                        known, inside = (_has(places, file, start) for places in shared.value)
                        if not known:
                            raise RuntimeError("files are split otherwise than when they were opened: load them again")
                        key, cutter, header = (file, start), Cutter(inside), start == 0
                    quotes = bool(pc.any(pc.match_substring(lines, '"')).as_py())
                    if not quotes and not cutter.inside and not header:
                        yield pa.RecordBatch.from_arrays([lines], ["record"])
                        continue
                    out = cutter.feed(lines.to_pylist(), quotes)
                    if header:
                        named = next((k for k, r in enumerate(out) if r.strip()), len(out))
                        header, out = named == len(out), out[named + 1 :]
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["record"])

        found = self.lines.mapInArrow(run, "record string").union(self.crossing)
        # A line end may be a carriage return and a line feed; the last one of a record is part of that.
        bare = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
        return found.select(bare.alias("record")).filter(F.trim("record") != "")


def _places(splits: DataFrame) -> np.ndarray:
    table = splits.select("file", "start").toArrow()
    return np.sort(np.array([_place(*p) for p in zip(table.column(0).to_pylist(), table.column(1).to_pylist())], np.int64))


def _has(places: np.ndarray, file: int, start: int) -> bool:
    at = int(np.searchsorted(places, _place(file, start)))
    return at < len(places) and int(places[at]) == _place(file, start)
