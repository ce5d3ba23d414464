"""Byte strings that occur more than once in a corpus, found by sorting the suffixes at shared anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import column, portions, spread_join
from colonnade.llm.suffix_sort import common, sorted_with_shared
from colonnade.session import stage

LENGTH = 200
#: Bytes of an anchor: longer ones repeat less often by chance, shorter ones stand farther apart.
GRAM = 32
#: The contexts of anchors with more occurrences are cut into parts before they are sorted, so that no group is larger.
HOT = 20_000
#: Up to so many repeated anchors are broadcast; more are joined.
BROADCAST_ANCHORS = 4_000_000

_SEGMENT = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_FACTOR = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_FACTOR, n, 1 << 64))


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` bytes (a power of two), by joining ever longer neighbours."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        done = 1
        while done < size:
            h = h[:-done] * _power(done) + h[done:]
            done *= 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def anchors(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of `length` bytes: their hashes, their places, and the first and last start of the
    strings each stands for.

    A string's anchor is its leftmost gram of the least hash, so equal strings have equal anchors at the same place
    within, wherever they stand."""
    size = min(GRAM, 1 << (length.bit_length() - 1))
    found = [[], [], [], []]
    data = np.frombuffer(text, np.uint8)
    for base in range(0, len(data) - length + 1, _SEGMENT):
        part = data[base : base + _SEGMENT + length - 1]
        h = _grams(part, size)
        packed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        least = _least(packed, length - size + 1)
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        last = np.append(first[1:], len(least)) - 1
        place = (least[first] & _PLACE).astype(np.int64)
        for values, new in zip(found, (h[place].view(np.int64), place + base, first + base, last + base)):
            values.append(new)
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in found)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """`id`, `low` and `high` (128 bits of hash of the text) and `text`."""
    text = F.coalesce(column(text_column).cast("string"), F.lit(""))
    return docs.select(
        column(id_column).alias("id"), F.xxhash64(text).alias("low"), F.xxhash64(F.lit(1), text).alias("high"), text.alias("text")
    )


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """Each different text of a batch once: its row, low, high and number of copies."""
    seen: dict[tuple[int, int], list[int]] = {}
    low, high = (batch.column(k).to_pylist() for k in (0, 1))
    for row, key in enumerate(zip(low, high)):
        seen.setdefault(key, []).append(row)
    for key, rows in seen.items():
        yield rows[0], *key, len(rows)


_PLACES = "anchor long, times int, low long, high long, place int, first int, last int"


def _all_anchors(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole):
                values = batch.column(2)
                out = [[] for _ in range(7)]
                for row, low, high, copies in _counted(batch):
                    raw = values[row].as_py().encode()
                    if len(raw) < length:
                        continue
                    found, place, first, last = anchors(raw, length)
                    for o, v in zip(out, (found, copies, low, high, place, first, last)):
                        o.append(v if isinstance(v, np.ndarray) else np.full(len(found), v))
                if out[0]:
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(o), k, safe=False) for o, k in zip(out, kinds)],
                        ["anchor", "times", "low", "high", "place", "first", "last"],
                    )

    return texts.select("low", "high", "text").mapInArrow(run, _PLACES)


Occurrence = tuple[int, int, int, int, int, int, bytes]  # anchor, low, high, copies, place, before, context
Reader = Callable[[Iterable[pa.RecordBatch], "bool | None"], Iterator[list[Occurrence]]]


def _occurrences(
    texts: DataFrame, repeated: DataFrame, length: int, hot: int, broadcast_anchors: int
) -> tuple[DataFrame, Reader]:
    """A frame, and a function from its batches to the occurrences of repeated anchors: all, those of anchors met over
    `hot` times, or the others.  An occurrence's context is the bytes of all strings it stands for."""
    if repeated.count() <= broadcast_anchors:
        known = repeated.select("anchor", (F.col("n") > hot).alias("hot")).toArrow().sort_by("anchor")
        index = texts.sparkSession.sparkContext.broadcast(
            (known.column("anchor").to_numpy(), known.column("hot").to_numpy())
        )

        def look_up(batches: Iterable[pa.RecordBatch], which: bool | None) -> Iterator[list[Occurrence]]:
            wanted, is_hot = index.value
            for whole in batches:
                for batch in portions(whole, 1 << 21):
                    values, rows = batch.column(2), []
                    for row, low, high, copies in _counted(batch):
                        raw = values[row].as_py().encode()
                        if len(raw) < length or not len(wanted):
                            continue
                        found, place, first, last = anchors(raw, length)
                        at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                        taken = wanted[at] == found
                        if which is not None:
                            taken &= is_hot[at] == which
                        for k in np.flatnonzero(taken).tolist():
                            p, a, b = int(place[k]), int(first[k]), int(last[k])
                            rows.append((int(found[k]), low, high, copies, p, p - a, raw[a : b + length]))
                    yield rows

        return texts.select("low", "high", "text"), look_up

    places = spread_join(
        _all_anchors(texts, length), repeated, ["anchor"], ["low", "high", "place"]
    ).groupBy("low", "high").agg(
        F.collect_set(F.struct("anchor", (F.col("n") > hot).alias("hot"), "place", "first", "last")).alias("places"),
    )
    copies = texts.groupBy("low", "high").agg(F.count("*").cast("int").alias("copies"), F.first("text").alias("text"))
    joined = stage(copies.join(places, ["low", "high"]).select("low", "high", "copies", "text", "places"))

    def cut(batches: Iterable[pa.RecordBatch], which: bool | None) -> Iterator[list[Occurrence]]:
        for whole in batches:
            for batch in portions(whole, 1 << 20):
                rows = []
                for low, high, times, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                    raw = text.encode()
                    rows += [
                        (f["anchor"], low, high, times, f["place"], f["place"] - f["first"], raw[f["first"] : f["last"] + length])
                        for f in found
                        if which is None or f["hot"] == which
                    ]
                yield rows

    return joined, cut


def _id(before: int, context: bytes) -> bytes:
    """128 bits that stand for a context and the place of the anchor in it."""
    return hashlib.blake2b(before.to_bytes(4, "little") + context, digest_size=16).digest()


class _Seen:
    """What a task has passed on lately, so that it passes nothing on a third time: whoever gathers the rows asks only
    whether a context was met once or more often.  Forgets all beyond a bound, which costs rows and changes no result."""

    def __init__(self, most: int = 1 << 17):
        self.times: dict = {}
        self.most = most

    def before(self, key, times: int) -> int:
        """How often `key` was seen until now."""
        known = self.times.get(key, 0)
        if len(self.times) >= self.most and not known:
            self.times.clear()
        if known < 2:
            self.times[key] = known + times
        return known


_NODES = "group long, id binary, before int, times int, context binary"
_KINDS = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def _nodes(rows: Iterable[tuple], seen: _Seen) -> pa.RecordBatch | None:
    """Those (group, id, before, times, context) that tell something new; the bytes only at first sight."""
    kept = []
    for group, key, before, times, context in rows:
        known = seen.before(key, times)
        if known < 2:
            kept.append((group, key, before, times, None if known else context))
    return _batch(kept, _KINDS, ["group", "id", "before", "times", "context"]) if kept else None


def _contexts(source: DataFrame, read: Reader, which: bool) -> DataFrame:
    """The different contexts of hot or of other anchors, combined within each task: a row with the bytes, and perhaps
    more with the same id that only count."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for rows in read(batches, which):
            out = _nodes(((anchor, _id(before, c), before, copies, c) for anchor, _, _, copies, _, before, c in rows), seen)
            if out:
                yield out

    return source.mapInArrow(run, _NODES)


def _places(source: DataFrame, read: Reader) -> DataFrame:
    """`id` of the context, `low`, `high` and `place` of every occurrence; a task names each text once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        for rows in read(batches, None):
            out = [
                (_id(before, context), low, high, place)
                for _, low, high, _, place, before, context in rows
                if not seen.before((low, high, place), 1)
            ]
            if out:
                yield _batch(out, kinds, ["id", "low", "high", "place"])

    return source.mapInArrow(run, "id binary, low long, high long, place int")


def resolve(contexts: list[bytes], before: list[int], length: int) -> list[tuple[int, int] | None]:
    """For different contexts of one anchor, each with `before` bytes ahead of the anchor: how far to the left and
    right of it strings reach that occur in another one too.

    Two contexts that share l bytes to the left and r to the right share every string within, if l + r >= length.
    The suffixes at the anchor are sorted, and so are the reversed beginnings; neighbours' shared lengths give r and l
    of all pairs, as the least between two places."""
    n = len(contexts)
    right = [c[b:] for c, b in zip(contexts, before)]
    left = [c[:b][::-1] for c, b in zip(contexts, before)]
    right_order, right_shared = sorted_with_shared(right)
    left_order, left_shared = sorted_with_shared(left)
    reach_left, reach_right = np.full(n, -1), np.full(n, -1)
    if n <= 48:
        r, l = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
        for order, shared, out in ((right_order, right_shared, r), (left_order, left_shared, l)):
            order, shared = np.array(order), np.array(shared)
            for k in range(n - 1):
                least = np.minimum.accumulate(shared[k:])
                out[order[k], order[k + 1 :]] = least
                out[order[k + 1 :], order[k]] = least
        valid = (l + r >= length) & ~np.eye(n, dtype=bool)
        reach_left = np.where(valid, l, -1).max(1)
        reach_right = np.where(valid, r, -1).max(1)
    else:
        place_r, place_l = np.argsort(right_order), np.argsort(left_order)
        right_shared, left_shared = np.array(right_shared), np.array(left_shared)
        for offset in range(min(length, max(before)) + 1):
            same_r = np.append(0, np.cumsum(right_shared < length - offset))[place_r]
            same_l = np.append(0, np.cumsum(left_shared < offset))[place_l]
            _, inverse, counts = np.unique(same_r * n + same_l, return_inverse=True, return_counts=True)
            again = counts[inverse] > 1
            reach_left[again] = offset
            reach_right[again] = np.maximum(reach_right[again], length - offset)
    return [(int(a), int(b)) if a >= 0 else None for a, b in zip(reach_left, reach_right)]


_REACH = "id binary, left int, right int"


def _reach_of_groups(contexts: DataFrame, length: int) -> DataFrame:
    """How far repeated strings reach to the left and right of the anchor in each context, group by group in sorted
    partitions.  A group holds its different contexts only; one met twice is repeated as a whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: list[tuple] = []
        group = None
        held: list[list] = []  # [id, before, times, context]

        def close():
            whole = [times > 1 for _, _, times, _ in held]
            for again, (key, before, _, context) in zip(whole, held):
                if again:
                    reached.append((key, before, len(context) - before))
            if len(held) > 1 and not all(whole):
                if len(held) == 2:
                    (a, b), (x, y) = ([h[k] for h in held] for k in (3, 1))
                    right, left = common(a[x:], b[y:]), common(a[:x][::-1], b[:y][::-1])
                    reach = [(left, right)] * 2 if left + right >= length else [None] * 2
                else:
                    reach = resolve([h[3] for h in held], [h[1] for h in held], length)
                for again, entry, found in zip(whole, held, reach):
                    if found and not again:
                        reached.append((entry[0], *found))
            held.clear()

        def written():
            out = _batch(reached, [pa.binary(), pa.int32(), pa.int32()], ["id", "left", "right"])
            reached.clear()
            return out

        for batch in batches:
            for at, key, before, times, context in zip(*(c.to_pylist() for c in batch.columns)):
                if at != group:
                    close()
                    group = at
                if held and held[-1][0] == key:
                    held[-1][2] += times
                    held[-1][3] = held[-1][3] if context is None else context
                else:
                    held.append([key, before, times, context])
            if reached:
                yield written()
        close()
        if reached:
            yield written()

    columns = ["group", "id", "before", "times", "context"]
    dealt = contexts.select(*columns).repartition("group").sortWithinPartitions("group", "id")
    return dealt.mapInArrow(run, _REACH)


def parts(before: int, context: bytes, length: int, width: int) -> Iterator[tuple[int, int, bytes]]:
    """A context cut by how many bytes its strings have ahead of the anchor, `width` such numbers at a time: a hash of
    the bytes that all strings of the part share with any equal one, and the part's own `before` and context."""
    lowest = length - (len(context) - before)
    for start in range(max(lowest, 0) // width * width, before + 1, width):
        low, high = max(start, lowest), min(start + width - 1, before)
        end = min(start + width - 1, length - 1)
        shared = hashlib.blake2b(
            start.to_bytes(4, "little") + context[before - start : before + length - end], digest_size=8
        ).digest()
        yield int.from_bytes(shared, "little", signed=True), high, context[before - high : before + length - low]


#: How many places of the anchor within a string are taken together when groups are split, step by step.
WIDTHS = (24, 3, 1)


def _merged(nodes: DataFrame) -> DataFrame:
    """One row for each context, with its bytes and its count."""
    return nodes.groupBy("group", "id").agg(
        F.first("before").alias("before"), F.sum("times").alias("times"), F.first("context", ignorenulls=True).alias("context")
    ).select("group", "id", "before", F.least("times", F.lit(2)).cast("int").alias("times"), "context")


def _reach_of_large(nodes: DataFrame, length: int, hot: int, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """The same for contexts whose groups are too large to be held.

    Each context is cut into parts (see `parts`), which meet in groups of their own: equal strings lie in equal parts'
    groups, and what differs outside a part no longer tells contexts apart.  Groups still too large are cut finer; at
    a width of 1 a part is one string, and equal strings are one row.  A context reaches as far as any of its parts."""
    width, finer = widths[0], widths[1:]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            found = (
                (group, _id(b, part), b, times, part)
                for before, times, context in rows
                for group, b, part in parts(before, context, length, width)
            )
            out = _nodes(found, seen)
            if out:
                yield out

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            out = [(key, _id(b, part)) for key, before, context in rows for _, b, part in parts(before, context, length, width)]
            if out:
                yield _batch(out, [pa.binary(), pa.binary()], ["whole", "id"])

    cuts = stage(_merged(nodes.select("before", "times", "context").mapInArrow(cut, _NODES)))
    if finer:
        large = stage(cuts.groupBy("group").count().filter(F.col("count") > hot).select("group", F.lit(True).alias("large")))
        if large.limit(1).count():
            each = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
            dealt = cuts.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(8)).cast("int"))
            cuts = stage(dealt.join(each, ["group", "salt"], "left").drop("salt"))
            reach = _reach_of_groups(cuts.filter("large IS NULL"), length).unionByName(
                _reach_of_large(cuts.filter("large"), length, hot, finer)
            )
        else:
            reach = _reach_of_groups(cuts, length)
    else:
        reach = cuts.filter("times > 1").select("id", F.col("before").alias("left"), (F.lit(length) - F.col("before")).alias("right"))
    links = nodes.filter("times = 1").select("id", "before", "context").mapInArrow(link, "whole binary, id binary")
    reached = spread_join(links, reach, ["id"], ["whole"]).groupBy(F.col("whole").alias("id")).agg(
        F.max("left").alias("left"), F.max("right").alias("right")
    )
    twice = nodes.filter("times > 1").select(
        "id", F.col("before").alias("left"), (F.octet_length("context") - F.col("before")).alias("right")
    )
    return reached.unionByName(twice)


def find_repeats(
    docs: DataFrame, length: int = LENGTH, hot: int = HOT, broadcast_anchors: int = BROADCAST_ANCHORS,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """For every row the id, `n_bytes` (UTF-8), `spans` (start and end of the maximal runs of bytes that a string of
    `length` bytes covers which starts anywhere else too) and `kept` (the other bytes).

    Strings lie within one text; the other place may be in the same text, overlapping too, or in an equal row.  Null and
    empty texts, and those of fewer than `length` bytes, have no spans.  Equal texts get equal results; null ids give a
    row each; other columns are not read.

    Anchors (see `anchors`) that occur once are dropped; around the others, the suffixes of each anchor's different
    contexts are sorted (see `resolve`), after those of anchors with over `hot` occurrences were cut into parts (see
    `_reach_of_large`).  `length` is at least 2.
    """
    texts = _texts(docs, id_column, text_column)
    counted = _all_anchors(texts, length).groupBy("anchor").agg(F.sum("times").alias("n"))
    repeated = stage(counted.filter("n > 1"))
    source, read = _occurrences(texts, repeated, length, hot, broadcast_anchors)
    reach = _reach_of_groups(_contexts(source, read, False), length)
    if repeated.filter(F.col("n") > hot).limit(1).count():
        large = stage(_merged(_contexts(source, read, True)))
        reach = reach.unionByName(_reach_of_large(large, length, hot))
    spans = spread_join(_places(source, read), reach, ["id"], ["low", "high", "place"], salts=4).select(
        "low", "high", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("end")
    )
    found = spans.groupBy("low", "high").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    salts = 8
    each = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = texts.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    joined = dealt.join(each, ["low", "high", "salt"], "left").select("id", "text", "spans")
    id_type = joined.schema["id"].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for batch in portions(whole):
                sizes, merged, kept = [], [], []
                for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    raw = text.encode()
                    runs: list[dict] = []
                    rest, at = [], 0
                    for part in sorted(parts or [], key=lambda s: s["start"]):
                        if runs and part["start"] <= runs[-1]["end"]:
                            runs[-1]["end"] = max(runs[-1]["end"], part["end"])
                        else:
                            runs.append(dict(part))
                    for part in runs:
                        rest.append(raw[at : part["start"]])
                        at = part["end"]
                    rest.append(raw[at:])
                    sizes.append(len(raw))
                    merged.append(runs)
                    kept.append(b"".join(rest))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary())],
                    [id_column, "n_bytes", "spans", "kept"],
                )

    return joined.mapInArrow(cut, f"`{id_column}` {id_type}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
