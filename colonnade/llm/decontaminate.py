"""Passages of benchmark items within training texts."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import column, covered, id_and_text, portions, rolled, small_batches, word_hashes

WINDOW = 10
#: Benchmarks up to this many bytes of text are broadcast; larger ones are joined by window.
BROADCAST_BYTES = 64 << 20

#: The bytes that part words, and the lower case of the others.
_BREAKS = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
_SPACED = bytes.maketrans(_BREAKS, b" " * len(_BREAKS))


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of digits, letters a-z and everything beyond ASCII."""
    return text.encode().lower().translate(_SPACED).split()


class ItemWindows:
    """All windows of the items: `n` words each, or the whole item where it has fewer."""

    def __init__(self, items: Iterable[tuple[str, str]], n: int):
        self.ids: dict[bytes, int] = {}
        self.n = n
        windows: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            size = min(n, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                windows[size][tuple(words[at : at + size])].add(item)
        self.windows = {size: dict(found) for size, found in windows.items()}
        # One 64-bit hash each, to find places worth a look.
        self.hashes = {
            size: np.unique(np.array([int(rolled(self._spread(w), size)[0]) for w in found], np.uint64))
            for size, found in self.windows.items()
        }

    @staticmethod
    def _spread(ids) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = np.asarray(ids, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mixed ^ (mixed >> np.uint64(32))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence, and the items that occur."""
        known = self.ids.get
        ids = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
        hit = np.zeros(len(words), bool)
        items: set[str] = set()
        for size, hashes in self.hashes.items():
            if len(words) < size:
                continue
            # A window can only occur where all its words are known.
            gaps = np.concatenate([[0], np.cumsum(ids == 0)])
            starts = np.flatnonzero(gaps[size:] == gaps[:-size])
            if not len(starts):
                continue
            spread = self._spread(ids)
            rolling = rolled(spread, size)[starts]
            place = np.minimum(np.searchsorted(hashes, rolling), len(hashes) - 1)
            sure = []
            for at in starts[hashes[place] == rolling].tolist():
                found = self.windows[size].get(tuple(ids[at : at + size].tolist()))
                if found:
                    sure.append(at)
                    items |= found
            if sure:
                hit |= covered(np.array(sure), size, len(words))
        return hit, items


def _items(benchmark: DataFrame, item_column: str, text_column: str) -> DataFrame:
    return benchmark.select(
        F.coalesce(column(item_column).cast("string"), F.lit("")).alias("item"),
        F.coalesce(column(text_column).cast("string"), F.lit("")).alias("text"),
    )


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """For every row of `docs` the id, `n_words`, `n_hit` (words inside an occurrence of an item's window),
    `n_items` and `items` (ids as strings, sorted) with such windows, `items_sha256` (of the ids, comma-joined)
    and `contaminated` (a word is hit).

    A window is `n` consecutive words of an item, or a shorter item whole.  Null and empty texts have no words,
    so such items never occur and such documents are clean; a null item id counts as an empty one.  Equal rows and
    null document ids give a row each; repeated items count once.  Other columns are not read.

    The windows travel as a broadcast while the benchmark's texts hold at most `broadcast_bytes`, as measured
    here; a larger benchmark is joined by window (see `joined`), with the same result.
    """
    items = _items(benchmark, item_column, item_text_column).distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    if size > broadcast_bytes:
        return joined(docs, items, n, id_column, text_column)
    found = items.toArrow().to_pylist()
    index = docs.sparkSession.sparkContext.broadcast(ItemWindows([(r["item"], r["text"]) for r in found], n))
    return _scanned(id_and_text(docs, id_column, text_column), index, id_column)


def _scanned(rows: DataFrame, index, id_column: str) -> DataFrame:
    schema = (
        f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, "
        "items array<string>, items_sha256 string, contaminated boolean"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = index.value
        for batch in batches:
            for part in portions(batch):
                n_words, n_hit, items = [], [], []
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    hit, found = windows.scan(words)
                    n_words.append(len(words))
                    n_hit.append(int(hit.sum()))
                    items.append(sorted(found))
                yield pa.RecordBatch.from_pydict(
                    {
                        id_column: part.column(0), "n_words": n_words, "n_hit": n_hit,
                        "n_items": [len(i) for i in items], "items": pa.array(items, pa.list_(pa.string())),
                        "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items],
                        "contaminated": [h > 0 for h in n_hit],
                    }
                )

    return rows.mapInArrow(run, schema)


def _word_array(text: str = "text"):
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def _windows(rows: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """A row per window of each size: its first place, its size and 128 bits of hash of its words."""
    word = F.col("words")

    def each(size: int):
        def window(at):
            words = F.slice(word, at, size)
            return F.struct(
                at.alias("at"), F.lit(size).alias("size"), F.xxhash64(words).alias("low"),
                F.xxhash64(F.lit(1), words).alias("high"),
            )

        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(word) - size + 1, F.lit(1))), window)

    found = rows.select(*keep, F.size(word).alias("n"), F.explode(F.concat(*map(each, sizes))).alias("w"))
    return found.filter("w.size <= n").select(*keep, "w.*")


def _met(rows: DataFrame, items: DataFrame, n: int) -> DataFrame | None:
    """`print`, `at`, `size` and `items`: where the items' windows stand in the different texts of `rows`, which holds
    `print` and `text`; None where no item has a word."""
    texts = rows.select("print", "text").distinct().select("print", _word_array().alias("words"))
    words = items.select("item", _word_array().alias("words")).filter(F.size("words") > 0)
    sizes = [r["size"] for r in words.select(F.least(F.size("words"), F.lit(n)).alias("size")).distinct().collect()]
    if not sizes:
        return None
    parts = [_windows(words.filter(F.least(F.size("words"), F.lit(n)) == size), [size], "item") for size in sizes]
    wanted = parts[0]
    for part in parts[1:]:
        wanted = wanted.union(part)
    wanted = wanted.groupBy("size", "low", "high").agg(F.collect_set("item").alias("items"))
    return _windows(texts, sizes, "print").join(wanted, ["size", "low", "high"]).select("print", "at", "size", "items")


def joined(docs: DataFrame, items: DataFrame, n: int, id_column: str, text_column: str) -> DataFrame:
    """The same result for a benchmark too large to broadcast: windows of items and documents meet in a join.

    Equal documents (id and text) are scanned once and share their result."""
    rows = id_and_text(docs, id_column, text_column).withColumn("print", F.sha2(F.col("text"), 256))
    met = _met(rows, items, n)
    if met is not None:
        place = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1))
        hits = met.select("print", place.alias("at")).groupBy("print").agg(F.count_distinct("at").alias("n_hit"))
        named = met.select("print", F.explode("items").alias("item")).groupBy("print").agg(
            F.sort_array(F.collect_set("item")).alias("items")
        )
        found = hits.join(named, "print")
    else:
        found = rows.limit(0).select("print", F.lit(0).cast("long").alias("n_hit"), _word_array().alias("items"))
    none = F.array().cast("array<string>")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", none)
    return rows.withColumn("n_words", F.size(_word_array()).cast("long")).join(found, "print", "left").select(
        F.col("id").alias(id_column), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        listed.alias("items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, most: float = 0.5, id_column: str = "doc_id",
    text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """`docs` without benchmark passages: of a text the hit words go, with what stands between and after them
    up to the next word; a document goes where more than `most` of its words are hit.

    All columns and rows without a hit stay as they are, null texts and repeated rows too.  A benchmark over
    `broadcast_bytes` is joined by window, with the same result (see `_removed_by_join`).
    """
    items = _items(benchmark, item_column, item_text_column).distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    if size > broadcast_bytes:
        return _removed_by_join(docs, items, n, most, text_column)
    rows = items.toArrow().to_pylist()
    index = docs.sparkSession.sparkContext.broadcast(ItemWindows([(r["item"], r["text"]) for r in rows], n))
    place = docs.columns.index(text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = index.value
        for batch in batches:
            for part in portions(batch):
                texts, keep = [], []
                for text in part.column(place).to_pylist():
                    cut = text and without_hits(text, windows, most)
                    texts.append(text if cut is None else cut)
                    keep.append(cut is not None or not text)
                column_of = pa.array(texts, part.schema.field(place).type)
                yield part.set_column(place, part.schema.field(place), column_of).filter(pa.array(keep))

    return small_batches(docs).mapInArrow(run, docs.schema)


def _removed_by_join(docs: DataFrame, items: DataFrame, n: int, most: float, text_column: str) -> DataFrame:
    """What `remove_contaminated` gives, where windows met in a join: each text gets the windows it holds and is cut."""
    text = F.coalesce(column(text_column).cast("string"), F.lit(""))
    met = _met(docs.select(F.sha2(text, 256).alias("print"), text.alias("text")), items, n)
    if met is None:
        return docs
    hits = met.groupBy(F.col("print").alias("__print")).agg(F.collect_set(F.struct("at", "size")).alias("__hits"))
    told = docs.withColumn("__print", F.sha2(text, 256)).join(hits, "__print", "left").select(
        *(column(c) for c in docs.columns), "__hits"
    )
    place = docs.columns.index(text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                texts, keep = [], []
                found = part.column(part.num_columns - 1)
                for k, text in enumerate(part.column(place).to_pylist()):
                    cut = text
                    if text and found[k].is_valid:
                        words = words_of(text)
                        at, size = (found[k].values.field(c).to_numpy() for c in ("at", "size"))
                        hit = np.zeros(len(words), bool)
                        for each in np.unique(size):
                            hit |= covered(at[size == each] - 1, int(each), len(words))
                        cut = without_words(text, hit, most)
                    texts.append(text if cut is None else cut)
                    keep.append(cut is not None or not text)
                rest = pa.RecordBatch.from_arrays(part.columns[:-1], schema=pa.schema(list(part.schema)[:-1]))
                cuts = pa.array(texts, part.schema.field(place).type)
                yield rest.set_column(place, part.schema.field(place), cuts).filter(pa.array(keep))

    return small_batches(told).mapInArrow(run, docs.schema)


def without_hits(text: str, windows: ItemWindows, most: float) -> str | None:
    """The text without its hit words; None where too many are."""
    return without_words(text, windows.scan(words_of(text))[0], most)


def without_words(text: str, hit: np.ndarray, most: float) -> str | None:
    """The text without the words that are `hit`; None where they are more than `most` of all."""
    if not hit.any():
        return text
    if hit.sum() > most * len(hit):
        return None
    raw = text.encode()
    is_word = np.frombuffer(raw.lower().translate(_SPACED), np.uint8) != 0x20
    starts = np.flatnonzero(is_word & np.concatenate([[True], ~is_word[:-1]]))
    ends = np.concatenate([starts[1:], [len(raw)]])
    out, at = [], 0
    for k in np.flatnonzero(hit).tolist():
        out.append(raw[at : starts[k]])
        at = int(ends[k])
    out.append(raw[at:])
    return b"".join(out).decode()
