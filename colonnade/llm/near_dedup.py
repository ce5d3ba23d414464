"""Near duplicates: MinHash signatures joined within a Hamming distance, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import column, portions, rolled, spread_join, word_hashes
from colonnade.llm.components import connected
from colonnade.session import stage

SHINGLE = 5
#: A signature has so many parts of 16 bits.  Pairs at most `distance_for` parts apart are candidates: of
#: pairs whose similarity is just the threshold, a share of MISSED at most differs in more.  At 0.85, 64 parts differ in 9.6 places
#: on average and in more than 20 once in 3,500 pairs; at 0.80 in 12.8, and in more than 25 once in 7,900.
PARTS, CHUNKS = 64, 16
MISSED = 3e-4
#: Groups are compared in blocks of so many documents and bytes of text.
BLOCK_ROWS, BLOCK_BYTES = 1_000, 16 << 20
#: Up to so many documents of candidate clusters are broadcast to pick their texts; more are joined.
BROADCAST_ROWS = 500_000

_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 63, PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, PARTS, dtype=np.uint64)


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of `n` words in a row; of all words where they are fewer."""
    return np.unique(rolled(words, min(n, len(words)))) if len(words) else words


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each of the hash functions."""
    least = np.full(PARTS, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 4096):
            block = found[at : at + 4096, None] * _FACTORS + _SHIFTS
            np.minimum(least, block.min(0), out=least)
        least ^= least >> np.uint64(33)
        least *= np.uint64(0xFF51AFD7ED558CCD)
    return (least >> np.uint64(48)).astype(np.uint16)


def distance_for(percent: int, missed: float = MISSED, parts: int = PARTS) -> int:
    """The least distance that a pair of this similarity exceeds with a probability of at most `missed`."""
    if not 0 < percent <= 100:
        raise ValueError(f"a similarity of {percent} percent")
    same, beyond = percent / 100, 1.0
    for distance in range(parts):
        beyond -= math.comb(parts, distance) * (1 - same) ** distance * same ** (parts - distance)
        if beyond <= missed:
            return distance
    return parts


def chunk_patterns(parts: int = PARTS, distance: int = distance_for(85), chunks: int = CHUNKS) -> list[tuple[int, ...]]:
    """The sets of parts that serve as keys.

    Cut into `chunks`, of which the first few may hold r = distance // chunks errors and the rest r - 1, such that a
    pair within the distance must keep to that in some chunk: otherwise its errors would add up to more.  For every
    way to leave out as many parts of a chunk as it may err in, the other parts are a key.
    """
    allowed = distance // chunks
    generous = distance - allowed * chunks + 1
    bounds = np.linspace(0, parts, chunks + 1).astype(int)
    patterns = []
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        errors = allowed if k < generous else allowed - 1
        if errors >= 0:
            patterns += list(itertools.combinations(range(a, b), b - a - errors))
    return patterns


def keys_of(signatures: np.ndarray, patterns: list[tuple[int, ...]]) -> np.ndarray:
    """One 64-bit key for each pattern, a column each."""
    out = np.empty((len(signatures), len(patterns)), np.uint64)
    wide = signatures.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for k, parts in enumerate(patterns):
            key = np.full(len(signatures), k + 1, np.uint64)
            for p in parts:
                key = (key ^ wide[:, p]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[:, k] = key
    return out.view(np.int64)


def _split(texts: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words, their hashes, and where each text's begin.  A-Z are lower-cased; only ASCII white space parts words."""
    split = [t.encode().lower().split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
    return split, word_hashes([w for s in split for w in s]), starts


def describe(docs: DataFrame, id_column: str, text_column: str, n: int) -> DataFrame:
    """`id`, `mark` (a hash of the text as it is), `bytes` (of it), `n_shingles`, `print` (128 bits of the words, null without any),
    `node` (its first 64), `signature`."""
    text = F.coalesce(column(text_column).cast("string"), F.lit(""))
    rows = docs.select(column(id_column).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    schema = (
        f"id {rows.schema['id'].dataType.simpleString()}, mark long, bytes long, n_shingles long, print binary, "
        "node long, signature binary"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in portions(whole):
                texts = part.column(2).to_pylist()
                split, hashes, starts = _split(texts)
                sizes, prints, signatures = [], [], []
                for k, words in enumerate(split):
                    found = shingles(hashes[starts[k] : starts[k + 1]], n)
                    sizes.append(len(found))
                    prints.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                    signatures.append(signature(found).tobytes() if words else None)
                nodes = [p and int.from_bytes(p[:8], "little", signed=True) for p in prints]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(t.encode()) for t in texts]), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                     pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary())],
                    ["id", "mark", "bytes", "n_shingles", "print", "node", "signature"],
                )

    return rows.mapInArrow(run, schema)


def _keys(classes: DataFrame, distance: int) -> DataFrame:
    """`node` and `key`, a row for each pattern."""
    patterns = chunk_patterns(distance=distance)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, PARTS)
                nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), len(patterns))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(keys_of(signatures, patterns).reshape(-1))], ["node", "key"])

    return classes.select("node", "signature").mapInArrow(run, "node long, key long")


def _in_blocks(rows: DataFrame, group: str, blocks) -> DataFrame:
    """Rows of a group that exceeds a block are dealt over blocks, and each pair of blocks becomes a group of its own:
    `left` and `right` are the blocks' numbers, `block` the row's."""
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    paired = dealt.withColumn("other", other)
    return paired.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("other")


def _by_group(rows: DataFrame, group: str, compute, schema: str) -> DataFrame:
    """Run `compute` (Arrow table of one group's rows -> list of record batches' rows) over groups as they stand
    together in sorted partitions; a task holds one group and one batch at a time."""
    keys = [group, "left", "right"]
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(names.index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            change[0] = last is not None and last != [v[0].item() for v in values]
            for v in values:
                change[1:] |= v[1:] != v[:-1]
            last = [v[-1].item() for v in values]
            waiting.append(batch)
            if change.any():  # what stands before the last change is whole
                cut = int(np.flatnonzero(change)[-1])
                ended = pa.Table.from_batches([*waiting[:-1], batch.slice(0, cut)])
                waiting = [batch.slice(cut)]
                yield from compute(ended)
        if waiting:
            yield from compute(pa.Table.from_batches(waiting))

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


class _Joined:
    """Labels of rows that are joined bit by bit."""

    def __init__(self, rows: int):
        self.label = np.arange(rows)

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x == y:
            return False
        self.label[self.label == max(x, y)] = min(x, y)
        return True


def _groups(table: pa.Table, group: str) -> np.ndarray:
    """Where each group of a sorted table starts, and the end."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in (group, "left", "right"):
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def _pairs_within(signatures: np.ndarray, labels, meet, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows, apart in `labels` when asked, that may `meet` and lie within the distance; by their lag."""
    rows = len(signatures)
    for lag in range(1, rows):
        a = np.arange(rows - lag)
        apart = a[(labels()[: rows - lag] != labels()[lag:]) & meet(a, a + lag)]
        if not len(apart):
            continue
        far = (signatures[apart] != signatures[apart + lag]).sum(1)
        near = far <= distance
        if near.any():
            yield apart[near], apart[near] + lag, far[near]


def _meeting(part: pa.Table):
    """Within a group of one block all rows meet; in one of two, those of different blocks (each block has a group of
    its own)."""
    block = part.column("block").to_numpy()
    if part.column("left")[0].as_py() == part.column("right")[0].as_py():
        return lambda a, b: np.ones(len(a), bool)
    return lambda a, b: block[a] != block[b]


def candidate_edges(classes: DataFrame, distance: int) -> DataFrame:
    """`u`, `v`: nodes whose signatures are within the distance and share a key; of each bucket as many as connect
    what is connected there."""
    keys = _keys(classes, distance)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = spread_join(keys, shared, ["key"], ["node"])
    rows = met.join(classes.select("node", "signature"), "node")
    blocked = _in_blocks(rows, "key", F.ceil(F.col("n") / BLOCK_ROWS)).select(
        "key", "left", "right", "block", "node", "signature"
    )

    def compute(table: pa.Table) -> Iterator[pa.RecordBatch]:
        signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, PARTS)
        nodes = table.column("node").to_numpy()
        bounds = _groups(table, "key")
        sizes = np.diff(bounds)
        u, v = [], []
        two = bounds[:-1][sizes == 2]
        if len(two):
            near = two[(signatures[two] != signatures[two + 1]).sum(1) <= distance]
            u += nodes[near].tolist()
            v += nodes[near + 1].tolist()
        for a, b in zip(bounds[:-1][sizes > 2].tolist(), bounds[1:][sizes > 2].tolist()):
            joined = _Joined(b - a)
            meet = _meeting(table.slice(a, b - a))
            for x, y, _ in _pairs_within(signatures[a:b], lambda: joined.label, meet, distance):
                for i, j in zip(x.tolist(), y.tolist()):
                    if joined.join(i, j):
                        u.append(int(nodes[a + i]))
                        v.append(int(nodes[a + j]))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return _by_group(blocked, "key", compute, "u long, v long").filter("u <> v").distinct()


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least `percent` of their union."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    both = int((b[place] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed_links(texts: DataFrame, percent: int, n: int) -> DataFrame:
    """`u`, `v`, `alone`: links between the texts of a cluster whose full sets are similar enough, as many as connect
    what is connected in its block or pair of blocks; `alone` where that is the whole cluster."""
    distance = distance_for(percent)

    def compute(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bounds = _groups(table, "cluster")
        signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, PARTS)
        nodes = table.column("node").to_numpy()
        u, v, alone = [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a < 2:
                continue
            part = table.slice(a, b - a)
            _, hashes, starts = _split(part.column("text").to_pylist())
            sets = [shingles(hashes[p:q], n) for p, q in zip(starts[:-1], starts[1:])]
            joined = _Joined(b - a)
            pairs = list(_pairs_within(signatures[a:b], lambda: joined.label, _meeting(part), distance))
            if not pairs:
                continue
            x, y, far = (np.concatenate(c) for c in zip(*pairs))
            whole = part.column("blocks")[0].as_py() == 1
            for k in np.argsort(far, kind="stable").tolist():
                i, j = int(x[k]), int(y[k])
                if joined.label[i] != joined.label[j] and _similar(sets[i], sets[j], percent):
                    joined.join(i, j)
                    u.append(int(nodes[a + i]))
                    v.append(int(nodes[a + j]))
                    alone.append(whole)
        yield pa.RecordBatch.from_arrays(
            [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(alone, pa.bool_())], ["u", "v", "alone"]
        )

    return _by_group(texts, "cluster", compute, "u long, v long, alone boolean")


def near_duplicates(
    docs: DataFrame, percent: int = 85, n: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """For every row the id, `n_shingles` (distinct runs of `n` words; the whole where a text has fewer),
    `component_id` (the least id among all texts connected by links), `kept` (the id is that one) and `mark` (a hash
    of the text as it is).

    Texts are linked where their sets share at least `percent` of their union.  Texts without words are linked with
    nothing, their component is their own id.  A null id is less than none: its component is the least other id, or
    null, and it is kept only there.  Rows equal in id and text are kept or not alike.  Other columns are not read.

    Texts with the same words are one class.  Classes whose signatures differ in at most `distance_for(percent)` parts
    meet in some bucket (see `chunk_patterns`); buckets and clusters beyond a block are compared block by block, and only links that
    connect something new are given out.  All links come from full sets.
    """
    told, classes, roots = _linked(docs, percent, n, id_column, text_column, broadcast_rows)
    return _resolved(told, classes, roots, id_column)


def _linked(
    docs: DataFrame, percent: int, n: int, id_column: str, text_column: str, broadcast_rows: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The described rows, their classes, and `node` and `root` of all classes linked to a lesser one."""
    told = stage(describe(docs, id_column, text_column, n))
    handle = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("handle")
    classes = stage(
        told.filter("print is not null").groupBy("print", "node", "signature")
        .agg(handle, F.max("bytes").alias("bytes"), F.count("*").alias("copies"))
    )
    clusters = connected(candidate_edges(classes, distance_for(percent)))
    members = clusters.select("node", F.col("root").alias("cluster")).union(
        clusters.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct()
    )
    members = stage(members.join(classes.select("node", "print", "signature", "handle", "bytes"), "node"))
    # One text for each class in a cluster.
    wanted = members.select("node", "cluster", "print", "signature", F.col("handle.id").alias("rid"), F.col("handle.mark").alias("rmark"))
    wanted = F.broadcast(wanted) if members.count() <= broadcast_rows else wanted
    text = F.coalesce(column(text_column).cast("string"), F.lit(""))
    full = docs.select(column(id_column).alias("id"), text.alias("text"))
    found = full.join(wanted, F.col("id").eqNullSafe(F.col("rid")) & (F.xxhash64("text") == F.col("rmark")))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    found = spread_join(found.select("node", "cluster", "print", "signature", "text"), sizes, ["cluster"], ["node"])
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES, F.lit(1)))
    texts = _in_blocks(found, "cluster", blocks).select(
        "cluster", "left", "right", "block", "blocks", "node", "signature", "text"
    )
    links = stage(confirmed_links(texts, percent, n))
    return told, classes, connected(links.select("u", "v"))


def _resolved(told: DataFrame, classes: DataFrame, roots: DataFrame, id_column: str) -> DataFrame:
    linked = classes.select("node", "print", "copies", F.col("handle.id").alias("least")).join(roots, "node", "left")
    # Roots have no row of their own.
    linked = linked.withColumn("root", F.coalesce("root", "node"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("rows"))
    named = linked.join(least.filter("rows > 1"), "root").select("print", "component_id")
    many = told.select("id", "mark", "n_shingles", "print")
    salts = 8
    each = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = many.withColumn("salt", F.pmod(F.xxhash64("id", "mark"), F.lit(salts)).cast("int"))
    joined = dealt.join(each.withColumn("grouped", F.lit(True)), ["print", "salt"], "left")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_column), "n_shingles", component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"), "mark",
    )


def drop_near_duplicates(
    docs: DataFrame, percent: int = 85, n: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text",
    broadcast_rows: int = BROADCAST_ROWS, one_row: bool = False,
) -> DataFrame:
    """`docs` without the documents that `near_duplicates` doesn't keep; rows and columns that stay are as they were.

    With `one_row`, a single row of each component stays whatever the ids: that with the least id (null last) and text
    hash, and any one of the rows equal in both.  Texts without words have no component and stay."""
    if one_row:
        return _one_row_each(docs, percent, n, id_column, text_column, broadcast_rows)
    judged = near_duplicates(docs, percent, n, id_column, text_column, broadcast_rows)
    gone = stage(judged.filter("not kept").select(column(id_column).alias("__id"), F.col("mark").alias("__mark")).distinct())
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    mark = F.xxhash64(F.coalesce(column(text_column).cast("string"), F.lit("")))
    return docs.join(gone, column(id_column).eqNullSafe(F.col("__id")) & (mark == F.col("__mark")), "left_anti")


def _one_row_each(
    docs: DataFrame, percent: int, n: int, id_column: str, text_column: str, broadcast_rows: int
) -> DataFrame:
    told, classes, roots = _linked(docs, percent, n, id_column, text_column, broadcast_rows)
    linked = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    chosen = linked.groupBy("root").agg(F.min("handle").alias("chosen"), F.sum("copies").alias("rows")).filter("rows > 1")
    named = linked.join(chosen, "root").select("print", "chosen")
    # Rows equal in id and text are counted first, so that what is joined holds each once.
    each = told.filter("print is not null").groupBy("id", "mark", "print").agg(F.count("*").alias("times"))
    judged = spread_join(each, named, ["print"], ["id", "mark"])
    stays = F.col("id").eqNullSafe(F.col("chosen.id")) & (F.col("mark") == F.col("chosen.mark"))
    judged = judged.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), stays.alias("__stays"), "times")
    # What goes whole, and what stays in one row of several.
    judged = stage(judged.filter("not __stays or times > 1").drop("times"))
    few = {r["__stays"]: r["count"] for r in judged.groupBy("__stays").count().collect()}
    judged = F.broadcast(judged) if sum(few.values()) <= broadcast_rows else judged
    mark = F.xxhash64(F.coalesce(column(text_column).cast("string"), F.lit("")))
    same = column(id_column).eqNullSafe(F.col("__id")) & (mark == F.col("__mark"))
    if not few.get(True):
        return docs.join(judged, same, "left_anti")
    rows = docs.join(judged, same, "left")
    alone = rows.filter("__stays is null").select(*(column(c) for c in docs.columns))
    # Copies collapse within each task before they are shuffled.
    first = rows.filter("__stays").groupBy("__id", "__mark").agg(F.first(F.struct(*(column(c) for c in docs.columns))).alias("row"))
    return alone.union(first.select(*(F.col("row")[c].alias(c) for c in docs.columns)))
