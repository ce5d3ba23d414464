"""Ranked lexical search of many items at once: a dual-tree search over items and documents, exact."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from colonnade.llm.common import column, portions
from colonnade.session import empty_table, stage

#: Documents given for each item.
TOP = 10
#: Items are searched in blocks of at most so many terms in all (one item at least): what is broadcast stays bounded.
BLOCK_TERMS = 200_000
#: Documents of a leaf, children of a node, and documents of one hierarchy; terms it has a table for.
LEAF, FAN, BATCH, WIDTH = 16, 8, 2048, 2048
#: Documents (about) that give the first bounds.
SEEDS = 20_000

#: Letters and digits of ASCII in lower case, and every other byte beyond ASCII, belong to terms.
_TERM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERM).split()


@dataclass
class Node:
    """Some items of the hierarchy: the terms any of them holds (the places where the maximum over them is 1)."""

    terms: np.ndarray
    items: list[int]
    children: list[Node]


def item_tree(items: list[np.ndarray], fan: int = FAN) -> Node:
    """Items in the order of their terms, `fan` neighbours at a time, up to one root."""
    order = sorted(range(len(items)), key=lambda k: items[k].tolist())
    level = [Node(items[k], [k], []) for k in order]
    while len(level) > 1:
        level = [_merged(level[at : at + fan]) for at in range(0, len(level), fan)]
    return level[0]


def _merged(nodes: list[Node]) -> Node:
    return Node(np.unique(np.concatenate([n.terms for n in nodes])), [k for n in nodes for k in n.items], nodes)


@dataclass
class Documents:
    """One hierarchy of documents: exact worth of each term to each, in `order`, and maxima of the worth above them.

    `levels[0]` holds the maxima of leaves of LEAF documents, each further level those of FAN nodes below it."""

    order: np.ndarray
    exact: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, worth: np.ndarray) -> Documents:
        """Documents alike in what they hold are neighbours: sorted by their dearest term, then by their total worth."""
        order = np.lexsort((-worth.sum(1), worth.argmax(1), worth.max(1, initial=0) == 0)) if worth.size else np.arange(len(worth))
        exact = worth[order]
        levels, below, width = [], exact, LEAF
        while not levels or len(below) > 1:
            below = np.maximum.reduceat(below, np.arange(0, len(below), width), axis=0)
            levels.append(below)
            width = FAN
        return cls(order, exact, levels)


class Best:
    """The `top` highest (score, lowest document first) of each item so far, and a score that already suffices."""

    def __init__(self, items: int, top: int, floor: np.ndarray):
        self.top, self.floor = top, floor.astype(np.int64).copy()
        self.found: list[list[tuple]] = [[] for _ in range(items)]

    def offer(self, item: int, scores: np.ndarray, keys: list[tuple]) -> None:
        limit = max(self.floor[item], 1)
        rows = [(-int(scores[k]), keys[k]) for k in np.flatnonzero(scores >= limit)]
        if rows:
            kept = sorted(self.found[item] + rows)[: self.top]
            self.found[item] = kept
            if len(kept) == self.top:
                self.floor[item] = max(limit, -kept[-1][0])


def search(root: Node, docs: Documents, best: Best, keys: list[tuple], met: dict[str, int] | None = None) -> None:
    """All pairs of an item node and document nodes whose bound reaches the weakest k-th score of the node's items are
    opened; the others hold no document that could enter.  A bound is the sum, over the node's terms, of the largest
    worth in the document node; equal scores are opened, since a lower id may still win."""
    counts = met if met is not None else {}
    _open(root, np.arange(len(docs.levels[-1])), len(docs.levels) - 1, docs, best, keys, counts)


def _open(node: Node, nodes: np.ndarray, level: int, docs: Documents, best: Best, keys: list[tuple], met: dict) -> None:
    maxima = docs.levels[level]
    bound = maxima[nodes[:, None], node.terms].sum(1)
    weakest = max(1, min(best.floor[k] for k in node.items))
    met["bounds"] = met.get("bounds", 0) + len(nodes)
    keep = bound >= weakest
    if not keep.any():
        return
    nodes = nodes[keep][np.argsort(-bound[keep], kind="stable")]
    if node.children:
        below = nodes
        if level:
            below = _children(nodes, len(docs.levels[level - 1]), FAN)
        for child in node.children:
            _open(child, below, max(level - 1, 0), docs, best, keys, met)
    elif level:
        _open(node, _children(nodes, len(docs.levels[level - 1]), FAN), level - 1, docs, best, keys, met)
    else:
        # A leaf at a time, the best bound first: the k-th score rises and closes the rest.
        item = node.items[0]
        bounds = maxima[nodes[:, None], node.terms].sum(1)
        for at, high in zip(nodes, bounds):
            if high < max(1, best.floor[item]):
                break
            rows = np.arange(at * LEAF, min((at + 1) * LEAF, len(docs.exact)))
            met["scored"] = met.get("scored", 0) + len(rows)
            best.offer(item, docs.exact[rows[:, None], node.terms].sum(1), [keys[docs.order[r]] for r in rows])


def _children(nodes: np.ndarray, total: int, fan: int) -> np.ndarray:
    below = (nodes[:, None] * fan + np.arange(fan)).ravel()
    return below[below < total]


def item_blocks(items: DataFrame, id_column: str, text_column: str, block_terms: int) -> Iterator[list[tuple]]:
    """Items with their distinct terms, in blocks of at most `block_terms` terms in all, one block at a time."""
    raw = items.select(column(id_column).alias("id"), column(text_column).cast("string").alias("text")).filter("text IS NOT NULL")
    block, size = [], 0
    # Items come one partition after the other; no more than a block and a partition of them are held.
    for row in raw.toLocalIterator():
        terms = sorted(set(terms_of(row["text"])))
        if not terms:
            continue
        if block and size + len(terms) > block_terms:
            yield block
            block, size = [], 0
        block.append((row["id"], terms))
        size += len(terms)
    if block:
        yield block


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_column: str, text_column: str) -> DataFrame:
    """Each document's `id`, number of terms `n`, and how often it holds the vocabulary's (`terms`, `tf`)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(column(id_column).alias("id"), column(text_column).cast("string").alias("text")).filter("text IS NOT NULL")

    def run(batches):
        known = shared.value
        for whole in batches:
            for part in portions(whole):
                lengths, terms, tfs = [], [], []
                for text in part.column(1).to_pylist():
                    words = terms_of(text)
                    met = Counter(filter(known.__contains__, words))
                    lengths.append(len(words))
                    terms.append([known[w] for w in met])
                    tfs.append(list(met.values()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                     pa.array(tfs, pa.list_(pa.int32()))], ["id", "n", "terms", "tf"],
                )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, terms array<int>, tf array<int>").filter("n > 0")


def _searched(vectors: DataFrame, block: list[tuple], weights: np.ndarray, n: int, total: int, floor: np.ndarray, top: int) -> DataFrame:
    """The best documents of each item among those of one task, at least as good as `floor`."""
    used = [np.array(terms, np.int64) for _, terms in block]
    kind = vectors.schema["id"].dataType
    arrow_kind = to_arrow_type(kind)
    shared = vectors.sparkSession.sparkContext.broadcast((used, weights, floor))
    narrow = vectors.filter(F.size("terms") > 0).select("id", "n", "terms", "tf")

    def run(batches):
        items, worths, least = shared.value
        best = Best(len(items), top, least)
        # Terms of the block get narrow tables: groups of items whose terms fill a table of a few megabytes.
        groups = list(_grouped(items))
        keys: list[tuple] = []
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                part = whole.slice(at, BATCH)
                ids = part.column(0).to_pylist()
                keys = [(x is None, x) for x in ids]
                lengths = part.column(1).to_numpy()
                ends, flat = _flat(part.column(2))
                _, tf = _flat(part.column(3))
                for members, local, root, place in groups:
                    _search_group(members, local, root, place, worths, lengths, ends, flat, tf, n, total, best, keys)
        rows = [(k, key[1], -score) for k, found in enumerate(best.found) for score, key in found]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], arrow_kind),
                 pa.array([r[2] for r in rows], pa.int64())], ["item", "id", "score"],
            )

    return narrow.mapInArrow(run, f"item int, id {kind.simpleString()}, score long")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()


def _grouped(items: list[np.ndarray], width: int = WIDTH):
    """Items in groups of at most `width` different terms (one item at least): their own numbering, tree and places."""
    size = max((int(t.max()) for t in items), default=-1) + 1
    group: list[int] = []
    seen: set[int] = set()
    for k, terms in enumerate(items):
        more = seen | set(terms.tolist())
        if group and len(more) > width:
            yield _group(items, group, seen, size)
            group, more = [], set(terms.tolist())
        group.append(k)
        seen = more
    if group:
        yield _group(items, group, seen, size)


def _group(items, group, seen, size):
    local = np.array(sorted(seen), np.int64)
    place = np.full(size, -1, np.int64)
    place[local] = np.arange(len(local))
    root = item_tree([place[items[k]] for k in group])
    _renamed(root, group)
    return group, local, root, place


def _renamed(node: Node, names: list[int]) -> None:
    node.items = [names[k] for k in node.items]
    for child in node.children:
        _renamed(child, names)


def _search_group(members, local, root, place, weights, lengths, ends, flat, tf, n, total, best, keys) -> None:
    mine = np.where(flat < len(place), place[np.minimum(flat, len(place) - 1)], -1)
    row = np.repeat(np.arange(len(lengths)), ends)
    inside = mine >= 0
    rows, cols, counts = row[inside], mine[inside], tf[inside].astype(np.int64)
    m = 10 + (90 * lengths.astype(np.int64) * n) // total
    gain = weights[local][cols] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[rows]))
    held = np.unique(rows)
    if not len(held):
        return
    table = np.zeros((len(held), len(local)), np.int64)
    table[np.searchsorted(held, rows), cols] = gain
    search(root, Documents.of(table), best, [keys[k] for k in held])


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, id_column: str = "doc_id", text_column: str = "text",
         item_column: str = "item_id", item_text_column: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Each item's `top` documents by lexical score: item id, `rank` (from 1), document id, `score`.

    Terms are runs of ASCII letters and digits (A-Z as a-z) and characters beyond ASCII, of the whole text.  N, L and
    each term's document frequency count all documents with a term.  Equal scores go by ascending id, null ids last.
    A null or empty text, document or item, has no terms; an item without terms, or none of whose terms has a worth in
    a document, gives no rows.  Repeated document rows are ranked each, as are repeated items, each with ranks of its
    own; other columns are not read.

    Documents are counted once a block of items and written to the shared folder as vectors over the block's terms.
    A search over a sample of them gives every item a k-th score that the whole corpus can only raise; with these as
    floors each task searches its own documents and hands on what reaches them, at most `top` an item.
    """
    spark = docs.sparkSession
    doc_type = docs.schema[id_column].dataType
    item_type = items.schema[item_column].dataType
    names = [f"`{item_column}` {item_type.simpleString()}", "rank int", f"`{id_column}` {doc_type.simpleString()}", "score long"]
    parts = []
    for block in item_blocks(items, item_column, item_text_column, block_terms):
        vocabulary = {t: k for k, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        numbered = [(name, [vocabulary[t] for t in terms]) for name, terms in block]
        vectors = stage(counted(docs, vocabulary, id_column, text_column))
        size = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
        n, total = size["n"], size["total"] or 0
        if not n:
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            weights[row["t"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * row["count"] + 1)))
        floor = np.zeros(len(block), np.int64)
        part = max(1, n // SEEDS)
        some = vectors.filter(F.pmod(F.xxhash64("id", "n"), F.lit(part)) == 0) if part > 1 else None
        if some is not None:
            found = _searched(some, numbered, weights, n, total, floor, top)
            for row in _merged_best(found, top).filter(F.col("rank") == top).toLocalIterator():
                floor[row["item"]] = row["score"]
        best = _merged_best(_searched(vectors, numbered, weights, n, total, floor, top), top)
        lookup = spark.createDataFrame(
            [(k, name) for k, (name, _) in enumerate(block)],
            T.StructType([T.StructField("item", T.IntegerType()), T.StructField("name", item_type)]),
        )
        parts.append(best.join(F.broadcast(lookup), "item").select(
            F.col("name").alias(item_column), "rank", F.col("id").alias(id_column), "score"
        ))
    if not parts:
        return empty_table(spark, ", ".join(names))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _merged_best(found: DataFrame, top: int, salts: int = 32) -> DataFrame:
    """The best of what the tasks found, in two steps, so that no item's candidates meet in one task at first."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("id", "score"), F.lit(salts)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return (
        first.select("item", "id", "score")
        .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
        .filter(F.col("rank") <= top)
    )
