"""Packing token ids into training windows by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from colonnade.llm.common import id_and_text, portions
from colonnade.llm.tokens import encoder

#: Open windows a task holds before it closes them.
MOST_OPEN = 4096

_SEQUENCES_PER_TASK = 1 << 36


class Windows:
    """The partially filled windows of a task, by fill level.

    `count[h]` is the number of open windows holding h tokens.  An item goes to the level that leaves the
    sum of squares of these counts least (a new window is level 0; among equals, the fullest), which keeps
    levels apart and so a gap ready for every size.
    """

    def __init__(self, size: int, first_id: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.n_open = 0
        self.next_id = first_id

    def level_for(self, n: int) -> int:
        count, size = self.count, self.size
        levels = np.flatnonzero(count[1 : size - n + 1]) + 1
        if not len(levels):
            return 0
        after = levels + n
        change = 1 - 2 * count[levels] + np.where(after < size, 1 + 2 * count[after], 0)
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if change[best] <= (1 + 2 * count[n] if n < size else 0) else 0

    def place(self, piece: tuple) -> list | None:
        """Put a piece (id, start, ids, tokens of its document) into a window; the window, if it is full now."""
        n = len(piece[2])
        level = self.level_for(n)
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if level + n == self.size:
            return window
        self.open[level + n].append(window)
        self.count[level + n] += 1
        self.n_open += 1
        return None

    def close(self) -> Iterator[list]:
        """All open windows, the emptiest cut up to fill the gaps of the fullest; one at most stays short."""
        rest = [(level, w) for level in range(self.size - 1, 0, -1) for w in self.open[level]]
        self.open = [[] for _ in range(self.size + 1)]
        self.count[:] = 0
        self.n_open = 0
        last = len(rest) - 1
        for k, (level, window) in enumerate(rest):
            if k > last:
                return
            gap = self.size - level
            while gap and k < last:
                donor = rest[last][1]
                key, start, ids, total = donor.pop()
                window.append((key, start, ids[:gap], total))
                if len(ids) > gap:
                    donor.append((key, start + gap, ids[gap:], total))
                gap -= min(gap, len(ids))
                if not donor:
                    last -= 1
            if k == last:
                yield window
                return
            yield window


def pack(
    docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, id_column: str = "doc_id",
    text_column: str = "text", most_open: int = MOST_OPEN,
) -> DataFrame:
    """Every document's ids, then `end_id`, cut into pieces that fill sequences of `size` ids.

    A row per piece: the id, `start` (its document's ids before it), `length`, `ids_crc32` (of the ids as
    little-endian unsigned 32-bit numbers), `doc_tokens` (with the end id), `sequence_id`, `offset` (its place
    there, without gaps from 0), `sequence_length` (ids in the sequence) and `padded_to` (`size`, or the length
    itself where that is a power of two).

    A document longer than a window fills whole windows first.  What is left goes by the sum-of-squares rule,
    uncut.  Windows still open at a task's end, or when `most_open` are, are cut to fill each other, so that one
    short sequence at most is left each time.  A null or empty text is the end id alone.  Rows are packed one by
    one: equal rows, equal or null ids make pieces of their own.  Other columns are not read.  Each task packs
    the rows it reads in their order, without a shuffle; a task that runs again packs the same rows the same way.
    """
    if size < 1:
        raise ValueError("a sequence needs room for a token")
    rows = id_and_text(docs, id_column, text_column)
    id_type = rows.schema["id"].dataType
    schema = (
        f"`{id_column}` {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, `offset` long, sequence_length long, padded_to long"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        windows = Windows(size, TaskContext.get().partitionId() * _SEQUENCES_PER_TASK)
        end = np.array([end_id], np.uint32)
        key_type = None
        full: list[list] = []

        def written() -> pa.RecordBatch:
            out = [[] for _ in range(9)]
            for window in full:
                length = sum(len(p[2]) for p in window)
                padded = length if length & (length - 1) == 0 else size
                offset = 0
                for key, start, ids, total in window:
                    crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes())
                    row = (key, start, len(ids), crc, total, windows.next_id, offset, length, padded)
                    for values, value in zip(out, row):
                        values.append(value)
                    offset += len(ids)
                windows.next_id += 1
            full.clear()
            names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                     "sequence_length", "padded_to"]
            types = [key_type] + [pa.int64()] * 8
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)

        for batch in batches:
            key_type = batch.column(0).type
            for part in portions(batch):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.concatenate([tool.ids(text), end])
                    whole = len(ids) - len(ids) % size
                    full.extend([(key, at, ids[at : at + size], len(ids))] for at in range(0, whole, size))
                    if whole < len(ids):
                        window = windows.place((key, whole, ids[whole:].copy(), len(ids)))
                        if window:
                            full.append(window)
                        if windows.n_open >= most_open:
                            full.extend(windows.close())
                if full:
                    yield written()
        full.extend(windows.close())
        if full:
            yield written()

    return rows.mapInArrow(run, schema)
