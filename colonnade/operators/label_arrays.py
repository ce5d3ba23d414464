"""Labels of one length, up to two edits apart, compared in arrays.

Two such labels differ in one or two places, or one becomes the other by a character that goes at one place and another
that comes elsewhere.  The first agree in a hash of all other places; the second, and those that differ in one place, in
what is left of each without one character, the rest.  Every pair is met once: at the two places where it differs, or at
one cut of each that the order of places singles out (`Texts`).  Hashes have 64 bits and are compared within a task only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def letters(labels: Sequence[str], length: int) -> np.ndarray:
    """Code points of labels of that length, one row each."""
    return np.array(labels, dtype=f"<U{length}").view(np.uint32).reshape(-1, length)


def _hashed(chars: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64 random bits for each character at its place (the finalizer of splitmix64)."""
    z = chars.astype(np.uint64) + (places.astype(np.uint64) + np.uint64(1) << np.uint64(32))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Texts:
    """Labels of one length, with what comparing them takes at every place.

    With a cut at i and another label's at j > i leaving one rest, the two are a pair of two edits that differs in three
    places or more if the character at i isn't the next one's equal (`starts`), that at j of the other not its previous
    one's (`ends`), and what lies between is not all alike: j is beyond `run`.  Where it alternates up to j (`swings`), the
    pair has two such rests."""

    def __init__(self, chars: np.ndarray):
        n = chars.shape[1]
        self.chars, places = chars, np.arange(n)
        self.marks = _hashed(chars, places)
        self.whole = self.marks.sum(axis=1, dtype=np.uint64)
        moved = _hashed(chars[:, 1:], places[:-1])
        self.rests = np.zeros(chars.shape, dtype=np.uint64)
        self.rests[:, 1:] = np.cumsum(self.marks[:, :-1], axis=1, dtype=np.uint64)
        self.rests[:, :-1] += np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        same = chars[:, 1:] == chars[:, :-1]
        self.starts = np.zeros(chars.shape, dtype=bool)
        self.starts[:, :-1] = ~same
        self.ends = np.zeros(chars.shape, dtype=bool)
        self.ends[:, 1:] = ~same
        self.run = np.full(chars.shape, n - 1, dtype=np.int8)
        self.back = np.zeros(chars.shape, dtype=np.int8)
        self.swings = np.full(chars.shape, n - 1, dtype=np.int8)
        # `run` at i: the last of the characters equal to the one at i + 1; `back` at j: the first of those equal to that at j - 1.
        for i in range(n - 3, -1, -1):
            self.run[:, i] = np.where(same[:, i + 1], self.run[:, i + 1], i + 1)
            self.swings[:, i] = np.where(chars[:, i + 2] == chars[:, i], self.swings[:, i + 1], i + 1)
        for j in range(2, n):
            self.back[:, j] = np.where(same[:, j - 2], self.back[:, j - 1], j - 1)


def meet(ordered: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the ordered keys, and rows of the others, that are equal: all of them."""
    low = np.searchsorted(ordered, keys)
    rows = np.flatnonzero(ordered[np.minimum(low, len(ordered) - 1)] == keys)
    low = low[rows]
    count = np.searchsorted(ordered, keys[rows], "right") - low
    at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    return at, np.repeat(rows, count)


class Index:
    """Labels of one length that others are compared with; the hashes without two places are ordered when first asked for."""

    def __init__(self, ids: np.ndarray, texts: Texts):
        self.ids, self.texts = ids, texts
        self.least, self.most = texts.chars.min(axis=0), texts.chars.max(axis=0)
        rests = texts.rests.ravel()
        self.rest_order = np.argsort(rests)
        self.rests = rests[self.rest_order]
        self._two: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def two(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if (i, j) not in self._two:
            t = self.texts
            keys = t.whole - t.marks[:, i] - t.marks[:, j]
            order = np.argsort(keys)
            self._two[i, j] = keys[order], order
        return self._two[i, j]

    def pairs(self, ids: np.ndarray, other: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(rows here, rows there, edits) of all pairs in which the label here has the lower id."""
        a, b = self.texts, other
        n = a.chars.shape[1]
        least, most = np.minimum(self.least, b.chars.min(axis=0)), np.maximum(self.most, b.chars.max(axis=0))
        # No two labels differ at a place that has one character in all of them.
        for i, j in combinations(np.flatnonzero(least < most), 2):
            ordered, order = self.two(i, j)
            at, rows = meet(ordered, b.whole - b.marks[:, i] - b.marks[:, j])
            at = order[at]
            keep = (self.ids[at] < ids[rows]) & (a.chars[at, i] != b.chars[rows, i]) & (a.chars[at, j] != b.chars[rows, j])
            yield at[keep], rows[keep], 2
        at, rows = meet(self.rests, b.rests.ravel())
        at, i = np.divmod(self.rest_order[at], n)
        rows, j = np.divmod(rows, n)
        keep = self.ids[at] < ids[rows]
        at, i, rows, j = at[keep], i[keep], rows[keep], j[keep]
        one = i == j
        yield at[one], rows[one], 1
        here = (i < j) & a.starts[at, i] & b.ends[rows, j] & (j > a.run[at, i])
        there = (j < i) & b.starts[rows, j] & a.ends[at, i] & (i > b.run[rows, j])
        # Of the two rests of an alternating pair the one counts in which the label here is cut first.
        there &= ~((b.swings[rows, j] >= i) & (a.chars[at, i] == b.chars[rows, i - 1]))
        keep = here | there
        yield at[keep], rows[keep], 2


#: Labels compared with a block at a time, and pairs handed on at a time.
CHUNK = 2048
PAIRS_OUT = 16_384
# A pair as one number: its first label's place in the block, its other label's among those met, and its edits less one.
_FIRST, _OTHER = 34, (1 << 33) - 1


def classes(rows: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Rows by ordinal and length of the label."""
    codes = rows["ordinal"].to_numpy().astype(np.int64) << 32 | pc.utf8_length(rows["label"]).to_numpy()
    for code in np.unique(codes).tolist():
        yield (code >> 32, code & 0xFFFFFFFF), np.flatnonzero(codes == code)


class Block:
    """Labels that come first in pairs, the others that they met, and the pairs."""

    def __init__(self):
        self.own: list[pa.RecordBatch] = []
        self.ready: list[pa.RecordBatch] = []
        self.waiting: dict[tuple[int, int], list[tuple]] = {}
        self.index: dict[tuple[int, int], tuple[np.ndarray, Index]] | None = None
        self.pairs: list[np.ndarray] = []
        self.met: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.known = 0

    def indexed(self) -> dict[tuple[int, int], tuple[np.ndarray, Index]]:
        if self.index is None:
            self.first = pa.Table.from_batches(self.own).combine_chunks().to_batches()[0]
            self.ids, self.index = self.first["id"].to_numpy(), {}
            for (ordinal, n), rows in classes(self.first):
                texts = Texts(letters(self.first["label"].take(pa.array(rows)).to_pylist(), n))
                self.index[ordinal, n] = rows, Index(self.ids[rows], texts)
        return self.index

    def add(self, kind: int, rows: pa.RecordBatch) -> None:
        if kind < 2:
            (self.ready if kind else self.own).append(rows)
            return
        known = self.indexed()
        for key, at in classes(rows):
            if key in known:
                some = rows.take(pa.array(at))
                waiting = self.waiting.setdefault(key, [])
                waiting.append(some)
                if sum(x.num_rows for x in waiting) >= CHUNK:
                    self.compare(key)

    def compare(self, key: tuple[int, int]) -> None:
        table = pa.Table.from_batches(self.waiting.pop(key)).combine_chunks()
        place, index = self.index[key]
        for start in range(0, table.num_rows, CHUNK):
            rows = table.slice(start, CHUNK)
            ids = rows["id"].to_numpy()
            at, to, edits = [], [], []
            for x, y, e in index.pairs(ids, Texts(letters(rows["label"].to_pylist(), key[1]))):
                at.append(x), to.append(y), edits.append(np.full(len(x), e - 1))
            to = np.concatenate(to)
            if len(to):
                used, to = np.unique(to, return_inverse=True)
                self.keep(place[np.concatenate(at)], to, np.concatenate(edits), rows.take(pa.array(used)))

    def keep(self, first: np.ndarray, other: np.ndarray, edits: np.ndarray, rows: pa.Table | pa.RecordBatch) -> None:
        self.pairs.append(first.astype(np.int64) << _FIRST | (other.astype(np.int64) + self.known) << 1 | edits)
        self.met.append((rows["id"].to_numpy(), rows["label"], rows["n"].to_numpy()))
        self.known += rows.num_rows

    def sorted(self) -> Iterator[pa.RecordBatch]:
        """The pairs in the order of both numbers."""
        self.indexed()
        for key in list(self.waiting):
            self.compare(key)
        for rows in self.ready:
            first = np.searchsorted(self.ids, rows["first"].to_numpy())
            self.keep(first, np.arange(rows.num_rows), rows["edits"].to_numpy().astype(np.int64) - 1, rows)
        if not self.pairs:
            return
        ids, n = (np.concatenate([m[k] for m in self.met]) for k in (0, 2))
        labels = pa.concat_arrays([c for m in self.met for c in (m[1].chunks if isinstance(m[1], pa.ChunkedArray) else [m[1]])])
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        pairs = np.concatenate(self.pairs)
        self.pairs = []
        pairs = pairs & ~np.int64(_OTHER << 1) | rank[pairs >> 1 & _OTHER] << 1
        pairs.sort()
        count = self.first["n"].to_numpy()
        for start in range(0, len(pairs), PAIRS_OUT):
            some = pairs[start : start + PAIRS_OUT]
            a, b = some >> _FIRST, order[some >> 1 & _OTHER]
            own = self.first.select(["ordinal", "column", "label"]).take(pa.array(a))
            yield pa.RecordBatch.from_arrays(
                [own["ordinal"], own["column"], own["label"], labels.take(pa.array(b)), pa.array(count[a]), pa.array(n[b]), pa.array((some & 1).astype(np.int32) + 1, pa.int32())],
                ["ordinal", "column", "a", "b", "rows_a", "rows_b", "edits"],
            )


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs, in order, of rows sorted by block, kind and number: of kind 0 a block's labels, of 1 the other labels of pairs
    found already (`first`: the number of the one in the block), of 2 labels to be compared with the block's."""
    block, number = None, None
    for batch in batches:
        code = batch["block"].to_numpy().astype(np.int64) << 2 | batch["kind"].to_numpy()
        cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            if block is None or code[start] >> 2 != number:
                if block:
                    yield from block.sorted()
                block, number = Block(), code[start] >> 2
            block.add(int(code[start] & 3), batch.slice(start, end - start))
    if block:
        yield from block.sorted()


# ---- counts of pairs, without the pairs -------------------------------------------------------------

#: Places of a label are dealt into so many segments; what a bucket holds agrees in all but two of them.
SEGMENTS = 4
ROUTES = list(combinations(range(SEGMENTS), 2))
#: Rows that are worked on at a time, and those a bucket may have to be worked on in one task.
ROWS = 1 << 16
HOT_ROWS = 1 << 18
#: A row of a rest: its second hash, the place of the cut, and `run`, `back` and `swings` there; then three flags.
_HASH, _PLACE, _RUN, _BACK, _SWINGS, _STARTS, _ENDS, _TURNS = 32, 27, 22, 17, 12, 11, 10, 9
_FIVE = 31


def letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each character stands at each place of labels (`ordinal`, `label`) of a column and length."""
    for batch in batches:
        rows: list[tuple] = []
        for (ordinal, n), at in classes(batch):
            chars = letters(batch["label"].take(pa.array(at)).to_pylist(), n)
            for place in range(n):
                rows += [(ordinal, n, place, c, k) for c, k in zip(*(x.tolist() for x in np.unique(chars[:, place], return_counts=True)))]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["ordinal", "length", "place", "letter", "count"]
        )


def segments(weights: dict[int, float]) -> dict[int, int]:
    """Segment of each place by its weight, how much its character tells, such that all segments tell as much."""
    total, out, below = sum(weights.values()), {}, 0.0
    for place, weight in sorted(weights.items()):
        out[place] = min(SEGMENTS - 1, int(SEGMENTS * (below + weight / 2) / total))
        below += weight
    return out


def places_of(route: int, segment: dict[int, int]) -> list[tuple[int, int]]:
    """Pairs of places in which labels of a bucket are compared: one in each of the route's two segments, or both in its
    first, or last, one where no route before has had them."""
    s, t = ROUTES[route]
    both = {(s, t)} | {(k, k) for k in (s, t) if next(r for r, x in enumerate(ROUTES) if k in x) == route}
    return [(i, j) for i, j in combinations(sorted(segment), 2) if (segment[i], segment[j]) in both]


def _class_hash(ordinal: int, n: int, more: int = 0) -> np.uint64:
    return _hashed(np.array([ordinal], np.uint64), np.array([1000 + 64 * n + more]))[0]


def rests_of(kinds: dict[tuple[int, int], dict[int, int]]):
    """For labels (`id`, `ordinal`, `label`) a row for each place that differs in their column and length: a hash of the
    rest, and what counting takes.  Cuts elsewhere make no pair: the other label would differ at that place."""

    def run(batches):
        for batch in batches:
            for key, at in classes(batch):
                if key not in kinds:
                    continue
                ids, texts = batch["id"].to_numpy()[at], batch["label"].take(pa.array(at)).to_pylist()
                places = np.array(sorted(kinds[key]))
                t, again = Texts(letters(texts, key[1])), Texts(letters(texts, key[1]) + np.uint32(0x200000))
                turns = np.zeros(t.chars.shape, dtype=bool)
                turns[:, 2:] = (t.chars[:, 2:] == t.chars[:, :-2]) & t.ends[:, 2:]
                packed = (again.rests >> np.uint64(_HASH)).view(np.int64) << _HASH
                for value, shift in ((np.arange(key[1]), _PLACE), (t.run, _RUN), (t.back, _BACK), (t.swings, _SWINGS), (t.starts, _STARTS), (t.ends, _ENDS), (turns, _TURNS)):
                    packed |= value.astype(np.int64) << shift
                one = (t.rests + _class_hash(*key)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[:, places].ravel()), pa.array(packed[:, places].ravel()), pa.array(np.repeat(ids, len(places)))], ["one", "two", "id"]
                )

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], most: int = 0) -> Iterator[tuple[pa.Table, bool]]:
    """Sorted rows in tables of some `ROWS` that no group of the keys crosses; with `most`, parts of a group that has more
    rows come alone, told by the flag."""
    waiting: list[pa.RecordBatch] = []
    rows, large = 0, None

    def key_of(batch, at):
        return tuple(batch[k][at].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        table = pa.Table.from_batches(waiting).combine_chunks()
        last = key_of(table, rows - 1)
        new = np.zeros(rows - 1, dtype=bool)
        for k in keys:
            column = table[k].to_numpy()
            new |= column[1:] != column[:-1]
        cuts = np.flatnonzero(new) + 1
        cut = int(cuts[-1]) if len(cuts) else 0
        start = 0
        if large is not None:
            start = int(cuts[0]) if len(cuts) else rows
            yield table.slice(0, start), True
            large = last if not len(cuts) else None
        if cut > start:
            yield table.slice(start, cut - start), False
        start = max(start, cut)
        if most and rows - start > most:
            yield table.slice(start), True
            start, large = rows, last
        waiting = table.slice(start).to_batches()
        rows -= start
    if rows:
        table = pa.Table.from_batches(waiting).combine_chunks()
        yield from _rest_of_large(table, keys, large) if large is not None else [(table, False)]


def _rest_of_large(table: pa.Table, keys: Sequence[str], large: tuple) -> Iterator[tuple[pa.Table, bool]]:
    own = np.logical_and.reduce([table[k].to_numpy() == v for k, v in zip(keys, large)])
    end = int(own.sum())
    if end:
        yield table.slice(0, end), True
    if end < table.num_rows:
        yield table.slice(end), False


#: Columns of counts and ties, and of rows that go on by two places.
COUNTS = ["id", "links", "other"]
PLACES = [*COUNTS, "one", "two", "letters"]


def _out(ids: np.ndarray, links: np.ndarray | None, other: np.ndarray | None, places: bool = False) -> pa.RecordBatch:
    """Counts or ties of labels; with `places` beside columns that rows of two places have."""
    columns = [pa.array(ids), *[pa.nulls(len(ids), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (links, other)]]
    return pa.RecordBatch.from_arrays(columns + [pa.nulls(len(ids), pa.int64())] * 3 if places else columns, PLACES if places else COUNTS)


def rest_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of `rests_of`, sorted by both hashes: with how many labels of the group each one is a pair that differs in
    one place, or by a character that goes and one that comes elsewhere (`links`), and the group's least label (`other`)."""
    five = lambda two, shift: two >> shift & _FIVE

    def groups():
        for batch in batches:
            yield batch.append_column("high", pa.array(batch["two"].to_numpy() >> _HASH))

    for table, _ in whole_groups(groups(), ["one", "high"]):
        one, two, high, ids = (table[c].to_numpy() for c in ("one", "two", "high", "id"))
        new = np.ones(len(one), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (high[1:] != high[:-1])
        number = np.cumsum(new) - 1
        alone = np.bincount(number)[number] == 1
        two, ids, number = two[~alone], ids[~alone], number[~alone]
        if not len(ids):
            continue
        base, place = number * 32, five(two, _PLACE)
        key = base + place
        starts, ends, turns = (two >> k & 1 for k in (_STARTS, _ENDS, _TURNS))
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (starts, ends, turns)]

        def between(what, low, high):  # noqa: B023
            a, b = np.searchsorted(key, low), np.searchsorted(key, high)  # noqa: B023
            return np.where(b > a, sums[what][b] - sums[what][np.minimum(a, b)], 0)  # noqa: B023

        links = np.searchsorted(key, key, "right") - np.searchsorted(key, key) - 1
        links += starts * between(1, base + five(two, _RUN) + 1, base + 32)
        links += ends * between(0, base, base + five(two, _BACK))
        links -= starts * between(2, key + 2, base + five(two, _SWINGS) + 1)
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(ids))))
        kept = (links > 0) | (least < ids)
        if kept.any():
            yield _out(ids[kept], links[kept], least[kept])


def buckets_of(kinds: dict[tuple[int, int], dict[int, int]]):
    """For labels (`id`, `ordinal`, `label`, `root`) a row for each route with a hash of all other segments."""

    def run(batches):
        for batch in batches:
            for key, at in classes(batch):
                if key not in kinds:
                    continue
                some, segment = batch.take(pa.array(at)), kinds[key]
                t = Texts(letters(some["label"].to_pylist(), key[1]))
                for route, two in enumerate(ROUTES):
                    if not places_of(route, segment):
                        continue
                    free = [i for i, s in segment.items() if s in two]
                    mark = t.whole - t.marks[:, free].sum(axis=1, dtype=np.uint64) + _class_hash(*key, route + 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mark.view(np.int64)), pa.array(np.full(len(at), route), pa.int32()), some["ordinal"], some["id"], some["root"], some["label"]],
                        ["mark", "route", "ordinal", "id", "root", "label"],
                    )

    return run


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key how many are equal to it, the order of the keys, and which of these begin a new one."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.append(np.flatnonzero(new), len(keys))
    count = np.empty(len(keys), dtype=np.int64)
    count[order] = np.repeat(np.diff(first), np.diff(first))
    return count, order, new


def _chains(roots: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Different roots that follow each other within a group, as rows of two."""
    step = np.flatnonzero(~new[1:] & (roots[1:] != roots[:-1]))
    return np.stack([roots[step], roots[step + 1]], axis=1)


def bucket_counts(kinds: dict[tuple[int, int], dict[int, int]]):
    """From rows of `buckets_of`, sorted by route and hash: with how many labels each one is a pair that differs in just two
    places (`links`); and pairs of different roots (`id`, `other`, no `links`) that such labels, or some that differ in one,
    connect.  Of buckets too large for a task the rows come back for each two places (`one`, `two`, `letters`)."""

    def run(batches):
        for table, large in whole_groups(batches, ["route", "mark"], HOT_ROWS):
            route, mark = table["route"].to_numpy(), table["mark"].to_numpy()
            if not large:
                same = (mark[1:] == mark[:-1]) & (route[1:] == route[:-1])
                table = table.filter(pa.array(np.append(same, False) | np.append(False, same)))
                route = table["route"].to_numpy()
            for r in np.unique(route).tolist():
                rows = table.filter(pa.array(route == r)).combine_chunks()
                for key, at in classes(rows.to_batches()[0]):
                    some = rows.take(pa.array(at))
                    ids, roots = some["id"].to_numpy(), some["root"].to_numpy()
                    t = Texts(letters(some["label"].to_pylist(), key[1]))
                    if large:
                        again = _hashed(t.chars + np.uint32(0x200000), np.arange(key[1]))
                        for i, j in places_of(r, kinds[key]):
                            one = t.whole - t.marks[:, i] - t.marks[:, j] + _class_hash(*key, 8)
                            two = again.sum(axis=1, dtype=np.uint64) - again[:, i] - again[:, j] + np.uint64(32 * i + j)
                            pair = t.chars[:, i].astype(np.int64) << 32 | t.chars[:, j]
                            columns = [ids, None, roots, one.view(np.int64), two.view(np.int64), pair]
                            yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()) if x is None else pa.array(x) for x in columns], PLACES)
                        continue
                    open_ = t.chars.min(axis=0) < t.chars.max(axis=0)
                    links, chains, single = np.zeros(len(ids), dtype=np.int64), [], {}
                    for i, j in places_of(r, kinds[key]):
                        if not (open_[i] and open_[j]):
                            continue
                        for k in {i, j} - single.keys():
                            single[k] = _counted(t.whole - t.marks[:, k])[0]
                        count, order, new = _counted(t.whole - t.marks[:, i] - t.marks[:, j])
                        links += count - single[i] - single[j] + 1
                        chains.append(_chains(roots[order], new))
                    kept = links > 0
                    yield _out(ids[kept], links[kept], None, places=True)
                    if chains:
                        pairs = np.unique(np.concatenate(chains), axis=0)
                        yield _out(pairs[:, 0], None, pairs[:, 1], places=True)

    return run


def place_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same from rows of large buckets, sorted by both hashes: labels of a group agree but in two places."""
    for table, _ in whole_groups(batches, ["one", "two"]):
        one, two, letter, ids, roots = (table[c].to_numpy() for c in ("one", "two", "letters", "id", "other"))
        new = np.ones(len(one), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        number = np.cumsum(new) - 1
        links = np.bincount(number)[number] + 1
        for part in (letter >> 32, letter & 0xFFFFFFFF):
            links -= _counted(number << 32 | part)[0]
        chains = _chains(roots, new)
        kept = links > 0
        yield _out(ids[kept], links[kept], None)
        yield _out(chains[:, 0], None, chains[:, 1])
