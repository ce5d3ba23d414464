"""Sorting byte strings that share long beginnings: multikey quicksort first, blind tries below."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes looked at by the quicksort before groups that still agree go to a trie, and bytes per step.
SHALLOW, STEP = 32, 8


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


class BlindTrie:
    """Strings by the bytes at which they part; what lies between is not stored.

    A new string walks down by those bytes alone, without looking at the rest, and is then compared once with the
    string it ends up at: the length they share tells where it branches off."""

    def __init__(self, keys: list[bytes]):
        self.keys = keys
        self.root: list | None = None

    @staticmethod
    def _byte(key: bytes, depth: int) -> int:
        return key[depth] if depth < len(key) else -1

    def insert(self, row: int) -> None:
        """A node is [depth, {byte: node}], a leaf [-1, rows with that string]."""
        key = self.keys[row]
        if self.root is None:
            self.root = [-1, [row]]
            return
        path, node = [], self.root
        while node[0] >= 0:
            path.append(node)
            below = node[1]
            node = below.get(self._byte(key, node[0])) or next(iter(below.values()))
        other = self.keys[node[1][0]]
        if key == other:
            node[1].append(row)
            return
        shared = common(key, other)
        leaf = [-1, [row]]
        parent = None
        for step in path:
            if step[0] >= shared:
                break
            parent = step
        below = self.root if parent is None else parent[1].get(self._byte(other, parent[0]))
        if below[0] == shared:
            below[1][self._byte(key, shared)] = leaf
            return
        fork = [shared, {self._byte(other, shared): below, self._byte(key, shared): leaf}]
        if parent is None:
            self.root = fork
        else:
            parent[1][self._byte(other, parent[0])] = fork

    def rows(self) -> Iterator[int]:
        """All rows in the order of their strings."""
        waiting = [self.root] if self.root else []
        while waiting:
            node = waiting.pop()
            if node[0] < 0:
                yield from node[1]
            else:
                waiting.extend(node[1][b] for b in sorted(node[1], reverse=True))


def sorted_rows(keys: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Row numbers in the order of their strings."""
    out: list[int] = []
    waiting = [(list(range(len(keys))), 0)]
    while waiting:
        rows, depth = waiting.pop()
        if len(rows) < 2:
            out += rows
        elif depth >= shallow:
            trie = BlindTrie(keys)
            for row in rows:
                trie.insert(row)
            out += trie.rows()
        else:
            pivot = keys[rows[len(rows) // 2]][depth : depth + STEP]
            less, same, more = [], [], []
            for row in rows:
                part = keys[row][depth : depth + STEP]
                (same if part == pivot else less if part < pivot else more).append(row)
            waiting.append((more, depth))
            if len(pivot) < STEP:  # all of them end here
                waiting += [([row], depth) for row in reversed(same)]
            else:
                waiting.append((same, depth + STEP))
            waiting.append((less, depth))
    return out


def sorted_with_shared(keys: list[bytes]) -> tuple[list[int], list[int]]:
    """Row numbers in order, and the length each shares with the next."""
    order = sorted_rows(keys)
    return order, [common(keys[a], keys[b]) for a, b in zip(order, order[1:])]
