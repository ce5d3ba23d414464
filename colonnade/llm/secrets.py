"""Secrets in texts: known shapes, and stretches too random to be words."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from colonnade.llm.common import id_and_text, per_text

_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

#: Candidates for the entropy test; they hold a digit, which words of any language don't.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}", re.ASCII)
_DIGIT = re.compile(r"[0-9]")
#: For each class its characters, the window and the least entropy in bits per character.
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9a-fA-F]+"), 20, 3.0),
    "entropy_base64": (re.compile(r"[A-Za-z0-9+/_-]+"), 20, 3.9),
}


def _beginning(row: str, least: int) -> str:
    """A pattern for the first `least` or more characters of a row."""
    pattern = ""
    for character in reversed(row[least:]):
        pattern = f"(?:{character}{pattern})?"
    return row[:least] + pattern


_ROWS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "1234567890")
#: Stretches that look random and are none: UUIDs, dates and times, joined words with a number, plain numbers, the
#: alphabet and digits in order.  None is open at an end, so that nothing hides behind them.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T/_-][0-9]{1,6})*Z?(?:[/_-][A-Za-z]+)*/?",
    r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{1,8}(?:[-_/][0-9]{1,8})*/?",
    r"(?:[A-Za-z]+|[0-9]{1,5})(?:[-_/](?:[A-Za-z]+|[0-9]{1,5}))+/?",
    r"[0-9+/_-]+",
    "(?:(?:" + "|".join(_beginning(row, 8) for row in _ROWS) + ")[+/_-]{0,2})+",
)


def windows_above(run: str, width: int, least: float) -> Iterator[tuple[int, int]]:
    """Maximal stretches covered by windows of `width` characters whose Shannon entropy is at least `least`
    bits a character.  A step changes two counts, and with them the sum of c log c."""
    if len(run) < width:
        return
    weight = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts = Counter(run[:width])
    total = sum(weight[c] for c in counts.values())
    limit = width * (math.log2(width) - least) + 1e-9
    start = end = -1
    for at in range(len(run) - width + 1):
        if at:
            old, new = run[at - 1], run[at + width - 1]
            c = counts[old]
            counts[old] = c - 1
            total += weight[c - 1] - weight[c]
            c = counts[new]
            counts[new] = c + 1
            total += weight[c + 1] - weight[c]
        if total <= limit:
            if start >= 0 and at > end:
                yield start, end
                start = -1
            if start < 0:
                start = at
            end = at + width
    if start >= 0:
        yield start, end


class Scanner:
    """Finds spans in one text at a time."""

    def __init__(self, allowed: tuple[str, ...] = ALLOWED, classes: dict = CLASSES):
        self.allowed = re.compile("|".join(f"(?:{a})" for a in allowed), re.ASCII) if allowed else None
        self.classes = classes

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, place of the kind in KINDS, end) of the known shapes."""
        spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if "AKIA" in text:
            spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return spans

    def random(self, text: str) -> list[tuple[int, int, int]]:
        """The same of stretches of high entropy that no allowed shape explains."""
        spans = []
        for m in _CANDIDATE.finditer(text):
            if not _DIGIT.search(m[0]) or self.allowed and self.allowed.fullmatch(m[0]):
                continue
            for kind, (members, width, least) in self.classes.items():
                for run in members.finditer(m[0]):
                    base = m.start() + run.start()
                    spans += [
                        (base + a, KINDS.index(kind), base + b)
                        for a, b in windows_above(run[0], width, least)
                        if not (self.allowed and self.allowed.fullmatch(run[0][a:b]))
                    ]
        return spans


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan_secrets(
    docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """For every row the id, `n_assign`, `n_access`, `n_hex` (matches of the known shapes), `n_entropy` (stretches
    the entropy test adds), `base_sha256` and `spans` (`kind:start:end` in code points, end exclusive, by start,
    joined by commas; the first is the SHA-256 of the known shapes' part).

    The entropy test slides a window over every candidate, once for each character class, and keeps the maximal
    stretches of windows above the class's limit, unless the stretch or the whole candidate fits an `allowed`
    pattern.  A null or empty text has no spans; equal rows and null ids give a row each; other columns are not read.
    """

    def prepare():
        scanner = Scanner(allowed)

        def compute(texts: list[str]) -> dict[str, list]:
            base = [scanner.base(t) for t in texts]
            more = [scanner.random(t) for t in texts]
            kinds = [[s[1] for s in spans] for spans in base]
            return {
                "n_assign": [k.count(0) for k in kinds],
                "n_access": [k.count(1) for k in kinds],
                "n_hex": [k.count(2) for k in kinds],
                "n_entropy": [len(s) for s in more],
                "base_sha256": [hashlib.sha256(written(s).encode()).hexdigest() for s in base],
                "spans": [written(a + b) for a, b in zip(base, more)],
            }

        return compute

    return per_text(
        id_and_text(docs, id_column, text_column), prepare,
        "n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string", id_column,
    )
