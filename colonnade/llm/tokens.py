"""Token counts of texts of any length: huge ones are encoded in overlapping chunks that are spliced where
both chunks are known to agree."""

from __future__ import annotations

import functools
import json
import os
from array import array

import numpy as np
from pyspark.sql import DataFrame

from colonnade.llm.common import id_and_text, per_text

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 9
#: Stretches beyond this length go to the library itself.
RANKED_CHARS = 1 << 17


def _byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _ranked(config: dict):
    """The vocabulary as ranks for tiktoken, which encodes five times as fast to the same ids; None unless every merge makes the id of its rank, as that is what it goes by."""
    import public_tokenizers
    import tiktoken

    vocabulary, merges = config["model"]["vocab"], config["model"]["merges"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
    if config["model"].get("ignore_merges") or any(vocabulary.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
        return None
    alphabet = _byte_alphabet()
    added = {t["content"] for t in config.get("added_tokens") or []}
    ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in vocabulary.items() if t not in added}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """A tokenizer file of `tokenizers`, without added special tokens; special strings within a text are
    read as the library does by default."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        before = config.get("pre_tokenizer") or {}
        added = config.get("added_tokens") or []
        # Only here does a cut before a space hold, and do ids tell how many bytes they stand for.
        self.byte_level = (
            config.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and config["model"].get("type") == "BPE"
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
            and not any(c.isspace() for t in added for c in t["content"])
        )
        self._ranked = _ranked(config) if self.byte_level else None
        self._added = [t["content"] for t in added]
        self.longest_added = max((len(t["content"]) for t in added), default=0)
        if self.byte_level:
            vocabulary = self._library.get_vocab(with_added_tokens=True)
            self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.bytes_of[i] = len(token)
            for t in added:
                self.bytes_of[t["id"]] = len(t["content"].encode())

    def _stretch(self, text: str) -> np.ndarray:
        """The ids of a text in one go."""
        if self._ranked is None or len(text) > RANKED_CHARS or any(a in text for a in self._added):
            ids = self._library.encode(text, add_special_tokens=False).ids
        else:
            ids = self._ranked.encode_ordinary(text)
        return np.frombuffer(array("I", ids), np.uint32)

    def ids(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
        """The ids of the whole text as unsigned 32-bit numbers."""
        if len(text) <= chunk + overlap or not self.byte_level:
            return self._stretch(text)
        return np.concatenate(list(self._spliced(text, chunk, overlap)))

    def _spliced(self, text: str, chunk: int, overlap: int):
        """Ids of chunks, cut where they meet.

        The left chunk ends `overlap` characters after the start of the right one.  A place in between
        serves when both encodings have a token boundary there, a character that isn't white space stands
        before it and white space after it, and the left chunk saw enough behind it to know about added
        tokens.  No unit of the pattern spans such a place whatever surrounds it, so both encodings are
        those of the whole text there.  Where there is none, the overlap doubles.
        """
        margin = self.longest_added + 4
        start, end = 0, chunk
        width = overlap
        while start < len(text):
            if end + width >= len(text):
                yield self._stretch(text[start:])
                return
            left = self._stretch(text[start : end + width])
            shared = text[end : end + width]
            meeting = self._meeting(left, text[start:end], shared, margin)
            if meeting is None:
                width *= 2
                continue
            tokens, at = meeting
            yield left[:tokens]
            start = end + at
            end, width = start + chunk, overlap

    def _meeting(self, left: np.ndarray, before: str, shared: str, margin: int) -> tuple[int, int] | None:
        """How many ids of the left chunk end at the first common stable boundary, and its place in `shared`."""
        right = self._stretch(shared)
        base = len(before.encode())
        left_ends = np.cumsum(self.bytes_of[left])
        right_ends = np.cumsum(self.bytes_of[right])
        byte = 0
        for at in range(1, len(shared) - margin):
            byte += len(shared[at - 1].encode())
            if shared[at].isspace() and not shared[at - 1].isspace():
                i = int(np.searchsorted(left_ends, base + byte))
                j = int(np.searchsorted(right_ends, byte))
                if i < len(left) and left_ends[i] == base + byte and right_ends[j] == byte:
                    return i + 1, at
        return None


class PieceEncoder:
    """A sentencepiece model; texts are encoded whole."""

    byte_level = False

    def __init__(self, path: str):
        import sentencepiece

        self._library = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._library.encode(text), np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder | PieceEncoder:
    """The tokenizer of a worker, loaded once and kept over its tasks."""
    return PieceEncoder(path) if path.endswith(".model") else Encoder(path)


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The id with `n_bytes` (UTF-8), `n_tokens` and `over_limit` (more than `limit` tokens) of every row.

    One row comes back per row that goes in, also for repeated rows and null ids; a null or empty text has
    0 bytes and 0 tokens; other columns are not read.  `tokenizer` is a path that every worker can open: a
    `.json` file of `tokenizers` or a `.model` of sentencepiece.  Texts beyond the chunk size are encoded in
    overlapping chunks (byte-level files only; others whole), so memory follows the longest row.
    """

    def prepare():
        tool = encoder(tokenizer)

        def compute(texts: list[str]) -> dict[str, list]:
            counts = [len(tool.ids(t)) for t in texts]
            return {
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": counts,
                "over_limit": [n > limit for n in counts],
            }

        return compute

    return per_text(
        id_and_text(docs, id_column, text_column), prepare, "n_bytes long, n_tokens long, over_limit boolean", id_column
    )
