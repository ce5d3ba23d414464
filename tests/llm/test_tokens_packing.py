import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from colonnade.llm import packing, queries, tokens

PATH = queries.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "a  b", " lead", "trail ", "x\n y\n\n z", "<|endoftext|> a<|endoftext|>b <|endo ftext|>", "it's 'll  can't",
    " 　 wide", " " * 40_000, "a" * 40_000, "ab\t" * 20_000, "word " * 20_000, "<|endoftext|>" * 4_000,
    "日本語 " * 12_000 + "é" * 3_000, "b" * 36_000 + " c d e f" * 100,
]


def plain(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_ids_are_the_library_s(text):
    tool = tokens.encoder(PATH)
    assert tool.ids(text).tolist() == plain(text)
    short = text[:4_000]
    for chunk, overlap in ((7, 3), (64, 16), (1_000, 40)):
        assert tool.ids(short, chunk, overlap).tolist() == plain(short)


def docs(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


def test_counts_of_odd_rows(spark):
    rows = [(1, None), (None, "a b"), (2, ""), (3, "same"), (3, "same")] + [(10 + k, t) for k, t in enumerate(ODD)]
    got = tokens.count_tokens(docs(spark, rows), PATH).collect()
    want = [(i, len((t or "").encode()), len(plain(t or "")), len(plain(t or "")) > 1024) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_no_rows_and_clashing_names(spark):
    assert tokens.count_tokens(docs(spark, []), PATH).count() == 0
    assert packing.pack(docs(spark, []), PATH).count() == 0
    clash = docs(spark, [(1, "one two", 7, "x")], ", n_tokens long, id string")
    assert tokens.count_tokens(clash, PATH).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert packing.pack(clash, PATH).count() == 1


def check_pieces(rows, texts, size):
    """Every id lies in one piece, sequences have no gaps, checksums hold; the share of padding."""
    at, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        at[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for key, text in texts.items():
        ids = np.array(plain(text or "") + [0], np.uint32)
        end = 0
        for r in sorted(at.pop(key), key=lambda r: r.start):
            assert r.start == end and r.doc_tokens == len(ids)
            end += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : end].tobytes())
        assert end == len(ids)
    assert not at
    pad = 0
    for pieces in sequences.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= size and all(r.sequence_length == end for r in pieces)
        pad += pieces[0].padded_to - end
    return pad / sum(r.length for r in rows)


def test_packing_of_documents(spark, sf):
    frame = queries.table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert check_pieces(queries.op1_packing(spark, sf).collect(), texts, 1024) < 0.02


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_packing_small_windows(spark, size):
    texts = {k: t for k, t in enumerate([None, "", "a b c d e f g h i j", "same", "same", "x" * 500] * 5)}
    rows = packing.pack(docs(spark, list(texts.items())).coalesce(1), PATH, size, most_open=3).collect()
    check_pieces(rows, texts, size)


def test_rule_takes_the_least_sum_of_squares():
    windows = packing.Windows(10, 0)
    rng = np.random.default_rng(5)
    for n in rng.integers(1, 11, 500):
        counts = windows.count.copy()
        options = {}
        for level in [0, *np.flatnonzero(counts[1 : 10 - n + 1]) + 1]:
            after = counts.copy()
            after[level] -= level > 0
            after[level + n] += level + n < 10
            options[int(level)] = int((after[1:10] ** 2).sum())
        best = windows.level_for(int(n))
        assert options[best] == min(options.values())
        windows.place((0, 0, np.zeros(n, np.uint32), int(n)))
