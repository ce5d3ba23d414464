import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from colonnade.llm import lexical_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    """Every item against every document, as the contract says."""
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for name, text in items:
        scored = []
        for d, c in held:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if c[t]
            )
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(name, k, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def ranked(found):
    return sorted(((r[0], r[1], r[2], r[3]) for r in found.collect()), key=str)


def test_whole_tables_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    assert ranked(queries.op12_lexical_search(spark, sf)) == sorted(con.sql(queries.OP12).fetchall(), key=str)


@pytest.mark.parametrize("block_terms", [1, 7, 200_000])
def test_odd_rows_and_blocks(spark, block_terms):
    rows = [(0, "a b c"), (1, "A, b! ß"), (2, None), (3, ""), (4, "x" * 100_000), (5, "a " * 50_000), (None, "b c"), (6, "..."),
            (7, "b c"), (7, "b c"), (8, "b c"), (9, "É é"), (10, "b c d e f")] + [(k, "b c same") for k in range(20, 40)]
    asked = [(0, "a"), (1, "b b c"), (2, None), (3, ""), (4, "nowhere"), (5, "É ß x"), (None, "c"), (1, "same B"), (6, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS score", "3 AS item_id", "4 AS id")
    items = spark.createDataFrame(asked, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS rank", "3 AS name")
    assert ranked(lexical_search.rank(docs, items, block_terms=block_terms)) == brute(rows, asked)
    assert lexical_search.rank(docs.limit(0), items).count() == 0 == lexical_search.rank(docs, items.limit(0)).count()


def test_first_bounds_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(f"w{x}" for x in rng.zipf(1.4, rng.integers(1, 60)) % 300)) for k in range(2_000)]
    asked = [(k, " ".join(f"w{x}" for x in rng.integers(0, 300, 12))) for k in range(30)]
    docs, items = (spark.createDataFrame(r, f"{n} long, text string") for r, n in ((rows, "doc_id"), (asked, "item_id")))
    want = brute(rows, asked)
    for seeds in (50, 20_000):
        monkeypatch.setattr(lexical_search, "SEEDS", seeds)
        assert ranked(lexical_search.rank(docs, items)) == want


def test_bounds_prune_whole_batches_and_lose_nothing():
    rng = np.random.default_rng(3)
    topics = rng.integers(0, 40, 2_048)
    table = np.zeros((2_048, 400), np.int64)
    for k, topic in enumerate(topics):
        table[k, topic * 10 + rng.choice(10, 4, replace=False)] = rng.integers(1, 10**6, 4)
    items = [np.sort(rng.choice(10, 5, replace=False) + 10 * (k % 40)) for k in range(64)]
    best, met = lexical_search.Best(64, 10, np.zeros(64)), {}
    docs = lexical_search.Documents.of(table)
    lexical_search.search(lexical_search.item_tree(items), docs, best, [(False, k) for k in range(2_048)], met)
    for k, used in enumerate(items):
        scores = table[:, used].sum(1)
        want = sorted((-int(s), (False, d)) for d, s in enumerate(scores) if s > 0)[:10]
        assert best.found[k] == want
    assert met["scored"] < 0.1 * 64 * 2_048 and met["bounds"] < 64 * 2_048 / 16
    for level, wide in zip(docs.levels[1:], docs.levels):
        assert all((level[i] == wide[i * 8 : i * 8 + 8].max(0)).all() for i in range(len(level)))
