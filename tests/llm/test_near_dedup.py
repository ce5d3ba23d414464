import math
import random

import numpy as np
import pytest

from colonnade.llm import components, near_dedup, queries
from workload.check import compare, connect


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, percent=85):
    """{id: (shingles, component, kept)}"""
    sets = {k: sets_of(t) for k, t in docs.items()}
    root = {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in docs}


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else rng.choice(["new", "odd", "word", str(rng.random())]) for w in words)


@pytest.fixture(scope="module")
def family():
    """Texts in families of growing distance, copies, a chain, shorts and empties."""
    rng = random.Random(4)
    docs, key = {}, 0
    for _ in range(6):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 4) + str(rng.randint(0, 99)) for _ in range(rng.randint(40, 300))]
        for k in range(25):
            docs[key] = edited(rng, base, k * 0.002)
            key += 1
        docs[key], docs[key + 1] = " ".join(base).upper(), "\t\n" + "\x0b".join(base)
        key += 2
    chain = [f"w{i}" for i in range(200)]
    for k in range(30):
        docs[key] = " ".join(chain[k : k + 170])
        key += 1
    for t in [None, "", "   ", "one", "ONE", "one two three four", "one two three four five", "x " * 5_000, "x " * 6_000, "é è", "É è"]:
        docs[key] = t
        key += 1
    return docs


@pytest.mark.parametrize("block, broadcast", [(1_000, 1 << 20), (7, 0)])
def test_families(spark, family, monkeypatch, block, broadcast):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    got = near_dedup.near_duplicates(frame(spark, list(family.items())), broadcast_rows=broadcast).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(family)


def test_odd_rows(spark):
    text = "some words that are the same in each of them"
    rows = [(7, text, 1), (None, text, 2), (3, text.upper(), 3), (3, "other", 4), (3, "other", 5), (None, "alone", 6), (9, None, 7)]
    docs = frame(spark, rows, ", component_id long")
    got = near_dedup.near_duplicates(docs).drop("mark").collect()
    want = [(7, 6, 3, False), (None, 6, 3, False), (3, 6, 3, True), (3, 1, 3, True), (3, 1, 3, True), (None, 1, None, True), (9, 0, 9, True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.component_id for r in left.collect()) == [3, 4, 5, 6, 7]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_one_row_of_each_component(spark, broadcast):
    text, far = "some words that are the same in each of them", "quite another text of which nobody knows the id"
    words = [f"v{k}" for k in range(100)]
    near = [" ".join(words), " ".join([*words, "more"]), " ".join(["less", *words])]
    rows = [(7, text, 1), (None, text, 1), (3, text.upper(), 1), (3, text.upper(), 1), (3, text, 1)]
    rows += [(None, far, 2)] * 40 + [(None, t, 3) for t in near] + [(None, near[0], 3)]
    rows += [(5, "said twice", 4), (5, "said twice", 4), (5, "said once", 5), (6, None, 6), (6, None, 6), (None, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `component.id` long").repartition(5)
    left = near_dedup.drop_near_duplicates(docs, broadcast_rows=broadcast, one_row=True)
    assert left.columns == docs.columns
    got = left.collect()
    assert sorted(r[2] for r in got) == [1, 2, 3, 4, 5, 6, 6, 7]
    assert all(tuple(r) in rows for r in got) and {r.doc_id for r in got if r[2] == 1} == {3}
    unlike = docs.filter("doc_id = 5 and text = 'said once'")
    assert near_dedup.drop_near_duplicates(unlike, one_row=True).collect() == unlike.collect()


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(3)
    for parts, distance, chunks in ((64, 20, 16), (12, 5, 3), (10, 7, 4), (9, 2, 4)):
        patterns = near_dedup.chunk_patterns(parts, distance, chunks)
        for _ in range(2_000):
            wrong = set(rng.choice(parts, rng.integers(0, distance + 1), replace=False).tolist())
            assert any(not wrong & set(p) for p in patterns)


def test_the_distance_follows_the_threshold(spark):
    for percent in range(40, 100, 5):
        distance, p = near_dedup.distance_for(percent), 1 - percent / 100
        assert sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(distance + 1, 65)) <= near_dedup.MISSED
    assert (near_dedup.distance_for(85), near_dedup.distance_for(80), near_dedup.distance_for(100)) == (20, 25, 0)
    with pytest.raises(ValueError):
        near_dedup.distance_for(0)
    rng, docs = random.Random(21), {}
    for k in range(0, 160, 2):
        words = [f"w{rng.randint(0, 9_999)}" for _ in range(200)]
        docs[k], docs[k + 1] = " ".join(words), " ".join([*words[:60], *(f"x{k}y{n}" for n in range(rng.randint(22, 32))), *words[90:]])
    got = near_dedup.near_duplicates(frame(spark, list(docs.items())), percent=70).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(docs, 70)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 63, 2_000, dtype=np.uint64)
    far = [
        (near_dedup.signature(a) != near_dedup.signature(np.concatenate([a[200:], rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))).mean()
        for _ in range(40)
    ]
    assert abs(np.mean(far) - (1 - 1_800 / 2_200)) < 0.04


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(300)] + [(1_000, 1_000 + k) for k in range(1, 200)]
    edges += [(rng.randint(2_000, 2_400), rng.randint(2_000, 2_400)) for _ in range(180)] + [(5_000, 5_000)]
    rng.shuffle(edges)
    root = {n: n for e in edges for n in e}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = components.connected(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == {n: find(n) for n in root if find(n) != n}
    assert len(got) == len({r.node for r in got})


def test_sql(spark, sf):
    assert compare(queries.op5_minhash_near_dedup(spark, sf), connect(sf), queries.ORACLE["op5_minhash_near_dedup"]) is None
