import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colonnade.functions.components import connected
from colonnade.operators import label_links, quality
from test_quality import distance


@pytest.mark.parametrize("seed, alphabet", [(1, "ab"), (2, "abc"), (3, "aab"), (4, "abcd")])
def test_signed_counts_equal_brute_force(seed, alphabet):
    """Dense sets of short words, where all ways to be close overlap."""
    rng = random.Random(seed)
    pool = sorted({"".join(t) for n in range(2, 7 if len(alphabet) < 3 else 6) for t in itertools.product(alphabet, repeat=n)})
    for size in (10, 60, 130):
        labels = rng.sample(pool, min(len(pool), size))
        table = Counter(key for a in labels for key in label_links.entries(a))
        for a in labels:
            signs, constant = label_links.links(a)
            close = {b for b in labels if b != a and distance(a, b) <= 2}
            assert sum(s * table[k] for k, s in signs.items()) + constant == len(close)
        sets = {}
        for a in labels:
            for base, key in label_links.ties(a):
                sets.setdefault(key, [set(), False])
                sets[key][0].add(a)
                sets[key][1] |= base
        tied = {frozenset((a, b)) for members, base in sets.values() if base for a in members for b in members if a != b}
        # Members of a valid set are connected: each is close to one of the kind it asks for.
        grown = grouped(labels, lambda a, b: distance(a, b) <= 2)
        assert grown == grouped(labels, lambda a, b: frozenset((a, b)) in tied)


@pytest.mark.parametrize("seed", range(4))
def test_only_lengths_that_are_there_are_asked_for(seed):
    rng = random.Random(seed)
    pool = ["".join(t) for n in rng.sample(range(5, 9), 1 + seed % 3) for t in itertools.product("ab", repeat=n)]
    labels = rng.sample(pool, min(len(pool), 60))
    lengths = {len(a) for a in labels}
    table = Counter(key for a in labels for key in label_links.entries(a))
    sets = {}
    for a in labels:
        signs, constant = label_links.links(a, lengths)
        assert sum(s * table[k] for k, s in signs.items()) + constant == sum(1 <= distance(a, b) <= 2 for b in labels)
        for base, key in label_links.ties(a, lengths):
            sets.setdefault(key, [set(), False])
            sets[key][0].add(a)
            sets[key][1] |= base
    tied = {frozenset((a, b)) for members, base in sets.values() if base for a in members for b in members if a != b}
    assert grouped(labels, lambda a, b: distance(a, b) <= 2) == grouped(labels, lambda a, b: frozenset((a, b)) in tied)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_are_never_broadcast(spark):
    """A small file of labels makes a table of counts of a thousand times its size."""
    names = spark.range(300).selectExpr("format_string('Customer#%09d', id) AS label")
    found = label_links.linked(quality.label_counts(names, ["label"]))
    plan = plan_of(label_links.link_counts(found))
    # One row a column alone: the lengths of its labels, on both sides of the join.
    assert plan.count("SortMergeJoin") >= 2 and plan.count("BroadcastExchange") <= 2
    assert "BroadcastExchange" not in plan_of(label_links.groups(found))


def grouped(labels, close):
    root = {a: a for a in labels}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(labels, 2):
        if close(a, b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {a: find(a) for a in labels}


@pytest.fixture(scope="module")
def words():
    rng = random.Random(7)
    out = {f"Item#{k:03d}" for k in range(60)} | {"only one", "tiny", "ti", ""}
    for stem in ("ventilator", "x" * 31, "a label of thirty-one letters..", "much longer labels, " * 4):
        for _ in range(25):
            t = list(stem)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t)) : rng.randrange(len(t)) + 1] = rng.choice(["", "q", "qr"]) if rng.random() < 0.1 else t[:0]
                t.insert(rng.randrange(len(t) + 1), rng.choice("xyz"))
            out.add("".join(t)[: len(stem) + 3])
    return sorted(out)


def test_counts_groups_and_first_pairs(spark, words):
    rows = [("w", a, 1 + len(a) % 4, 0) for a in words] + [("v", a, 2, 1) for a in words[:20]]
    labels = spark.createDataFrame(rows, "column string, label string, n long, ordinal int")
    found = label_links.linked(labels)
    got = {(r["column"], r["label"]): r for r in label_links.link_counts(found).join(label_links.groups(found), "id").collect()}
    for column in ("w", "v"):
        mine = [r[1] for r in rows if r[0] == column and len(r[1]) >= 5]
        close = {a: [b for b in mine if b != a and distance(a, b) <= 2] for a in mine}
        root = grouped(mine, lambda a, b: b in close[a])
        sizes = Counter(root.values())
        want = {(a, len(c), root[a], sizes[root[a]]) for a, c in close.items() if c}
        assert {(r.label, r.links, r["first"], r["size"]) for k, r in got.items() if k[0] == column} == want
    for limit in (1, 5, 12):
        some = [tuple(r) for r in label_links.first_pairs(found, limit).collect()]
        assert some == [tuple(r) for r in quality.near_pairs(labels, limit).collect()]


def test_no_pairs_are_formed(spark):
    """Two thousand names in sequence have hundreds of thousands of pairs; the plan joins counts, not names."""
    names = spark.range(2_000).selectExpr("format_string('N%05d', id) AS label")
    found = label_links.linked(quality.label_counts(names, ["label"]))
    total = label_links.link_counts(found).agg(F.sum("links")).first()[0]
    assert total > 200_000 and found.ties.count() < 2_000 * 40
    some = label_links.link_counts(found).where("label = 'N00500'").first()["links"]
    assert some == sum(1 <= distance("N00500", f"N{k:05d}") <= 2 for k in range(2_000))


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(70)] + [(1_000, k) for k in range(200, 260)] + [(5_000, 5_000), (7, 7)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 71)} | {k: 200 for k in [*range(201, 260), 1_000]}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nothing_to_count(spark):
    empty = spark.createDataFrame([], "label string, other int")
    assert label_links.near_duplicate_link_counts(empty).count() == 0
    assert label_links.near_duplicate_link_counts(spark.createDataFrame([(None,), ("",), ("ab",)], "label string")).count() == 0
