import random

import numpy as np
import pyarrow as pa
import pytest

from colonnade.operators import label_arrays, label_links, quality
from colonnade.operators.label_arrays import Index, Texts, letters
from test_quality import distance


def words(seed, alphabet, length, size=150):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(alphabet) for _ in range(length)) for _ in range(size)})


@pytest.mark.parametrize("length", [5, 6, 9])
@pytest.mark.parametrize("seed, alphabet", [(1, "ab"), (2, "aab"), (3, "abcd"), (4, "0123456789"), (5, "aé\U0001f600")])
def test_each_pair_is_met_once(seed, alphabet, length):
    """Runs and alternating stretches, where a pair has several common rests, in parts as they come."""
    labels = words(seed, alphabet, length)
    ids = np.arange(len(labels))
    index, got = Index(ids, Texts(letters(labels, length))), []
    for start in range(0, len(labels), 40):
        for at, rows, edits in index.pairs(ids[start : start + 40], Texts(letters(labels[start : start + 40], length))):
            got += [(int(x), int(y) + start, edits) for x, y in zip(at, rows)]
    far = {(x, y): distance(a, b) for x, a in enumerate(labels) for y, b in enumerate(labels) if x < y}
    assert sorted(got) == sorted((*k, d) for k, d in far.items() if d <= 2)


def test_pairs_of_all_lengths_in_order_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_LEAST", 15)
    rng = random.Random(6)
    made = {w for n in (4, 5, 6, 7, 9) for w in words(n, "ab", n, 25)} | {f"No {k}" for k in range(5, 40)}
    made |= {"".join(rng.choice("xy") if rng.random() < 0.04 else c for c in stem) for stem in ("a" * 31, "b" * 32, "c" * 33, "cb" * 20) for _ in range(12)}
    made |= {"a" * 32, "a" * 33, "c" * 31}
    rows = [(k, c, a, 1 + len(a) * 7 % (3 + k)) for k, c in enumerate(("one", "two")) for a in sorted(made)[:: 1 + k]]
    labels = spark.createDataFrame(rows, "ordinal int, column string, label string, n long")
    want = []
    for k, c in enumerate(("one", "two")):
        mine = sorted([(-n, a) for o, _, a, n in rows if o == k and len(a) >= 5])
        near = [(c, a, b, -n, -m, distance(a, b)) for x, (n, a) in enumerate(mine) for m, b in mine[x + 1 :] if abs(len(a) - len(b)) <= 2]
        want += [p for p in near if p[-1] <= 2]
    assert len(want) > 500
    assert [tuple(r) for r in quality.near_pairs(labels).collect()] == want
    assert [tuple(r) for r in quality.near_pairs(labels, 7).collect()] == want[:7]
    assert quality.near_pairs(labels.limit(0)).count() == 0


def test_pairs_are_not_shuffled(spark):
    """Two thousand names have hundreds of thousands of pairs: they leave the tasks that find them in order, and names of one
    length make no marks."""
    names = spark.range(2_000).selectExpr("format_string('Customer#%09d', id) AS label")
    plan = quality.near_duplicate_labels(names)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")
    counted = quality.label_counts(names, ["label"])
    assert quality._unequal(counted, {"label": {18}}).count() == 0
    assert quality.near_duplicate_labels(names).count() > 200_000


def in_batches(batches, by, size):
    """The rows sorted, as they come to a task."""
    table = pa.Table.from_batches(list(batches))
    return table.sort_by([(c, "ascending") for c in by]).to_batches(max_chunksize=size) if table.num_rows else []


@pytest.mark.parametrize("rows, hot", [(1 << 16, 1 << 18), (60, 1 << 18), (20, 25), (1, 1)])
@pytest.mark.parametrize("alphabet", ["ab", "aab", "abcd", "0123456789"])
def test_counts_and_ties_without_pairs(monkeypatch, alphabet, rows, hot):
    """Whole buckets, buckets over many batches, and buckets too large for a task."""
    monkeypatch.setattr(label_arrays, "ROWS", rows)
    monkeypatch.setattr(label_arrays, "HOT_ROWS", hot)
    labels = [(k, a) for k, n in ((0, 6), (1, 6), (1, 8)) for a in words(7 + k, alphabet, n, 130)]
    labels += [(2, f"No. {k:03d}") for k in range(0, 130, 2)] + [(2, "alone within")]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(labels))), pa.array([o for o, _ in labels], pa.int32()), pa.array([a for _, a in labels])], ["id", "ordinal", "label"]
    )
    letters_at = {}
    for r in (r for b in label_arrays.letter_counts([batch]) for r in b.to_pylist()):
        letters_at.setdefault((r["ordinal"], r["length"]), {}).setdefault(r["place"], []).append(r["count"])
    kinds = {
        k: label_arrays.segments({i: -np.log2(sum(c * c for c in cs) / sum(cs) ** 2) for i, cs in at.items() if len(cs) > 1})
        for k, at in letters_at.items() if max(map(len, at.values())) > 1
    }
    out = list(label_arrays.rest_counts(in_batches(label_arrays.rests_of(kinds)([batch]), ["one", "two"], 17)))
    ties = {(r["id"], r["other"]) for b in out for r in b.to_pylist()}
    rooted = batch.append_column("root", batch["id"])
    buckets = in_batches(label_arrays.buckets_of(kinds)([rooted]), ["route", "mark"], 17)
    found = list(label_arrays.bucket_counts(kinds)(buckets))
    large = [b.filter(b["one"].is_valid()) for b in found]
    assert any(b.num_rows for b in large) if hot == 1 else hot < 1000 or not any(b.num_rows for b in large)
    out += [b.filter(b["one"].is_null()).select(["id", "links", "other"]) for b in found]
    out += list(label_arrays.place_counts(in_batches(large, ["one", "two"], 17)))
    links = dict.fromkeys(range(len(labels)), 0)
    for r in (r for b in out for r in b.to_pylist()):
        links[r["id"]] += r["links"] or 0
        if r["other"] is not None:
            ties.add((r["id"], r["other"]))
    close = {x: [y for y, b in enumerate(labels) if x != y and a[0] == b[0] and len(a[1]) == len(b[1]) and distance(a[1], b[1]) <= 2] for x, a in enumerate(labels)}
    assert links == {x: len(ys) for x, ys in close.items()} and sum(links.values()) > 100

    def groups(edges):
        root = list(range(len(labels)))

        def top(x):
            return x if root[x] == x else top(root[x])

        for x, y in edges:
            root[max(top(x), top(y))] = min(top(x), top(y))
        return [top(x) for x in root]

    assert groups(ties) == groups((x, y) for x, ys in close.items() for y in ys)


def test_a_label_makes_few_rows(spark):
    """Names with six digits that differ: six rests and six buckets each, where keys for two places were 740."""
    names = spark.range(3_000).selectExpr("id", "0 AS ordinal", "format_string('Customer#%09d', id * 331) AS label")
    kinds = label_links._segments(names.select("ordinal", "label"))
    assert sorted(kinds[0, 18]) == list(range(12, 18)) and set(kinds[0, 18].values()) == {0, 1, 2, 3}
    rows = names.mapInArrow(label_arrays.rests_of(kinds), "one long, two long, id long").count()
    marked = names.selectExpr("*", "id AS root").mapInArrow(label_arrays.buckets_of(kinds), "mark long, route int, ordinal int, id long, root long, label string")
    assert (rows, marked.count()) == (18_000, 18_000)
    assert not label_links._beside(names.selectExpr("*", "'c' AS column")).count()
