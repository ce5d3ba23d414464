"""The pipeline's stages, each against brute force on its own input."""

import random

import corpus_pipeline
import pytest
from test_line_dedup import brute as brute_lines
from test_near_dedup import brute as brute_near
from test_scans import base_counts
from test_tokens_packing import check_pieces

from colonnade.llm import decontaminate, queries
from colonnade.session import stage


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = [queries.table(spark, sf, "documents")]
    for _, step in corpus_pipeline.STAGES:
        docs.append(stage(step(spark, docs[-1], sf)))
    return docs


def texts(frame):
    rows = frame.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r.text for r in rows}


def test_columns_stay(steps):
    for frame in steps[1:-1]:
        assert frame.columns == steps[0].columns


def test_quality(spark, sf, steps):
    before, after = texts(steps[0]), texts(steps[1])
    assert all(before[k] == t for k, t in after.items())
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    assert not any(base_counts(t)[-1] for t in after.values())
    good = [k for k, q in labels.items() if q == 1 and not base_counts(before[k])[-1]]
    bad = [k for k, q in labels.items() if q == 0]
    assert sum(k in after for k in good) > 0.97 * len(good) and sum(k in after for k in bad) < 0.1 * len(bad)


def test_lines(steps):
    before = texts(steps[1])
    rest = brute_lines(before, 3, 200)
    want = {k: t for k, t in rest.items() if t == before[k] or t.strip()}
    assert texts(steps[2]) == want


def test_near_duplicates(steps):
    before = texts(steps[2])
    assert texts(steps[3]) == {k: before[k] for k, (_, _, kept) in brute_near(before).items() if kept}


def test_near_duplicates_from_80_percent_on(spark, sf):
    rng, docs = random.Random(12), {}
    for k in range(0, 120, 2):
        words = [f"w{rng.randint(0, 9_999)}" for _ in range(rng.randint(100, 300))]
        docs[k] = " ".join(words)
        # A stretch of other words takes its shingles and those across both its ends: a similarity of 0.70 to 0.95.
        share = rng.uniform(0.025, 0.17)
        at, length = len(words) // 3, max(1, int(share * len(words)) - 4)
        docs[k + 1] = " ".join([*words[:at], *(f"x{k}y{n}" for n in range(length)), *words[at + length :]])
    want = {k for k, (_, _, kept) in brute_near(docs, 80).items() if kept}
    assert want < {k for k, (_, _, kept) in brute_near(docs).items() if kept}
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string"), sf)
    assert {r.doc_id for r in left.collect()} == want


def test_near_duplicates_leave_one_of_repeated_rows(spark, sf):
    rows = [(1, "the same row again and again")] * 9 + [(None, "a text whose ids are lost")] * 9 + [(2, "one of its kind")]
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(set(rows), key=repr)


def test_benchmark(spark, sf, steps):
    before, after = texts(steps[3]), texts(steps[4])
    items = queries.table(spark, sf, "benchmark")
    windows = decontaminate.ItemWindows([(str(r.item_id), r.text) for r in items.collect()], 10)
    cut = {k: decontaminate.without_hits(t, windows, 0.5) for k, t in before.items()}
    assert after == {k: t for k, t in cut.items() if t is not None}
    assert decontaminate.find_contamination(steps[3], items).filter("contaminated").count() > 0


def test_packing(spark, sf, steps):
    rows = steps[5].collect()
    assert check_pieces(rows, texts(steps[4]), 1024) < 0.03
    whole = corpus_pipeline.run(spark, sf)
    assert sum(r.length for r in rows) == whole.groupBy().sum("length").first()[0]
