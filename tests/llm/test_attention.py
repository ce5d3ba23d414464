import zlib

import numpy as np
import pytest

from colonnade.llm import attention, queries

ODD = [None, "", "x", "a b", "é" * 900, "word " * 5_000, "long text without end " * 60_000]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_attention_quality(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").collect()
    assert len(rows) == 399
    tested = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in tested]) > 0.93


def test_gradients_are_those_of_small_steps():
    model = attention.Attention.fresh(3)
    model.values = {k: v.astype(np.float64) + 0.01 for k, v in model.values.items()}
    x, starts = attention.passages([b"some words here " * 100, b"", b"other text" * 120])
    x, labels, share = x.astype(np.float64), np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3])

    def loss():
        f = model.encode(x)
        p = model.pool(f["h"], f["e"], starts)["score"]
        return -(share * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum()

    found = model.gradients(x, starts, labels, share)
    rng = np.random.default_rng(1)
    for name, g in found.items():
        for place in rng.integers(0, g.size, 5):
            flat = model.values[name].reshape(-1)
            old = flat[place]
            flat[place] = old + 1e-5
            up = loss()
            flat[place] = old - 1e-5
            down = loss()
            flat[place] = old
            assert g.reshape(-1)[place] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_blocks_do_not_matter():
    texts = [b"abc def " * 300, b"", b"xyz " * 400_000]
    model = attention.Attention.fresh(2)
    x, starts = attention.passages(texts)
    f = model.encode(x)
    assert np.allclose(model.pool(f["h"], f["e"], starts)["score"], model.score(texts)["score"], atol=1e-5)


def test_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "x"), (2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS label")
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (None, 1)], "doc_id long, quality int")
    got = attention.score(docs, attention.train(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1)}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    model = attention.train(docs, labels.limit(0))
    assert attention.score(docs.limit(0), model).count() == 0 and attention.score(docs, model).count() == len(rows)
