import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.llm import queries, samples, toxicity
from colonnade.llm.common import word_hashes

ODD = [None, "", "x", "a b", "é" * 900, "word " * 5_000, "no end " * 90_000, "\u0000 ퟿", "!?"]


def slots(text):
    return toxicity.slots_of(word_hashes(toxicity.words_of(text)))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op11_toxicity(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").collect()
    assert len(rows) == 3980
    tested = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.flagged == (r.score >= r.threshold) for r in rows)
    assert np.mean([r.predicted for r in tested if r.toxic]) > 0.8
    assert np.mean([r.predicted for r in tested if not r.toxic]) < 0.02


def test_gradients_are_those_of_small_steps():
    model = toxicity.Convolution.fresh(3)
    model.table, model.filters = model.table.astype(np.float64) * 5, model.filters.astype(np.float64)
    model.b, model.c = model.b.astype(np.float64) + 0.1, model.c.astype(np.float64)
    texts = [slots("one two three four two"), slots(""), slots("five six")]
    labels, share, bias = np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3]), np.array([0.3])

    def loss():
        p = 1 / (1 + np.exp(-(model.raw(texts) + bias[0])))
        return -(share * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum()

    # pooled() keeps single precision, so compare against the responses themselves.
    model.pooled = lambda t: np.stack([model.responses(*toxicity.joined([s])[::2]).max(0) for s in t])
    found = toxicity.gradients(model, texts, labels, share, bias[0])
    table = np.zeros_like(model.table)
    for k in range(toxicity.DRAWS):
        np.add.at(table, found["slots"][:, k], found["rows"])
    touched = np.unique(found["slots"])
    rng = np.random.default_rng(1)
    for name, value, grad in (("filters", model.filters, found["filters"]), ("b", model.b, found["b"]),
                              ("c", model.c, found["c"]), ("table", model.table, table), ("bias", bias, np.array([found["bias"]]))):
        places = rng.integers(0, value.size, 8)
        if name == "table":
            places = [t * toxicity.SIZE + c for t in touched[touched < toxicity.SLOTS][:4] for c in (0, 5)]
        for place in places:
            flat = value.reshape(-1)
            old = flat[place]
            flat[place] = old + 1e-6
            up = loss()
            flat[place] = old - 1e-6
            down = loss()
            flat[place] = old
            assert grad.reshape(-1)[place] == pytest.approx((up - down) / 2e-6, abs=1e-5), name


def test_stretches_and_batches_do_not_matter(monkeypatch):
    texts = [slots("a bc d e f g h i j " * 40), slots(""), slots("k"), slots("l m " * 30)]
    model = toxicity.Convolution.fresh(2)
    whole = np.stack([model.responses(*toxicity.joined([s])[::2]).max(0) for s in texts])
    for size in (7, 50, 10_000):
        monkeypatch.setattr(toxicity, "STRETCH", size)
        assert np.allclose(model.pooled(texts), whole, atol=1e-6)


def test_thresholds_split_the_best_place():
    scores, labels = np.array([0.9, 0.8, 0.4, 0.3, 0.1]), np.array([1, 1, 1, 0, 0])
    assert toxicity.best_threshold(scores, labels, np.ones(5)) == pytest.approx(0.35)
    assert toxicity.best_threshold(np.array([0.5, 0.5]), np.array([1, 0]), np.ones(2)) == pytest.approx(0.25)


def test_long_labelled_texts_are_learnt_from_whole(spark):
    filler = " ".join(f"w{k}" for k in range(6_000))
    rows = [(k, f"{filler} {'vile' if k % 2 else 'kind'} {filler}", "xx") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels, sample_words=400_000)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def marked(spark, texts=400, kinds=40):
    """Texts of thirty words; every other one holds one of forty words that no other kind has."""
    rows = [(k, " ".join(f"w{(k * 7 + j * j) % 97}" for j in range(29)) + (f" vile{k // 2 % kinds}" if k % 2 else " kind"),
             ["xx", "yy", None][k % 3]) for k in range(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(k, k % 2) for k in range(texts)], "doc_id long, toxic int")


def test_all_labelled_texts_are_learnt_from(spark):
    docs, labels = marked(spark)
    got = toxicity.score(docs, toxicity.train(docs, labels, sample_words=1_500)).collect()
    learnt = [r for r in got if not r.held_out and r.doc_id % 2]
    assert len(learnt) > 100 and np.mean([r.predicted for r in learnt]) > 0.97
    assert np.mean([r.predicted for r in got if r.doc_id % 2 == 0]) < 0.03


def test_parts_of_the_input_do_not_matter(spark):
    docs, labels = marked(spark)
    one = toxicity.train(docs, labels, sample_words=3_000)
    two = toxicity.train(docs.repartition(5, "text"), labels.repartition(3), sample_words=3_000)
    assert np.array_equal(one.table, two.table) and np.array_equal(one.filters, two.filters)
    assert (one.slope, one.shift, one.threshold, one.thresholds) == (two.slope, two.shift, two.threshold, two.thresholds)


def test_thresholds_are_those_of_all_rows_at_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    labels, langs = rng.integers(0, 2, 900), rng.choice(["a", "b", "few", "", None], 900, p=[0.4, 0.3, 0.02, 0.18, 0.1])
    scores = np.round(np.clip(rng.normal(0.4 + 0.2 * labels, 0.2), 0, 1), 2)
    scored = spark.createDataFrame(
        [(lang, int(y), float(s)) for lang, y, s in zip(langs, labels, scores)], "lang string, label int, score double"
    )
    for ranked in (200, 4):
        monkeypatch.setattr(toxicity, "RANKED", ranked)
        got = toxicity.best_thresholds(scored)
        assert set(got) == {None, "a", "b", ""}
        for lang, threshold in got.items():
            own = np.ones(900, bool) if lang is None else langs == lang
            assert threshold == pytest.approx(toxicity.best_threshold(scores[own], labels[own], np.ones(own.sum())))


def test_labels_too_many_to_broadcast_give_the_same_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(50)] + [(3, "a"), (4, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(k, k % 2) for k in range(0, 50, 3)] + [(6, 1), (9, 1), (4, 1), (12, None), (None, 1), (99, 1)], "doc_id int, toxic int"
    )
    found = []
    for most in (samples.BROADCAST_LABELS, 0):
        monkeypatch.setattr(samples, "BROADCAST_LABELS", most)
        for size in (7, 10_000):
            rows = samples.labelled_rows(docs, labels, "toxic", size, "doc_id", "text", F.col("id") < 40)
            found.append(sorted(tuple(r) for r in rows.select("id", "label", "text").collect()))
            assert samples.labelled_rows(docs.limit(0), labels, "toxic", size, "doc_id", "text").count() == 0
    assert [r[:2] for r in found[0]] == sorted([(k, k % 2) for k in range(0, 40, 3) if k != 6] + [(4, 1)])
    assert all(f == found[0] for f in found)


def test_odd_rows(spark):
    rows = [(k, t, "xx") for k, t in enumerate(ODD)] + [(None, "x", None), (2, "x", "yy"), (2, "x", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS label", "3 AS `order`")
    labels = spark.createDataFrame(
        [(1, 1), (3, 0), (4, None), (None, 1), (2, 0), (2, 0), (5, 0), (5, 1)], "doc_id long, toxic int"
    ).selectExpr("*", "1 AS text", "2 AS id")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 8)}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    model = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.score(docs, model).count() == len(rows)
