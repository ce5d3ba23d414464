import random
from collections import Counter

import numpy as np
import pytest

from colonnade.llm import queries, substring_dedup, suffix_sort


def brute(texts, length=200):
    """{key: (bytes, spans, kept)} for (key, text) rows."""
    raw = [(k, (t or "").encode()) for k, t in texts]
    seen = Counter(r[i : i + length] for _, r in raw for i in range(len(r) - length + 1))
    out = []
    for key, r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[:-1], [0]]).astype(int)))
        spans = [tuple(e) for e in edge.reshape(-1, 2).tolist()]
        out.append((key, len(r), spans, bytes(np.frombuffer(r, np.uint8)[~gone[: len(r)]])))
    return out


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


def found(rows):
    return [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows]


def made(seed, length):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(200)]
    passage = " ".join(rng.choices(words, k=length))
    texts = []
    for _ in range(12):
        base = " ".join(rng.choices(words, k=rng.randint(0, 3 * length)))
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            cut = base.split(" ")
            for _ in range(rng.randint(0, 3)):
                cut[rng.randrange(len(cut))] = rng.choice(words)
            texts.append(" ".join(cut))
        texts.append(rng.choice(words) + passage[rng.randint(0, 9) :] + rng.choice(words))
    texts += ["ab" * 3 * length, "ab" * length + "x" + "ab" * length, "a" * (length - 1), "a" * length, "a" * (length + 1), None, "", texts[0], texts[0]]
    return list(enumerate(texts))


@pytest.mark.parametrize("hot, broadcast", [(20_000, 1 << 20), (3, 1 << 20), (20_000, 0), (3, 0)])
@pytest.mark.parametrize("length", [20, 50])
def test_made_texts(spark, hot, broadcast, length):
    texts = made(length, length)
    got = substring_dedup.find_repeats(frame(spark, texts), length, hot, broadcast).collect()
    assert sorted(found(got)) == sorted(brute(texts, length))


def test_large_groups_are_cut(spark):
    """Copies that differ in a word each, with groups that fit only when cut to the finest."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 90, 4)] * 2
    texts += [" ".join(base[k : k + 50]) for k in range(0, 40, 3)] + ["own " * 9 + "text", None]
    rows = list(enumerate(texts))
    got = substring_dedup.find_repeats(frame(spark, rows), 200, hot=2).collect()
    assert sorted(found(got)) == sorted(brute(rows))


@pytest.mark.parametrize("width", [1, 3, 24])
def test_parts_hold_every_string_once(width):
    rng = random.Random(width)
    length, seen = 40, Counter()
    for _ in range(30):
        before, after = rng.randint(0, 24), rng.randint(0, 24)
        after = max(after, length - before)
        context = bytes(rng.choices(b"ab", k=before + after))
        strings = [context[at : at + length] for at in range(len(context) - length + 1)]
        cut = []
        for _, ahead, part in substring_dedup.parts(before, context, length, width):
            cut += [part[at : at + length] for at in range(len(part) - length + 1)]
            assert len(part) - length < width and ahead <= before
        assert Counter(cut) == Counter(strings)


def test_documents(spark, sf):
    texts = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    got = substring_dedup.find_repeats(queries.table(spark, sf, "documents")).collect()
    assert sorted(found(got)) == sorted(brute(texts))
    assert sum(len(r.spans) for r in got) > 10


def test_odd_rows(spark):
    rows = [(None, "x" * 300, 1), (1, "y" * 199, 2), (1, "z" * 10 + "long tail " * 30, 3), (None, None, 4), (2, "Z" + "long tail " * 30, 5)]
    docs = frame(spark, rows, ", spans long")
    got = substring_dedup.find_repeats(docs)
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept"]
    assert sorted(found(got.collect()), key=repr) == sorted(brute([r[:2] for r in rows]), key=repr)
    assert substring_dedup.find_repeats(docs.limit(0)).count() == 0


def test_segments(monkeypatch):
    text = bytes(random.Random(2).choices(b"abc", k=9_000))
    whole = substring_dedup.anchors(text, 40)
    monkeypatch.setattr(substring_dedup, "_SEGMENT", 1_000)
    split = substring_dedup.anchors(text, 40)

    def starts(a):
        return {s: (h, p) for h, p, x, y in zip(*(v.tolist() for v in a)) for s in range(x, y + 1)}

    assert starts(whole) == starts(split) and len(starts(whole)) == 9_000 - 39


def test_sorting():
    rng = random.Random(8)
    for _ in range(60):
        start = bytes(rng.choices(b"ab", k=rng.randint(0, 90)))
        keys = [start[: rng.randint(0, len(start))] + bytes(rng.choices(b"ab\x00\xff", k=rng.randint(0, 60))) for _ in range(rng.randint(0, 40))]
        keys += rng.choices(keys, k=5) if keys else []
        order, shared = suffix_sort.sorted_with_shared(keys)
        assert [keys[k] for k in order] == sorted(keys) and sorted(order) == list(range(len(keys)))
        for (a, b), n in zip(zip(order, order[1:]), shared):
            a, b = keys[a], keys[b]
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_many_contexts_as_few(monkeypatch):
    rng = random.Random(3)
    contexts, before = [], []
    for _ in range(120):
        a, b = rng.randint(0, 30), rng.randint(10, 24)
        contexts.append(bytes(rng.choices(b"ab", weights=[9, 1], k=a)) + b"ANCHOR" + bytes(rng.choices(b"ab", weights=[9, 1], k=b)))
        before.append(a)
    contexts, before = zip(*dict.fromkeys(zip(contexts, before)))
    got = substring_dedup.resolve(list(contexts), list(before), 30)
    for i, reach in enumerate(got):
        best = [-1, -1]
        for j in range(len(contexts)):
            if i != j:
                x, y = contexts[i], contexts[j]
                left = suffix_sort.common(x[: before[i]][::-1], y[: before[j]][::-1])
                right = suffix_sort.common(x[before[i] :], y[before[j] :])
                if left + right >= 30:
                    best = [max(best[0], left), max(best[1], right)]
        assert reach == (tuple(best) if best[0] >= 0 else None)
