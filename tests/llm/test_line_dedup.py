import random

import pytest

from colonnade.llm import line_dedup, queries
from workload.check import compare, connect

BLANKS = " \t\r\x0b\x0c"


def brute(docs, size, long_line):
    """Texts without later runs; `docs` maps ids to texts."""
    seen, gone = set(), {}
    for key in sorted(docs):
        text = docs[key]
        full = [(k, x.strip(BLANKS)) for k, x in enumerate((text or "").split("\n")) if x.strip(BLANKS)]
        units = [(i, tuple(x for _, x in full[i : i + size])) for i in range(len(full) - size + 1)]
        units += [(i, (x,)) for i, (_, x) in enumerate(full) if len(x) >= long_line]
        for i, unit in sorted(set(units)):
            if unit in seen:
                gone.setdefault(key, set()).update(full[i + k][0] for k in range(len(unit)))
            seen.add(unit)
    return {
        k: t if k not in gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k]) for k, t in docs.items()
    }


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_random_lines(spark, size):
    rng = random.Random(size)
    lines = ["", " ", "a", "b", "c\r", " c", "d", "x" * 40, "y" * 41]
    docs = {k: "\n".join(rng.choices(lines, k=rng.randint(0, 14))) for k in range(60)}
    docs |= {100: None, 101: "", 102: "\n\n", 103: docs[5], 104: docs[7] + "\n", 105: "é\n" * 3_000 + docs[9], 106: "é\n" * 10}
    got = line_dedup.dedup_lines(frame(spark, list(docs.items())), size, 40)
    assert {r.doc_id: r.text for r in got.collect()} == brute(docs, size, 40)


def test_rows_and_columns_stay(spark):
    run = "one\ntwo\nthree"
    rows = [(1, run, 7, "p"), (1, run, 8, "q"), (None, run, 9, None), (2, "head\n" + run, 1, "r"), (3, run, 2, "s"), (3, None, 3, "t")]
    docs = frame(spark, rows, ", hash long, id string")
    got = line_dedup.dedup_lines(docs, count_columns=("n_lines", "n_removed"))
    assert got.columns == ["doc_id", "text", "hash", "id", "n_lines", "n_removed"]
    want = [
        (1, run, 7, "p", 3, 0), (1, run, 8, "q", 3, 0), (None, "", 9, None, 3, 3), (2, "head", 1, "r", 4, 3), (3, "", 2, "s", 3, 3),
        (3, None, 3, "t", 0, 0),
    ]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    left = line_dedup.dedup_lines(docs, drop_emptied=True)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.hash) for r in left.collect()) == [(1, 7), (1, 8), (2, 1), (3, 3)]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_sql(spark, sf):
    assert compare(queries.op3_line_dedup(spark, sf), connect(sf), queries.ORACLE["op3_line_dedup"]) is None
