import random

from colonnade.operators import quality


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_pairs_equal_brute_force(spark):
    """Short and long labels, random edits of common stems, more labels than the usual cap."""
    rnd = random.Random(4)
    labels = set()
    for stem in ["alpha", "betamax", "compressor unit", "x" * 40, "pump", "of about thirty-one characters.", "a long label, " * 5]:
        for _ in range(40):
            t = list(stem)
            for _ in range(rnd.randint(0, 3)):
                where = rnd.randrange(len(t) + 1)
                kind = rnd.random()
                if kind < 0.4:
                    t.insert(where, rnd.choice("abx"))
                elif t and kind < 0.7:
                    t.pop(min(where, len(t) - 1))
                elif t:
                    t[min(where, len(t) - 1)] = rnd.choice("abx")
            labels.add("".join(t))
    labels = sorted(labels)
    df = spark.createDataFrame([(t,) for t in labels for _ in range(1 + len(t) % 3)], "label string")
    found = quality.near_duplicate_labels(df).collect()
    got = {(frozenset((r["a"], r["b"])), r["edits"]) for r in found}
    want = {
        (frozenset((a, b)), distance(a, b))
        for i, a in enumerate(labels) for b in labels[i + 1:]
        if min(len(a), len(b)) >= 5 and distance(a, b) <= 2
    }
    assert got == want and len(found) == len(got) > 50
    assert all((-r["rows_a"], r["a"]) < (-r["rows_b"], r["b"]) for r in found)


def test_no_label_is_too_many(spark):
    made = [f"Chemical{i:03d}" for i in range(81)] + ["Furnace", "Furnac"]
    pairs = quality.near_duplicate_labels(spark.createDataFrame([(x,) for x in made], "label string"))
    assert pairs.where("b = 'Furnace' or a = 'Furnace'").count() == 1
    twenty = spark.createDataFrame([(f"label{i:02d}",) for i in range(20)], "label string")
    assert quality.near_duplicate_labels(twenty).count() == 190
    assert quality.near_duplicate_labels(twenty, limit=5).count() == 5


def test_a_common_start_is_no_block(spark):
    names = spark.range(400).selectExpr("format_string('Customer#%09d', id) AS label")
    marks = quality._deletions(names.selectExpr("'c' AS column", "label"))
    met = marks.alias("x").join(marks.alias("y"), ["column", "mark"]).where("x.label < y.label")
    true = quality.near_duplicate_labels(names).count()
    assert true < met.select("x.label", "y.label").distinct().count() < 6 * true


def test_marks_are_never_broadcast(spark):
    """A small file of labels makes marks of a thousand times its size, which no estimate tells the planner."""
    names = spark.range(400).selectExpr("format_string('Customer#%09d', id) AS label")
    plan = quality.near_duplicate_labels(names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 4 and "Broadcast" not in plan


def test_rating(spark):
    nulls = spark.createDataFrame([("a",)], "column string")
    spikes = spark.createDataFrame([("a", 4.0), ("b", 5.0)], "column string, distance_iqr double")
    labels = spark.createDataFrame([], "column string")
    row = quality.quality_rating("d", nulls, spikes, labels).first()
    assert (row["severe"], row["moderate"], row["issues"], row["rating"]) == (0, 2, 2, "Medium")
    clean = quality.quality_rating("d", nulls.limit(0), spikes.limit(0), labels).first()
    assert (clean["issues"], clean["rating"]) == (0, "High")
    severe = spikes.selectExpr("column", "distance_iqr + 1.1 AS distance_iqr")
    assert quality.quality_rating("d", nulls, severe, labels).first()["rating"] == "Low"
