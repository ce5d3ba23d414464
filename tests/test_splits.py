import csv
import io
import random

import pytest

from colonnade.sources import readers, splits


@pytest.fixture
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield 700
    for k, v in old.items():
        spark.conf.set(k, v)


def written(rows, header=("k", "t", "u"), newline="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=newline)
    writer.writerow(header)
    writer.writerows(rows)
    return out.getvalue()


def texts(rng, longest):
    alphabet = ['"', "\n", ",", "a", "bc", " ", '""', ',"', "é", "x" * 40]
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest)))


@pytest.mark.parametrize("seed, longest", [(1, 12), (2, 60), (3, 900)])
def test_records_over_split_bounds(spark, tmp_path, small_splits, seed, longest):
    """Quotes, line breaks and separators everywhere; values longer than several splits."""
    rng = random.Random(seed)
    rows = [(k, f"v{texts(rng, longest)}.", f"w{texts(rng, 3)}") for k in range(400 if longest < 900 else 60)]
    (tmp_path / "x.csv").write_text(written(rows))
    found = splits.Splits(spark, str(tmp_path / "x.csv"))
    assert found.count > 20 and not found.plain
    got = readers.load_csv(spark, str(tmp_path / "x.csv"))
    assert got.rdd.getNumPartitions() >= 20
    assert sorted(map(tuple, got.collect())) == rows


def test_pieces_that_the_first_pass_does_not_hold(spark, tmp_path, small_splits):
    long = "\n".join("line of a very long value" for _ in range(90_000))
    rows = [(1, "a", "b"), (2, long, "c"), (3, 'x"y', "d\ne"), (4, "f", long)]
    (tmp_path / "x.csv").write_text(written(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500000")
    assert sorted(map(tuple, readers.load_csv(spark, str(tmp_path / "x.csv")).collect())) == rows


def test_plain_files_are_left_to_the_reader(spark, tmp_path, small_splits):
    rows = [(k, f'a "{k}", b', "c") for k in range(300)]
    (tmp_path / "x.csv").write_text(written(rows))
    assert splits.Splits(spark, str(tmp_path / "x.csv")).plain
    got = readers.load_csv(spark, str(tmp_path / "x.csv"))
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == rows


def test_a_quote_inside_an_unquoted_value_opens_nothing(spark, tmp_path, small_splits):
    body = "".join(f'{k},5" pipe,"two\nlines {k}"\n{k},x,a"b"c\n' for k in range(120))
    (tmp_path / "x.csv").write_text("k,t,u\n" + body)
    got = sorted(map(tuple, readers.load_csv(spark, str(tmp_path / "x.csv")).collect()))
    assert got == sorted([(k, '5" pipe', f"two\nlines {k}") for k in range(120)] + [(k, "x", 'a"b"c') for k in range(120)])


def test_many_files_headers_and_blank_lines(spark, tmp_path, small_splits):
    folder = tmp_path / "x.csv"
    folder.mkdir()
    rng = random.Random(5)
    rows = []
    for part in range(5):
        mine = [(part * 100 + k, f"v{texts(rng, 50)}.", "w") for k in range(40)]
        rows += mine
        text = written(mine) if part else "\n \n" + written(mine)
        (folder / f"part-{part}.csv").write_text(text.replace("\n0", "\n\n0"))
    (folder / "empty.csv").write_text("")
    (folder / "header.csv").write_text("k,t,u\n")
    got = sorted(map(tuple, readers.load_csv(spark, str(folder)).collect()))
    assert [r[0] for r in got] == [r[0] for r in rows] and [r[2] for r in got] == ["w"] * len(rows)


def test_carriage_returns_and_an_open_quote_at_the_end(spark, tmp_path, small_splits):
    rows = [(k, f"two\nlines {k}", "z") for k in range(100)]
    (tmp_path / "x.csv").write_bytes(written(rows, newline="\r\n").encode() + b'100,"never closed\nmore')
    got = sorted(map(tuple, readers.load_csv(spark, str(tmp_path / "x.csv")).collect()))
    assert got[:100] == rows and got[100][0] == 100 and got[100][1].endswith("never closed\nmore")


def test_schema_and_surplus(spark, tmp_path, small_splits):
    rows = [(k, f"two\nlines {k}") for k in range(100)]
    (tmp_path / "x.csv").write_text(written(rows, ("k", "t")))
    got = readers.load_csv(spark, str(tmp_path / "x.csv"), schema="k int, t string")
    assert got.dtypes == [("k", "int"), ("t", "string")] and sorted(map(tuple, got.collect())) == rows
    (tmp_path / "y.csv").write_text(written([*rows, (1, "a\nb", 3)], ("k", "t")))
    with pytest.raises(Exception, match="more fields"):
        readers.load_csv(spark, str(tmp_path / "y.csv")).collect()


def test_states_of_lines():
    assert not splits.ends_inside('a,"b",c') and not splits.ends_inside('a"b,c') and not splits.ends_inside('""')
    assert splits.ends_inside('a,"b') and splits.ends_inside('"a","b') and splits.ends_inside('"a""') and splits.ends_inside('"')
    assert splits.ends_inside('"' + '""' * 50_000)


def test_other_splits_than_at_opening_are_noticed(spark, tmp_path, small_splits):
    (tmp_path / "x.csv").write_text(written([(k, f"two\nlines {k}", "z") for k in range(200)]))
    got = readers.load_csv(spark, str(tmp_path / "x.csv"), infer=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    with pytest.raises(Exception, match="load them again"):
        got.collect()
