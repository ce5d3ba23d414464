import json

import pytest

from colonnade.operators import sets
from colonnade.sources import catalog, readers, writers


def test_csv_tokens_and_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,score,note,when\n1,3.5,"a, ""b""",2020-01-01\n2,NA,n/a,2020-01-02\n3,,plain,2020-01-03\n')
    df = readers.load_by_extension(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "score": "double", "note": "string", "when": "string"}
    rows = df.orderBy("id").collect()
    assert rows[0]["note"] == 'a, "b"' and rows[1]["note"] is None and rows[1]["score"] is None


def test_long_numbers_keep_their_digits(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("id\n9007199254740993\n")
    assert readers.load_by_extension(spark, str(path)).first()["id"] == 9007199254740993


def test_json_forms(spark, tmp_path):
    records = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "t.json").write_text(json.dumps(records))
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, records)))
    whole = readers.load_by_extension(spark, str(tmp_path / "t.json"))
    lines = readers.load_json(spark, str(tmp_path / "l.json"), lines=True)
    assert sorted(whole.collect()) == sorted(lines.collect()) == [(1, "x"), (2, None)]


def test_xml(spark, tmp_path):
    path = tmp_path / "t.XML"
    path.write_text("<data><row><a>1</a><b>x</b></row><row><a>2</a><b>y</b></row></data>")
    assert sorted(map(tuple, readers.load_by_extension(spark, str(path)).collect())) == [(1, "x"), (2, "y")]


def test_unknown_extension(spark):
    for path in ("t.xlsx", "noextension", "folder.d/t"):
        with pytest.raises(readers.UnsupportedFormat):
            readers.load_by_extension(spark, path)


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b')], "a long, b string")
    for kind in ("parquet", "csv", "json"):
        path = str(tmp_path / f"out.{kind}")
        writers.write_result(df, path, kind)
        options = {"lines": True} if kind == "json" else {}
        assert [tuple(r) for r in readers.load_by_extension(spark, path, **options).select("a", "b").collect()] == [(1, 'a "q", b')]
    with pytest.raises(ValueError):
        writers.write_result(df, str(tmp_path / "x"), "pdf")


def test_preview_keeps_nulls(spark):
    df = spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    assert [r["record"] for r in writers.preview(df, "k", 2).collect()] == ['{"k":1,"v":"x"}', '{"k":2,"v":null}']


def test_first_rows_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate([None, 3, 1, 2, 2, 9, None])], "k int, v int")
    assert [r["k"] for r in writers.first_rows(df, ["k"], 4).collect()] == [None, None, 1, 2]
    assert [r["k"] for r in writers.first_rows(df, ["k"], 1).collect()] == [None]
    assert writers.first_rows(df, ["k"], 50).count() == 7


def test_catalog_hides_the_tag(spark):
    df = spark.createDataFrame([(1, "a")], "n int, _source string")
    assert [r["column"] for r in catalog.dataset_catalog({"d": df}).collect()] == ["n"]
    assert tuple(catalog.catalog_totals({"d": df, "e": df}).first()) == (2, 4, 2)


def test_views(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([(2.5, 3)], "n double, own int")
    views = sets.build_views({"a.csv": a, "b.v2.csv": b})
    assert list(views) == ["view_a", "view_b", "view_intersection"]
    (both,) = views["view_intersection"].values()
    assert sorted(map(tuple, both.collect())) == [(1.0, "a"), (2.5, "b.v2")]
    assert list(sets.build_views({"a": a, "c": b.select("own")})) == ["view_a", "view_b"]
    assert list(sets.build_views({"a": a})) == ["unified"]
    with pytest.raises(ValueError):
        sets.tagged_union(a, b.select("own"), "a", "b")


def test_raw_frames_win(spark):
    a, raw = spark.range(1), spark.range(2)
    chosen, used = sets.select_source({"a": a, "both": a}, {"a": raw})
    assert used and chosen["a"] is raw and chosen["both"] is a
    assert sets.select_source({"a": a})[1] is False
    assert sets.select_source({}, {"a": raw}) == ({"a": raw}, True)


def test_csv_keeps_its_rows(spark, tmp_path):
    rows = [(1, 'a "quoted"\nbreak, and comma'), (2, "plain"), (3, "two\n\nbreaks"), (4, "tail\n")]
    df = spark.createDataFrame(rows, "k bigint, t string")
    writers.write_result(df, str(tmp_path / "x.csv"), "csv")
    assert sorted(map(tuple, readers.load_csv(spark, str(tmp_path / "x.csv")).collect())) == rows


def test_csv_with_surplus_fields_raises(spark, tmp_path):
    (tmp_path / "short.csv").write_text("a,b\n1,2\n3\n")
    assert [tuple(r) for r in readers.load_csv(spark, str(tmp_path / "short.csv")).collect()] == [(1, 2), (3, None)]
    (tmp_path / "long.csv").write_text("a,b\n1,2\n3,4,5\n")
    for infer in (True, False):
        with pytest.raises(Exception, match="more fields"):
            readers.load_csv(spark, str(tmp_path / "long.csv"), infer=infer).select("b").collect()
