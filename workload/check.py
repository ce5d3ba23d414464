"""Compare every registered query with its SQL on the same tables: `python -m workload.check SF_DIR [names]`."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple((type(_plain(r[i])).__name__, _plain(r[i])) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got_columns, got = normal_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    want_columns, want = normal_rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; only ours {[r for r in got if r not in want][:2]}; only SQL {[r for r in want if r not in got][:2]}"
    odd = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(odd)} rows differ, first {odd[0]}" if odd else None


def main(argv: list[str]) -> int:
    from colonnade.session import build_session
    from workload.registry import ORACLE, QUERIES

    sf, wanted = argv[0], argv[1:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in ORACLE:
                verdict = compare(df, con, ORACLE[name]) or "ok"
            else:
                verdict = f"rows only: {df.count()}"
        except Exception as e:
            verdict = "ERROR " + "".join(traceback.format_exception_only(e))[:700]
        if verdict != "ok" and not verdict.startswith("rows only"):
            bad += 1
        print(f"{name:28s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{bad} bad of {len(wanted) or len(QUERIES)}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
