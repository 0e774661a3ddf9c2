"""Compare registered queries with their SQL in DuckDB.

``python -m tests.oracle [name …]`` prints one line per query; the folder comes from SF_DIR.
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def key(row):
    return tuple((v is not None, str(v) if isinstance(v, (tuple, dict)) else v) for v in row)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(shaped, key=key)


def compare(spark, sf_dir: str, name: str, db=None) -> tuple[str, int, float, float]:
    from trendloom.plans import QUERIES, SQL

    start = time.time()
    frame = QUERIES[name](spark, sf_dir)
    got = table(frame.columns, [tuple(r) for r in frame.collect()])
    mine = time.time() - start
    if name not in SQL:
        return "no sql", len(got[1]), mine, 0.0
    start = time.time()
    cursor = (db or connect(sf_dir)).execute(SQL[name])
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    theirs = time.time() - start
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1]), mine, theirs
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}", len(got[1]), mine, theirs
    for a, b in zip(got[1], want[1]):
        if a != b or any(type(x) is not type(y) for x, y in zip(a, b)):
            return f"{a} != {b}"[:600], len(got[1]), mine, theirs
    return "ok", len(got[1]), mine, theirs


def main(names: list[str]) -> int:
    from trendloom.plans import QUERIES
    from trendloom.session import local_session

    spark = local_session()
    db = connect(SF_DIR)
    bad = 0
    for name in names or list(QUERIES):
        try:
            verdict, rows, mine, theirs = compare(spark, SF_DIR, name, db)
        except Exception as error:  # report and go on with the next query
            verdict, rows, mine, theirs = f"{type(error).__name__}: {error}"[:1500], 0, 0, 0
        bad += verdict not in ("ok", "no sql")
        print(f"{name:36s} {rows:7d} {mine:6.1f}s {theirs:6.1f}s {verdict}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
