"""Compare registered queries with their SQL on DuckDB.

``python -m tests.oracle [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark_df, db, sql: str) -> str:
    """Empty text when both sides give the same rows, else the difference."""
    result = db.execute(sql)
    names = [c[0] for c in result.description]
    want = rows_of(names, result.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if got == want:
        return ""
    extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return f"rows {len(got)} vs {len(want)}\n   spark: {extra[:3]}\n   sql:   {missing[:3]}"


def main() -> int:
    from oreflow.catalog import QUERIES, SQL
    from oreflow.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark, db, bad = local_session("oracle"), connect(folder), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in wanted:
        begin = time.time()
        try:
            frame = QUERIES[name](spark, folder)
            note = compare(frame, db, SQL[name]) if name in SQL else f"no sql, {frame.count()} rows"
        except Exception as error:  # noqa: BLE001
            note = f"error {type(error).__name__}: {str(error)[:400]}"
        failed = bool(note) and not note.startswith("no sql")
        bad += failed
        print(f"{'FAIL' if failed else 'ok  '} {name} {time.time() - begin:.1f}s {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
