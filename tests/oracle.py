"""Compares registered queries with their SQL in DuckDB: columns, row count and an order-insensitive comparison of values."""

from __future__ import annotations

import glob
import math
import os


def connect(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 7) + 0.0
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(frame, db, sql: str) -> list[str]:
    """What is wrong; nothing if all agrees."""
    got_names, got = frame.columns, [tuple(r) for r in frame.collect()]
    result = db.execute(sql)
    want_names, want = [c[0] for c in result.description], result.fetchall()
    if sorted(got_names) != sorted(want_names):
        return [f"columns {sorted(got_names)} and {sorted(want_names)}"]
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    out = [] if len(a) == len(b) else [f"{len(a)} and {len(b)} rows"]
    wrong = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first {wrong[0][0]} and {wrong[0][1]}")
    return out
