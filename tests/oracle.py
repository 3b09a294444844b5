"""Runs a registered query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str):
    c = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        where = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{where}')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, f, sql, sf_dir=DATA):
    df = f(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = connect(sf_dir).execute(sql)
    theirs = rows_of([d[0] for d in found.description], found.fetchall())
    assert mine[0] == theirs[0], f"{name}: columns {mine[0]} and {theirs[0]}"
    assert len(mine[1]) == len(theirs[1]), f"{name}: {len(mine[1])} and {len(theirs[1])} rows"
    for a, b in zip(mine[1], theirs[1], strict=True):
        assert a == b, f"{name}: {a} and {b}"
    return len(mine[1])
