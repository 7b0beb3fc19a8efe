"""Compare a query's rows with those of its SQL on the same files."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, float):
        return repr(x + 0.0)
    return str(x)


def same_rows(spark, fn, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(map(_plain, r)) for r in df.select(*[f"`{n}`" for n in names]).collect())
    out = con.execute(sql)
    have = [c[0] for c in out.description]
    assert sorted(have) == names
    order = [have.index(n) for n in names]
    want = sorted(tuple(_plain(r[i]) for i in order) for r in out.fetchall())
    assert got == want
