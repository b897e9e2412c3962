"""Compare a Spark result with DuckDB on the same parquet files."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def difference(df, con, sql: str, allow_empty: bool = False) -> str | None:
    """A description of the first difference, or None."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if not got:
        return None if allow_empty else "no rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ in {got_cols}: {bad[0][0]} != {bad[0][1]}"
    kinds_got = {c: {type(r[i]) for r in got if r[i] is not None} for i, c in enumerate(got_cols)}
    kinds_want = {c: {type(r[i]) for r in want if r[i] is not None} for i, c in enumerate(got_cols)}
    if kinds_got != kinds_want:
        return f"types {kinds_got} != {kinds_want}"
    return None
