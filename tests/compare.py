"""Run a query and its SQL counterpart on the same tables and compare whole results."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    flat = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(flat, key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in r)), sorted(names)


def spark_result(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def sql_result(con, sql):
    cur = con.execute(sql)
    return _rows([c[0] for c in cur.description], cur.fetchall())


def difference(df, con, sql) -> str | None:
    got, got_names = spark_result(df)
    want, want_names = sql_result(con, sql)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        only = set(got) ^ set(want)
        return f"rows {len(got)} != {len(want)}; e.g. got-only {list(set(got) - set(want))[:3]} want-only {list(set(want) - set(got))[:3]} of {len(only)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{got_names}: {g} != {w}"
        for a, b in zip(g, w):
            if a is not None and type(a) is not type(b):
                return f"{got_names}: types {g} / {w}"
    return None
