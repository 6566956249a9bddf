"""Compare a Spark query with its SQL in DuckDB over one data folder."""

import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def same(df, con, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want = rows_of([c[0] for c in found.description], found.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
