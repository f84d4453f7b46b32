"""Compare a Spark result with DuckDB SQL on the same Parquet tables, or with expected rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())


def _plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x if isinstance(x, (bool, int, type(None))) else str(x)


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, expected = duck_rows(sql, sf_dir)
    assert sorted(df.columns) == names
    got = rows_of(df)
    assert got == expected, f"only Spark: {list((got - expected).items())[:4]}; only SQL: {list((expected - got).items())[:4]}"
