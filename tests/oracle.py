"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf_dir) / t}.parquet'")
    return con


def _plain(value):
    value = float(value) if isinstance(value, Decimal) else value
    return None if isinstance(value, float) and math.isnan(value) else value


def _key(row: tuple) -> tuple[str, str]:
    """Numbers are compared last, rounded, so that those that differ in their last digits meet."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return repr([x for x in row if not number(x)]), repr([round(float(x), 4) + 0.0 for x in row if number(x)])


def rows(columns, data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=_key)


def compare(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    result = connect(sf_dir).execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, result.fetchall())
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w and not all(a == b or (isinstance(a, (int, float)) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)) for a, b in zip(g, w, strict=True))]
    assert not bad, bad[:3]
