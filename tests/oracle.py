"""Holds a query's rows against its SQL in DuckDB."""

import duckdb

from tidewright.sources.tables import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet(['{sf_dir}/{t}.parquet'])")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "is_finite"):  # decimals
        return float(value)
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=str)


def same(df, con, sql):
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == b
