"""Compares a Spark result with DuckDB's on the same tables."""

import math
from pathlib import Path


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, bool):
        return v
    return v


def same(df, sql, sf):
    table = duck(sf).sql(sql).to_arrow_table()
    assert sorted(df.columns) == sorted(table.column_names)
    names = sorted(df.columns)
    key = lambda rows: sorted((tuple(plain(x) for x in r) for r in rows), key=repr)
    got = key(df.select(*(f"`{c}`" for c in names)).collect())
    want = key(zip(*(table[c].to_pylist() for c in names), strict=True))
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, next((a, b) for a, b in zip(got, want, strict=True) if a != b)
