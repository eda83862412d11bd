"""Comparing a Spark result with the result of its DuckDB twin."""

import math
import os

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duckdb_views(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql):
    """[] if both results hold the same columns and rows, else descriptions."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"]
    got = _sorted_rows(df.columns, df.collect())
    want = _sorted_rows(names, expected)
    if len(got) != len(want):
        return [f"rows {len(got)} / {len(want)}"]
    return [f"{g} / {w}" for g, w in zip(got, want) if g != w][:3]
