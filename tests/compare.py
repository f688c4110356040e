"""Holds a DataFrame against DuckDB's rows for the same tables."""

import math
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        path = f"{sf_dir}/{file}"
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, (list, dict)) else str(x)) for x in r))


def same(df, con, sql):
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, got.fetchall())
