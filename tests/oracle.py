"""Compares a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__module__ == "numpy" or type(v).__name__ == "Decimal":
        return f"{float(v) + 0.0:.6g}"
    return str(v)


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(tuple(cell(v) for v in r) for r in pdf[columns].astype(object).itertuples(index=False, name=None))


def assert_same(df, con, sql):
    ours, theirs = rows(df.toPandas()), rows(con.sql(sql).df())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    different = [(a, b) for a, b in zip(ours[1], theirs[1], strict=True) if a != b]
    assert not different, different[:3]
