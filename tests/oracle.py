"""Comparison of queries with their SQL on the small tables."""

import glob
import os

import duckdb
import pandas as pd

SF = os.environ.get("LARDER_TEST_DATA", "/root/testdata/sf0.001")


def connection():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


def same(spark, name, query, sql):
    a, b = query(spark, SF).toPandas(), connection().execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns), name
    assert rows(a) == rows(b), name
