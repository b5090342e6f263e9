"""Runs a SQL twin on DuckDB and compares it with a Spark result, whatever the order of rows and columns."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def duck(sf_dir: str, sql: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet' )" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c.sql(sql).df()


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype) in ("object", "str", "string"):
            df[c] = df[c].map(lambda v: "" if v is None or v != v else str(v))
        else:
            df[c] = df[c].astype("float64").round(8)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(spark_df, sf_dir: str, sql: str) -> None:
    import pandas as pd

    a, b = normal(spark_df.toPandas()), normal(duck(sf_dir, sql))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-8)
