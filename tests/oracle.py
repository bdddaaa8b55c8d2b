"""Rows of a Spark query against those of its SQL in DuckDB."""

import math
import os

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("nan", "<NA>", "NaT"):
        return None
    if isinstance(v, (str, bool)):
        return v
    return float(v) if hasattr(v, "__float__") else str(v)


def rows(df, columns):
    return sorted(repr([plain(v) for v in r]) for r in df[columns].astype(object).itertuples(index=False))


def expected(sql, sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c.sql(sql).df()


def same(spark, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), expected(sql, sf_dir)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
