"""Runs a query and its SQL side by side."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.01"


def _plain(v):
    if v is None or pd.isna(v):
        return None
    return round(float(v), 9) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "item") else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in r) for r in frame[cols].astype(object).values.tolist()), key=repr)


def check(spark, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    mine, theirs = e.queries()[name](spark, SF).toPandas(), con.execute(e.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert len(mine) and rows(mine) == rows(theirs)
