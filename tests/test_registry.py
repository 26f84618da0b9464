"""Every query runs, and gives the rows of its SQL twin."""

import datetime
import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from quillspark.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5)
    return str(pd.Timestamp(v).tz_localize(None)) if isinstance(v, (datetime.date, pd.Timestamp)) else v


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return list(pdf.columns), sorted((tuple(map(plain, r)) for r in pdf.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    got = rows(QUERIES[name](spark, sf).toPandas())
    if name in ORACLES:
        assert got == rows(duck.execute(ORACLES[name]).df())
    else:
        assert got[1]
