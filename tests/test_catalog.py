"""Every query with a DuckDB twin gives the same rows on the smallest tables."""

import decimal
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone.plans import catalog


def plain(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating, decimal.Decimal)):
        return None if v != v else round(float(v), 5) + 0.0
    return v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(plain(v) for v in r)) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_twin(spark, data, duck, name):
    assert rows(catalog.QUERIES[name](spark, data).toPandas()) == rows(duck.execute(catalog.ORACLE_SQL[name]).df())


def test_every_twin_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
