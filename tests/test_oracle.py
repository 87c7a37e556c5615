"""Every query of the catalog against its SQL on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row

from spanloom.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and math.isnan(v)):
        return None
    if isinstance(v, (float, np.floating)):
        return f"{float(v):.8g}"
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return f"{float(v):.8g}"
    if isinstance(v, Row):
        v = v.asDict()
    if isinstance(v, dict):  # the names of fields count, as they do for the driver
        return tuple((k if isinstance(k, str) else plain(k), plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_signed_rank_has_all_rows(spark, duck):
    got = QUERIES["a69_signed_rank"](spark, SF).toPandas()
    assert got["n"].sum() == duck.sql("SELECT count(*) FROM lineitem WHERE l_quantity IS NOT NULL").df().iloc[0, 0]
