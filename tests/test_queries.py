"""Every query with SQL against DuckDB, and every other for its rows, at the smallest size."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from pagewright.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows(d: pd.DataFrame) -> list[str]:
    d = d[sorted(d.columns)]

    def cell(x):
        if not isinstance(x, list | np.ndarray) and pd.isna(x):
            return None
        return round(float(x), 6) if isinstance(x, int | float | np.number) and not isinstance(x, bool | np.bool_) else x

    return sorted(repr([cell(x) for x in r]) for r in d.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) and not got.columns.duplicated().any()
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
