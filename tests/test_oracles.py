"""Every core query with SQL gives what DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from tidegauge.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _rows(df, columns):
    def value(x):
        if x is None or x != x or str(x) in ("NaT", "<NA>"):
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        try:
            return round(float(x), 5)
        except (TypeError, ValueError):
            return str(x)[:10] if hasattr(x, "year") else str(x)

    return sorted((tuple(value(v) for v in r) for r in df[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = _rows(got, columns), _rows(want, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-5 * max(1, abs(v))), (x, y)
