"""Every panel query against its SQL twin in DuckDB, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalog

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events".split()


def normal(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return v.isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


SLOW = {"train_scorer", "factor_momentum_paths", "boosted_scores", "boosted_importance", "run_trials"}  # scorers: test_boosting.py, test_panel.py


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(k for k in catalog.queries() if k not in SLOW))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = [tuple(normal(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = [tuple(normal(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert len(rows) == len(want)
    key = lambda r: [(v is None, str(v) if not isinstance(v, (int, float)) else "", v if isinstance(v, (int, float)) else 0) for v in r]
    for a, b in zip(sorted(rows, key=key), sorted(want, key=key), strict=True):
        assert all(x == y or isinstance(x, float) and abs(x - y) <= 2e-5 * max(1, abs(x)) for x, y in zip(a, b, strict=True)), (a, b)
