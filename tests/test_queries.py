"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from seshat.plans import answering, covering, figures, storing  # noqa: F401  register their queries
from seshat.plans.queries import CASE_SQL, CASES, QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events orders lineitem customer".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, (str, bool, pd.Timestamp)):
        return str(v)
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, oracle, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = oracle.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, oracle, name):
    """Operators on typed-in rows, with the values that are stated for them."""
    got = CASES[name](spark, SF).toPandas()
    if name in CASE_SQL:
        assert rows(got) == rows(oracle.sql(CASE_SQL[name]).df())
    else:
        assert len(got)
