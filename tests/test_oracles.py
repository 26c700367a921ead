from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from affinis.plans import queries as plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    plain = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else round(float(v), 9) if isinstance(v, float) else str(v)
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, name):
    assert rows(plans.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(plans.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.ORACLES.keys()))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).columns
