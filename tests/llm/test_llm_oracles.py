from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from affinis.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted((tuple(None if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)
    assert plain(got) == plain(want)
