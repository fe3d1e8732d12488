"""Each registered graph query against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

from loomgraph.plans.catalog import ORACLES, QUERIES
from loomgraph.tables import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def canonical(df, columns):
    text = df[columns].astype(object).where(df[columns].notna(), None).astype(str)
    return sorted(map(tuple, text.itertuples(index=False)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_twin(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert canonical(got, columns) == canonical(want, columns)
