"""Queries that SQL can express, against that SQL on the small tables."""

import duckdb
import pytest

from clickloom.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SMALL).toPandas()[list(want.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))
