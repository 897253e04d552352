"""Every catalogue query with SQL against that SQL, on the smallest tables."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from clickloom.plans.catalogue import QUERIES
from clickloom.plans.oracles import ORACLES
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def normal(frame):
    columns = sorted(frame.columns)

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return columns, sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(ORACLES) == {"gbt_ctr"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sql, name):
    got = normal(QUERIES[name](spark, SMALL).toPandas())
    assert got == normal(sql.execute(ORACLES[name]).df())


def test_entry(spark):
    assert entry(spark).count() == 15
