"""Every raster query equals its SQL over the smallest tables."""

import duckdb
import pytest

from bandframe.plans.oracles import ORACLES
from bandframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("orders", "embeddings", "part", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_names():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    got, wanted = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(got.columns) == columns
    text = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert text(got).equals(text(wanted))
