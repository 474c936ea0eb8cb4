"""Every registered catalogue query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tests.conftest import DATA
from tomewright.plans.queries import ORACLE, QUERIES

SF = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{float(value):.6f}" if isinstance(value, int | float) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    cursor = db.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(tuple(_plain(row[columns.index(c)]) for c in order) for row in cursor.fetchall())
    assert sorted(tuple(_plain(row[c]) for c in order) for row in got.collect()) == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
