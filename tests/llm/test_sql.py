"""Every registered query of the subpackage against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from paraloom.llm import queries
from tests.test_queries import SF, TABLES, rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, expected = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(expected.columns, expected.fetchall())
