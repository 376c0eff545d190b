"""Every registered query of the library proper against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from paraloom.plans import queries

SF = "/root/testdata/sf0.001"
#: Their bounds are for models fitted on more than the few rows of the smallest tables.
FITTED = {"pair_classifier": "/root/testdata/sf0.01", "lid_accuracy": "/root/testdata/sf0.01"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(map(repr, (tuple(plain(r[i]) for i in order) for r in values)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, FITTED.get(name, SF))
    expected = duck.sql(queries.ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(expected.columns, expected.fetchall())
