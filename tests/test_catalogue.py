import duckdb
import pytest

import __spark_entry__ as entry
from terraloom.plans import catalogue, formats  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    found = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    cursor = db.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    assert found == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
