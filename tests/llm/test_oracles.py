import duckdb
import pytest

import __spark_entry__ as entry
from terraloom.llm import oracles


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    names = sorted(df.columns)
    cursor = db.execute(oracles.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())


def test_every_operator_has_one_query():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
