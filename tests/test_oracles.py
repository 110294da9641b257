"""Every core query that has SQL, against DuckDB on the same files."""

import duckdb
import pytest

from arborstream.queries import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(name, spark, sf, duck):
    got = queries()[name](spark, sf).toPandas()
    want = duck.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = [sorted(map(repr, zip(*[d[c].tolist() for c in cols]))) for d in (got, want)]
    assert rows[0] == rows[1]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
