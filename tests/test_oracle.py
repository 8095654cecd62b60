"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01)."""

import pytest

from tests.conftest import SF_SMALL

duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tools.check_oracle import TABLES, rows_of  # noqa: E402

SQL = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_is_registered_with_a_callable():
    assert len(QUERIES) >= 100
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    a, ac = rows_of(df.columns, df.collect())
    cur = con.execute(SQL[name])
    b, bc = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert ac == bc
    assert sorted(a, key=repr) == sorted(b, key=repr)


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns[:2] == ["id_nda", "j1"]
    df.collect()
