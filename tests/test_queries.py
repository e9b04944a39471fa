"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from vellumen.plans.catalogue import QUERIES, SQL, UNREGISTERED, UNREGISTERED_SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def nothing_below_the_working_folder():
    """No query writes where it happens to be started."""
    before = set(os.listdir())
    yield
    assert set(os.listdir()) - before <= {"spark-warehouse", ".pytest_cache"}


def plain(rows):
    return sorted(tuple(repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES | UNREGISTERED))
def test_query(spark, duck, name):
    df = (QUERIES | UNREGISTERED)[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name in SQL | UNREGISTERED_SQL:
        found = duck.sql((SQL | UNREGISTERED_SQL)[name])
        assert sorted(found.columns) == columns
        places = [found.columns.index(c) for c in columns]
        assert plain(rows) == plain([tuple(r[i] for i in places) for r in found.fetchall()])
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
