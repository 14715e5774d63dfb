"""Every catalogue query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from verdictlake.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ["part", "events", "pages"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours = catalogue.queries()[name](spark, SF)
    theirs = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    order = sorted(columns)
    a = sorted(tuple(plain(r[c]) for c in order) for r in ours.collect())
    b = sorted(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in theirs.fetchall())
    assert a == b


def test_every_query_has_sql_but_the_iterative_one():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"user_clusters"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries())
