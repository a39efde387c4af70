"""The registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from rowlens.plans import queries as views

SF = "/root/testdata/sf0.001"
NAMES = sorted(views.queries())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(str(x) for x in r) for r in df.itertuples(index=False)))


def test_every_view_query_has_sql():
    assert set(views.oracle_sql()) == set(NAMES)


def test_the_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    mine, theirs = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
