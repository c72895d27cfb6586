"""Every field query against its SQL in DuckDB, over whole tables."""

import os

import duckdb
import pytest

from fieldframe.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else x
    return sorted(repr([plain(x) for x in r]) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_without_corpus_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
