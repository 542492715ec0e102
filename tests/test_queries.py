"""Every registered query against its SQL, on whole tables, and streams against batches."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.operators.lww import latest
from tidelog.plans import registry
from tidelog.sources import views

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_query_equals_sql(spark, small, duck, name):
    got = entry.queries()[name](spark, small)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[k] for k in at]) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream_equals_batch(spark, small):
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(registry.QUERIES["stream_lww"](spark, small)) == rows(latest(views.log_events(spark, small)))


def test_equal_clocks_at_scale_resolve_alike(spark, small):
    """Rows dealt out in another order give the same winners."""
    log = views.log_lineitem(spark, small)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(latest(log)) == rows(latest(log.repartition(7, "value")))
