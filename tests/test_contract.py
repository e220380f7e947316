"""Driver contract at the smallest scale: every query has a stable shape, some are compared in full."""

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from catalog.projection import BASE

SF = "/root/testdata/sf0.001"
SAMPLE = ["pipe_snapshot", "pipe_load_events", "pipe_compact", "agg_bulletin_detail", "join_filters_events", "top_search", "pipe_detect"]


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(cols, cur.fetchall())
