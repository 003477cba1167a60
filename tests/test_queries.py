"""Each registered query of the site operators against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from pagesift.plans import registry

DATA = "/root/testdata/sf0.001"


def told(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


#: Queries that SQL can't state on whole tables, with the test that holds them against brute force.
BRUTE_FORCE = {"graph_pagerank": "test_whole_job.test_graph_ranks_settle", "diverse_order": "test_scheduling.test_query_in_the_order_of_picks"}


def test_every_query_is_held_against_something():
    assert set(registry.QUERIES) == set(registry.SQL) | set(BRUTE_FORCE)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(told(r[c]) for c in columns) for r in df.collect())
    want = duck.sql(registry.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(told(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_registration_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and len(e.oracle_sql()) > 150"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
