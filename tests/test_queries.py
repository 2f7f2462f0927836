"""Each query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomlog.plans import event_queries, trajectory_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES = {name: query for plan in entry.PLANS for name, query in plan.QUERIES.items()}
SQL = {name: sql for plan in entry.PLANS for name, sql in plan.ORACLE_SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall()]
    got = [tuple(plain(row[c]) for c in columns) for row in df.collect()]
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    assert sorted(names) == columns and sorted(got, key=key) == sorted(want, key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
    assert event_queries.kept_candidates(spark, FOLDER).count() > 0


def test_flagship_plan_stays_in_the_engine(spark):
    plan = trajectory_queries.signal_aggregates(spark, FOLDER)._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "Cartesian" not in plan
