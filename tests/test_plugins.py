"""The SQLite source, table functions over sessions, sketches that merge."""

import random
import sqlite3
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from loomlog.operators import sketches
from loomlog.sources import plugins


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    folder = tmp_path_factory.mktemp("db")
    for name, n in (("a", 1000), ("b", 10), ("none", 0)):
        with sqlite3.connect(folder / f"{name}.sqlite") as db:
            db.execute('CREATE TABLE threads (id TEXT, updated_at INTEGER, "odd ""name" REAL, any)')
            db.executemany("INSERT INTO threads VALUES (?, ?, ?, ?)", [(f"{name}{i}", i if i % 7 else None, i / 2 if i % 3 else None, [i, str(i), None, b"x"][i % 4]) for i in range(n)])
            db.execute("DELETE FROM threads WHERE rowid % 10 = 3")
    return folder


def test_sqlite_source(spark, database):
    plugins.register(spark)
    read = lambda *names, **more: spark.read.format("sqlite").options(path=",".join(str(database / f"{n}.sqlite") for n in names), **more).load()
    df = read("a", "b", rows=100)
    assert df.dtypes == [("id", "string"), ("updated_at", "bigint"), ('odd "name', "double"), ("any", "string")]
    assert df.rdd.getNumPartitions() == 11 and df.count() == 900 + 9
    rows = spark.createDataFrame(df.collect(), df.schema).cache()
    for condition in ("updated_at > 500", "updated_at in (1, 5, 700)", "updated_at is null", "id = 'a5'", "any = '8'", "updated_at >= 10 and updated_at < 20 and id like 'a%'"):
        assert df.where(condition).count() == rows.where(condition).count() > 0, condition
    assert read("none").count() == 0 and read("none", "b").count() == 9
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW threads_ USING sqlite OPTIONS (path '{database / 'a.sqlite'}', table 'threads')")
    assert spark.sql("SELECT max(updated_at) FROM threads_").first()[0] == 999


def test_filters_go_down(database):
    from pyspark.sql.datasource import GreaterThan

    source = plugins.SqliteSource({"path": str(database / "a.sqlite")})
    reader = source.reader(source.schema())
    assert list(reader.pushFilters([GreaterThan(("updated_at",), 990), GreaterThan(("id",), "a")])) and reader.where == ['"updated_at" > ?']
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) < 10


def test_readings_by_a_table_function(spark):
    rows = [("h", f"s{i % 3}", i, i * i) for i in range(30)]
    spark.createDataFrame(rows, "host string, session_id string, ord int, v int").createOrReplaceTempView("events_")
    plugins.register_readings(spark, "jumps", lambda rows: [(rows[0].host, rows[0].session_id, i, float(b.v - a.v)) for i, (a, b) in enumerate(zip(rows, rows[1:]))], "host string, session_id string, n int, jump double")
    got = spark.sql("SELECT * FROM jumps(TABLE(events_) PARTITION BY (host, session_id) ORDER BY ord)").collect()
    assert len(got) == 27 and {(r.session_id, r.n): r.jump for r in got}[("s1", 0)] == 4 * 4 - 1


def test_sketches_merge_within_their_bound(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(f"k{i % 2}", f"d{i % 5}", rnd.choice([rnd.gauss(0, 1), rnd.expovariate(0.1), 7.0])) for i in range(60_000)] + [("k0", "d0", None), ("k0", "d0", float("nan")), ("few", "d1", 1.0), ("few", "d2", 3.0), ("none", "d1", None)]
    df = spark.createDataFrame(rows, "signal string, day string, value double").repartition(6)
    path = str(tmp_path / "sketches")
    sketches.add_days(sketches.sketched(df, ["signal", "day"], "value"), path)
    sketches.add_days(sketches.sketched(df.where("day = 'd1'"), ["signal", "day"], "value"), path)  # again: replaced, not added
    shares = {f"q{int(100 * s)}": s for s in (0.01, 0.25, 0.5, 0.9, 0.99)}
    got = {r.signal: r for r in sketches.aggregates(spark.read.parquet(path), ["signal"], shares).collect()}
    assert set(got) == {"k0", "k1", "few"} and (got["few"].n, got["few"].min, got["few"].max, got["few"].q99) == (2, 1.0, 3.0, 3.0)
    for signal in ("k0", "k1"):
        values = sorted(v for s, _, v in rows if s == signal and v is not None and v == v)
        r = got[signal]
        assert (r.n, r.min, r.max) == (len(values), values[0], values[-1])
        for name, share in shares.items():
            low, high = bisect_left(values, r[name]) / r.n, bisect_right(values, r[name]) / r.n
            assert low - 2 * sketches.RANK_ERROR <= share <= high + 2 * sketches.RANK_ERROR, (name, low, high)
    exact = df.where("signal = 'k0' and not isnan(value)").agg(F.percentile("value", 0.5)).first()[0]
    assert abs(exact - got["k0"].q50) < 0.5
