"""Running values over ranges against windows over whole sessions."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlog.operators import prefix, trajectory
from loomlog.operators.prefix import Latest, Next, Total
from loomlog.plans.session_queries import session_events

KEYS = ("host", "session_id")


def made(spark, n, sessions, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["h", None]), f"s{rnd.choice(sessions)}", i, rnd.choice([None, None, i]), rnd.choice([None, 0, 1, -2]), rnd.choice("ab")) for i in range(n)]
    return spark.createDataFrame(rows, "host string, session_id string, ord long, v long, x int, c string").repartition(3)


@pytest.mark.parametrize("n, sessions, parts", [(0, [1], 3), (1, [1], 3), (300, [1], 7), (300, [1, 1, 1, 1, 2, 3], 4), (300, list(range(200)), 5), (40, [1, 2], 64)])
def test_scan_against_windows(spark, n, sessions, parts):
    df = made(spark, n, sessions, n + parts)
    own = Window.partitionBy(*KEYS).orderBy("ord")
    upto, past, on, behind = (own.rowsBetween(*r) for r in ((Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1), (0, Window.unboundedFollowing), (1, Window.unboundedFollowing)))
    v = F.col("v")
    want = df.select("*", F.coalesce(F.sum("x").over(upto), F.lit(0)).alias("a"), F.last(v, True).over(upto).alias("b"), F.last(v, True).over(past).alias("c2"), F.first(v, True).over(on).alias("d"), F.first(v, True).over(behind).alias("e"), F.lag("x").over(own).alias("f"), F.lead("x").over(own).alias("g"))
    got = prefix.scan(df, KEYS, ("ord",), parts, a=Total(F.col("x")), b=Latest(v), c2=Latest(v, before=True), d=Next(v), e=Next(v, behind=True), f=prefix.lag(F.col("x")), g=prefix.lead(F.col("x")))
    got = got.withColumn("f", F.col("f")["v"]).withColumn("g", F.col("g")["v"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_longest_run(spark):
    df = spark.createDataFrame([("h", "s", i, c) for i, c in enumerate("aabbbbabbbbbaa")] + [("h", "t", 0, "a")], "host string, session_id string, ord long, c string")
    was = prefix.scan(df, parts=3, was=prefix.lag(F.col("c")))
    got = prefix.longest_run(was, F.coalesce(F.col("was")["v"] != F.col("c"), F.lit(True)), parts=4)
    assert sorted(map(tuple, got.collect())) == [("h", "s", 5), ("h", "t", 1)]


def test_steps_over_ranges_are_those_of_windows(spark):
    events = session_events(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, trajectory.build(events, parts=9).collect())) == sorted(map(str, trajectory.build(events).collect()))


def test_one_long_session_is_many_tasks(spark):
    n = 2_000_000
    df = spark.range(n).select(F.lit("h").alias("host"), F.lit("s").alias("session_id"), F.col("id").alias("ord"), (F.col("id") % 10 == 0).cast("int").alias("user"))
    began = time.time()
    out = prefix.scan(df, parts=16, turn=Total(F.col("user")), last=Latest(F.when(F.col("user") == 1, F.col("ord"))))
    bad = out.where((F.col("turn") != F.floor(F.col("ord") / 10) + 1) | (F.col("last") != F.col("ord") - F.col("ord") % 10)).count()
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert bad == 0 and out.count() == n and max(sizes) < n / 2 and time.time() - began < 120
