"""Streams of late and repeated rows give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from loomlog.operators import joins, trajectory
from loomlog.plans.session_queries import session_events
from loomlog.sources.memory_store import EVENT, MemoryStore
from loomlog.streaming import stateful

SF = "/root/testdata/sf0.001"


def dealt(spark, df, folder, order, files=5, seed=1):
    """Rows as files in rough order: neighbours swap places over the files' borders, some rows come twice; a last file moves the watermark on."""
    rows = sorted(df.collect(), key=lambda r: r[order])
    rnd = random.Random(seed)
    rows = sorted(range(len(rows)), key=lambda i: i + rnd.uniform(0, len(rows) / 20)), rows
    places, rows = rows
    shuffled = [rows[i] for i in places]
    shuffled = [r for x in shuffled for r in ([x, x] if rnd.random() < 0.1 else [x])]
    size = -(-len(shuffled) // files)
    parts = [shuffled[k : k + size] + rnd.sample(shuffled[:k] or shuffled[:1], min(3, k + 1)) for k in range(0, len(shuffled), size)]
    last = rows[-1].asDict() | {"ts": rows[-1]["ts"].replace(year=rows[-1]["ts"].year + 1), "session_id": "flush", "ord": 0, "event_id": "flush"}
    for i, part in enumerate([*parts, [last], [last | {"ts": last["ts"].replace(year=last["ts"].year + 1), "ord": 1}]]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/p{i}")
    return [f"{folder}/p{i}" for i in range(len(parts) + 2)]


def stream(spark, folders, schema, into):
    """A stream that sees the folders' files one after another."""
    import os
    import shutil

    os.makedirs(into)
    for i, folder in enumerate(folders):
        for name in os.listdir(folder):
            if name.endswith(".parquet"):
                shutil.copy(f"{folder}/{name}", f"{into}/{i:03}-{name}")
                os.utime(f"{into}/{i:03}-{name}", (1_000_000 + 10 * i, 1_000_000 + 10 * i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(into)


@pytest.fixture(scope="module")
def events(spark):
    e = session_events(spark, SF).where("session_id < '3'").withColumn("event_id", F.concat_ws("-", "session_id", "event_id"))
    thought = (F.col("ord") % 4 == 1) & (F.col("event_type") == "message")
    e = e.withColumn("actor", F.when(thought, "assistant").otherwise(F.col("actor")))
    return e.select("host", "session_id", "ord", F.col("ts").cast("timestamp").alias("ts"), "event_id", "actor", "event_type", "summary", "payload").cache()


def test_steps_of_a_stream_are_those_of_the_batch(spark, events, tmp_path):
    span = events.agg(F.max("ts").cast("long") - F.min("ts").cast("long")).first()[0]
    folders = dealt(spark, events, str(tmp_path / "files"), "ts")
    rows = stream(spark, folders, events.schema, str(tmp_path / "in"))
    query = stateful.write_steps(rows, str(tmp_path / "out"), str(tmp_path / "c"), late=f"{span // 3} seconds", idle_seconds=span * 2).start()
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out")).where("session_id <> 'flush'").drop("batch")
    want = trajectory.build(events)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert want.where("size(thought_event_ids) > 0").count() > 0 and want.where("size(result_event_ids) > 0").count() > 0


def test_calls_of_a_stream_are_those_of_the_batch(spark, events, tmp_path):
    k = F.abs(F.xxhash64("event_id")) % 5
    rows = events.select("host", "session_id", "ord", "ts", "event_id", F.concat(F.lit("c"), k).alias("call_id"), (F.col("event_type") != "tool_result").alias("is_call"))
    span = rows.agg(F.max("ts").cast("long") - F.min("ts").cast("long")).first()[0]
    folders = dealt(spark, rows, str(tmp_path / "files"), "ts", seed=4)
    df = stateful.results_with_calls(stream(spark, folders, rows.schema, str(tmp_path / "in")), late=f"{span // 3} seconds", idle_seconds=span)
    query = df.writeStream.format("memory").queryName("calls_").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("calls_").where("session_id <> 'flush'")
    want = joins.latest_before(rows, "is_call", "call_id", "event_id").select("host", "session_id", "event_id", "call_id", F.col("latest_event_id").alias("call_event_id"))
    assert sorted(map(str, got.where("event_id is not null").collect())) == sorted(map(str, want.collect())) and want.count() > 0
    last = rows.groupBy("host", "session_id", "call_id").agg(F.max(F.struct("ord", "is_call", "event_id")).alias("r")).where("r.is_call").select("host", "session_id", F.lit(None).cast("string").alias("event_id"), "call_id", F.col("r.event_id").alias("call_event_id"))
    assert sorted(map(str, got.where("event_id is null").collect())) == sorted(map(str, last.collect()))


def test_utility_of_a_stream_is_that_of_one_append(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"m{rnd.randrange(9)}", i, "memory_rewarded", "s", rnd.random(), None, i) for i in range(200)]
    whole, streamed = MemoryStore(spark, str(tmp_path / "whole")), MemoryStore(spark, str(tmp_path / "streamed"))
    records = spark.createDataFrame([(f"m{i}", i, f"text {i}") for i in range(9)], "id string, ord long, text string")
    whole.append(records, spark.createDataFrame(rows, EVENT))
    streamed.append(records)
    for i in range(0, 200, 50):
        part = rows[i : i + 50] + rnd.sample(rows[max(0, i - 50) : i + 50], 10)
        df = spark.createDataFrame(sorted(part, key=lambda r: r[1]), EVENT)
        df.withColumn("ts", F.timestamp_seconds(F.col("line") + 100_000)).coalesce(1).write.parquet(str(tmp_path / f"files/p{i}"))
    schema = spark.read.parquet(str(tmp_path / "files/p0")).schema
    rewards = stream(spark, [str(tmp_path / f"files/p{i}") for i in range(0, 200, 50)], schema, str(tmp_path / "in"))
    query = stateful.write_utility(rewards, streamed, str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    streamed.append(events=spark.createDataFrame(rows[:50], EVENT), key="rewards-0")  # tried again
    state = lambda s: sorted((r.id, round(r.q_value, 9), r.hits, r.successes) for r in s.memory().collect())
    assert state(streamed) == state(whole) and sum(r[2] for r in state(whole)) == 200
