"""Line numbers over splits, payloads parsed once, and payloads as rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomlog.functions import predicates as P
from loomlog.operators import signals, trajectory, walks
from loomlog.plans.session_queries import session_events
from loomlog.sources import transcripts

SF = "/root/testdata/sf0.001"


def lines_of(rnd, n):
    return [rnd.choice(["", " ", "{bad", json.dumps({"a": "é" * rnd.randrange(30), "n": i}), json.dumps({"n": i}) + "\r", '"text"', "[1]"]) for i in range(n)]


@pytest.mark.parametrize("split", ["64", "500", "100000000"])
def test_lines_are_numbered_over_splits(spark, tmp_path, split):
    rnd = random.Random(split)
    want = []
    for name, n, end in (("a.jsonl", 400, "\n"), ("b.events.jsonl", 3, ""), ("sub.jsonl", 57, ""), ("empty.jsonl", 0, ""), ("blank.jsonl", 5, "\n\n\n")):
        lines = ["", "", ""] if name.startswith("blank") else lines_of(rnd, n)
        (tmp_path / name).write_bytes(("\n".join(lines) + end).encode())
        for i, line in enumerate(lines, 1):
            line = line.removesuffix("\r")
            try:
                json.loads(line)
                want.append((name.split(".")[0], i, line))
            except ValueError:
                pass
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = transcripts.read_lines(spark, str(tmp_path))
        got = sorted((r.session_id, r.line, r.raw) for r in df.collect())
        assert got == sorted(want)
        if split == "64":
            assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_stored_variants_give_the_same_steps_and_signals(spark, tmp_path):
    events = session_events(spark, SF)
    transcripts.write_events(events, str(tmp_path / "events"))
    stored = transcripts.read_events(spark, str(tmp_path / "events"))
    assert dict(stored.dtypes)["doc"] == "variant" and "doc" not in events.columns
    for of in (trajectory.build, signals.measure):
        assert sorted(map(str, of(stored).collect())) == sorted(map(str, of(events).collect()))
    plan = trajectory.build(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 6, "payloads are parsed again"
    assert stored.where(P.field(P.payload(), "name") == "Bash").count() == events.where(F.get_json_object("payload", "$.name") == "Bash").count() > 0


def kind(v):
    return {dict: "object", list: "list", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")


def walked(v, path=(), key=None):
    """Every value down to depth 8, and what is just below."""
    deep = len(path) > 8
    text = None if deep or isinstance(v, (dict, list)) or v is None else str(v).lower() if isinstance(v, bool) else str(v)
    yield path, key, kind(v), text
    if not deep:
        inner = sorted(v.items(), key=lambda kv: kv[0].encode()) if isinstance(v, dict) else [(None, x) for x in v] if isinstance(v, list) else []
        for i, (k, x) in enumerate(inner):
            yield from walked(x, (*path, i), k)


def nested(rnd, depth):
    if depth == 0 or rnd.random() < 0.2:
        return rnd.choice([None, True, False, rnd.randrange(-5, 99), 2.5, "", "text", 'quo"te\\', "é\n", {}, []])
    if rnd.random() < 0.5:
        return [nested(rnd, depth - 1) for _ in range(rnd.randrange(0, 4))]
    return {rnd.choice("abcdeé") + str(i): nested(rnd, depth - 1) for i in range(rnd.randrange(0, 4))}


def test_walk_against_python(spark):
    rnd = random.Random(6)
    values = [nested(rnd, d) for d in (0, 1, 2, 3, 5, 12, 12, 14) for _ in range(12)]
    texts = [json.dumps(v) for v in values] + ["{bad", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, payload string").repartition(3)
    got = sorted(((r.id, tuple(r.path), r.depth, r.key, r.kind, r.value) for r in walks.walk(df, ("id",)).collect()), key=str)
    want = sorted(((i, p, len(p), k, t, x) for i, v in enumerate(values) for p, k, t, x in walked(v)), key=str)
    assert got == want and max(len(w[1]) for w in want) == 9
    lines = {r.id: r.text for r in walks.searchable(df, ("id",)).collect()}
    for i, v in enumerate(values):
        rows = sorted((p, "\n".join(x for x in (k, t) if x is not None)) for p, k, _, t in walked(v) if k is not None or t is not None)
        assert lines.get(i, "") == "\n".join(x for _, x in rows)


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_walk_to_other_depths(spark, depth):
    df = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":1}}}}')], "id long, payload string")
    got = walks.walk(df, ("id",), depth)
    assert got.agg(F.max("depth")).first()[0] == depth + 1 and "Exchange" not in got._jdf.queryExecution().toString()


def test_secrets_in_escaped_texts_keys_and_numbers(spark):
    key = "sk_live_" + "a1" * 12
    payloads = ['{"command":"export TOKEN=\\"abcdefghijklmnop\\""}', json.dumps({key: 1}), json.dumps({"x": [{"y": f"see {key}"}]}), '{"token": "short"}', "{bad " + key, None]
    rows = [("h", f"s{i}", 0, "e", "t", "message", "", p, None) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "host string, session_id string, ord long, event_id string, actor string, event_type string, summary string, payload string, timestamp string")
    got = {r.session_id: (r.secret_exposure_count, r.secret_exposure_signal) for r in signals.measure(df, ["secret_exposure_count", "secret_exposure_signal"]).collect()}
    assert got == {"s0": (1, True), "s1": (1, True), "s2": (1, True), "s3": (0, False), "s4": (0, False), "s5": (0, False)}


def test_typed_events_are_spread_by_rows(spark):
    """Tasks don't follow the few bytes of their rows, which stand for long work."""
    from loomlog.sources.views import typed_events

    events = typed_events(spark, "/root/testdata/sf0.001").withColumn("task", F.spark_partition_id())
    assert events.select("task").distinct().count() > 1
