"""Reports, discovery, memory lifecycle and mining on small tables."""

import json
import sqlite3

import pytest

from loomlog.operators import accounting, joins, memory, mining, reports, signals
from loomlog.operators import portfolio as R
from loomlog.sources import discovery as D
from loomlog.sources import transcripts as T

EVENTS = "host string, session_id string, ord int, event_id string, actor string, event_type string, summary string, payload string, timestamp string"


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        ("h", "s", 1, "e1", "user", "message", "hi", json.dumps({"text": "key sk-" + "a" * 24 + " there"}), "2024-01-01T00:00:00Z"),
        ("h", "s", 2, "e2", "assistant", "command", "Bash", json.dumps({"name": "Bash", "input": {"command": "ls"}}), None),
        ("h", "s", 3, "e3", "tool", "tool_result", "out", json.dumps({"output": "a```b"}), None),
        ("h", "t", 1, "f1", None, "unknown", None, None, None),
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_transcript(spark, events):
    got = {r["session_id"]: r["markdown"] for r in reports.transcript(events).collect()}
    assert got["s"].startswith("# Session s (h)\n\n- command: 1\n- message: 1\n- tool_result: 1\n\n### message · user · 2024-01-01T00:00:00Z\n\nkey sk-")
    assert "````\na```b\n````" in got["s"] and got["t"].endswith("### unknown · unknown\n\n")


def test_analysis_and_files(spark, events, tmp_path):
    overview = spark.createDataFrame([("sessions", 2)], "name string, value int")
    r = signals.readings(signals.measure(events, ["command_count", "capture_gap_signal"]))
    a = signals.aggregate(r)
    reports.write_signals(r, a, reports.signal_summary(a, signals.histogram(r)), str(tmp_path / "s"))
    assert D.signal_artifacts(spark, str(tmp_path / "s/readings")).count() == 4 and D.signal_artifacts(spark, str(tmp_path / "s/readings"), "command").count() == 2
    parts = {r["part"] for r in reports.dashboard(overview, totals=R.experiments(a)).collect()}
    assert parts == {"sessions", "totals"}
    found = mining.mine(events, "refine")
    reports.write_mined(found, reports.prompt_block(found.withColumn("origin_repo", found["scope"])), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m/blocks")).where("value like '<memories%'").count() == 2


def test_analysis(spark):
    rows = [("h", "a", "Bash", "ls -la", 0), ("h", "a", "Bash", "ls", 1), ("h", "b", "Read", None, 0), ("i", "c", "Bash", "x" * 61, 1), ("other", "d", "Bash", "ls", 1)]
    both = []
    for i, (host, session, tool, line, code) in enumerate(rows):
        payload = {"name": tool, "input": {"command": line}} if line else {"name": tool, "input": {}}
        both.append((host, session, 2 * i, f"c{i}", "assistant", "command" if line else "file_read", tool, json.dumps(payload | {"call_id": f"k{i}"}), None))
        both.append((host, session, 2 * i + 1, f"r{i}", "tool", "tool_result", "", json.dumps({"call_id": f"k{i}", "output": f"Process exited with code {code}"}), None))
    df = spark.createDataFrame(both, "host string, session_id string, ord long, event_id string, actor string, event_type string, summary string, payload string, parent_event_id string")
    lines = [r.line for r in reports.analysis(df, joins.calls(df), ("h", "i", "none")).orderBy("section", "rank").collect()]
    assert lines[:5] == list(reports.ANALYSIS_HEAD[:5]) and lines[9:13] == ["| h | 2 | 2 | 50.0% | 3 | 33.3% |", "| i | 1 | 1 | 100.0% | 1 | 100.0% |", "| none | 0 | 0 | 0.0% | 0 | 0.0% |", "| Total (All Hosts) | 3 | 3 | 66.7% | 4 | 50.0% |"]
    assert "| `ls` | h | 2 | 50.0% |" in lines and f"| `{'x' * 57}...` | i | 1 | 100.0% |" in lines and "| `Read` | h | 1 | 0.0% |" in lines
    at = lines.index("## Action Transition Patterns")
    assert lines[at + 4 :] == ["| command | tool_result | 3 |", "| file_read | tool_result | 1 |", "| tool_result | command | 1 |", ""]


def test_mining_to_the_end(spark, events):
    found = mining.mine(events, "refine", ("risk_aware",)).collect()
    assert found and all(r["id"].startswith(f"{r['session_id']}:refine:") and r["risk"] != "high" for r in found)
    answers = spark.createDataFrame([("h", "s", json.dumps({"candidates": [{"text": "run tests first", "when_to_use": "always", "risk": r, "confidence": c} for r, c in (("low", 0.9), ("high", 0.9), ("low", 0.1), ("medium", 0.8))]})), ("h", "gone", "{}")], "host string, session_id string, answer string")
    mining.register(mining.METHODS, "model")(mining.model_method(answers))
    try:
        kept = mining.mine(events, "model", ("risk_aware",)).collect()
        assert [(r["id"], r["rank"]) for r in kept] == [("s:model:1", 1)]  # the last one is like the first
        for method in mining.METHODS:
            assert "id" in mining.mine(events, method).columns
    finally:
        del mining.METHODS["model"]


def test_mining_registry(spark, events):
    for bad in (("nobody", ()), ("refine", ("nobody",))):
        with pytest.raises(KeyError):
            mining.mine(events, *bad)
    with pytest.raises(ValueError):
        mining.mine(events.limit(0), "refine")
    prompt = {r["session_id"]: r["prompt"] for r in mining.prompts(events).collect()}
    assert "[REDACTED]" in prompt["s"] and "sk-aaa" not in prompt["s"] and len(json.loads(prompt["s"])) == 3
    answer = {"candidates": [{"text": " a ", "when_to_use": "b", "confidence": "7", "priority": "x", "evidence_refs": ["1"] * 9}, {"text": "", "when_to_use": "c"}, *[{"text": "t", "when_to_use": "u"}] * 9]}
    rows = mining.validated(spark.createDataFrame([("h", "s", json.dumps(answer)), ("h", "t", "no json"), ("h", "u", None)], "host string, session_id string, answer string")).orderBy("rank").collect()
    assert len(rows) == 7 and (rows[0]["text"], rows[0]["confidence"], rows[0]["priority"], rows[0]["kind"], len(rows[0]["evidence_refs"])) == ("a", 1.0, 3, "procedure", 8)


def test_secrets(spark, events):
    rows = signals.secrets(events).collect()
    assert [(r["n"], r["type"], r["event_id"]) for r in rows] == [(1, "openai_api_key", "e1")]
    assert rows[0]["snippet"] == "hi text key [REDACTED] there" and "sk-a" not in rows[0]["snippet"]
    assert signals.select(events, host="h", sessions=("t",)).count() == 1


def test_discovery(spark, tmp_path):
    for root, name, text in (("a/p", "s1", "{}"), ("b/p", "s1", "{}"), ("b/p", "s2", "{}")):
        (tmp_path / root).mkdir(parents=True, exist_ok=True)
        (tmp_path / root / f"{name}.jsonl").write_text(text)
    found = D.first_root_wins(D.list_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")]))
    assert {(r["session_id"], r["root_rank"], r["project"]) for r in found.collect()} == {("s1", 0, "p"), ("s2", 1, "p")} and D.latest(found).count() == 1
    (tmp_path / "c/sessions").mkdir(parents=True)
    (tmp_path / "d").mkdir()
    with sqlite3.connect(tmp_path / "d/state_1.sqlite") as db:
        db.execute("CREATE TABLE threads (id TEXT, updated_at INTEGER)")
        db.executemany("INSERT INTO threads VALUES (?, ?)", [("x", 1), ("y", 2)])
    assert [D.classify_root(str(tmp_path / x)) for x in "acd"] == ["jsonl_dir", "sessions_dir", "sqlite_home"]
    assert [r["id"] for r in D.threads(spark, str(tmp_path / "d/state_1.sqlite")).collect()] == ["y", "x"]
    lines = spark.createDataFrame([("f", 1, '{"type":"x"}'), ("f", 3, '{"type":"session_meta","payload":{"id":"s"}}'), ("g", 9, '{"type":"session_meta","payload":{"id":"t"}}')], "path string, line int, raw string")
    assert [(r["path"], r["session_id"]) for r in D.rollout_sessions(lines).collect()] == [("f", "s")]
    meta = spark.createDataFrame([("{bad", '{"a":1}'), (None, '{"a":1}'), (None, None)], "t string, i string")
    assert [r[0] for r in meta.select(D.raw_meta(meta["t"], meta["i"])).collect()] == ["{}", '{"a":1}', "{}"]
    (tmp_path / "prices.json").write_text('{"_meta":{},"m":{"input_cost_per_token":0.000001}}')
    assert [(r["key"], r["input"], r["cache_read"], r["output"]) for r in D.pricing_snapshot(spark, str(tmp_path / "prices.json")).collect()] == [("m", 1.0, 1.0, 0.0)]
    (tmp_path / "e.jsonl").write_text('{"a":1}\n{"a":"x"}\n')
    with pytest.raises(Exception):
        T.read_event_lines(spark, str(tmp_path / "e.jsonl"), "a int").collect()


def test_memory_lifecycle(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "h1", 5, 0.5, "see [[b|B]]", ["x"]), (2, "b", "h1", 3, 0.5, "later", ["x", "y"]), (3, "c", "h2", 9, 0.2, "", None)], "ord int, id string, content_hash string, created_at long, q_value double, text string, evidence array<string>")
    rewards = spark.createDataFrame([("a", 1, 7.0), ("zz", 2, 1.0)], "memory_id string, line long, reward double")
    tables = memory.rebuild(rows, rewards)
    got = {r["id"]: r for r in tables["memory"].collect()}
    assert got.keys() == {"a", "c"} and got["a"]["text"] == "later" and got["a"]["created_at"] == 3 and got["a"]["evidence"] == ["x", "y"] and got["a"]["evidence_count"] == 3
    assert got["a"]["q_value"] == pytest.approx(0.6) and {r["table"]: r["n"] for r in tables["counts"].collect()} == {"memory": 2, "link": 0}
    events, after = memory.update_utility(memory.upsert(rows), rewards, "c", -3.0, 9)
    assert events.count() == 3 and after.first()["q_value"] == pytest.approx(0.16)
    with pytest.raises(KeyError):
        memory.update_utility(memory.upsert(rows), rewards, "nobody", 1.0, 9)
    memory.append(rows, str(tmp_path / "log"))
    memory.append(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_usage_of_turns(spark):
    more = ", ".join(f"{p}{c} long" for p in ("", "last_") for c in accounting.COUNTERS)
    zero = (0,) * 5
    rows = [("h", "s", 1, "m", 10, *zero, None, *[None] * 5), ("h", "s", 2, None, 30, *zero, 7, *zero), ("h", "old", 1, None, 0, *zero, None, *[None] * 5)]
    got = {(r["session_id"], r["model"]): r["input_tokens"] for r in accounting.usage_by_total(spark.createDataFrame(rows, f"host string, session_id string, ord int, model string, {more}")).collect()}
    assert got == {("s", "m"): 17}
    buckets = spark.createDataFrame([("h", "s", "m", *(1,) * 6)], f"host string, session_id string, model string, {', '.join(f'{c} long' for c in accounting.COUNTERS)}")
    totals = spark.createDataFrame([("h", "s", *(1,) * 6), ("h", "t", *(2,) * 6), ("h", "u", *(0,) * 6)], f"host string, session_id string, {', '.join(f'{c} long' for c in accounting.COUNTERS)}")
    models = spark.createDataFrame([("h", "t", None)], "host string, session_id string, cost_model string")
    assert {(r["session_id"], r["model"]) for r in accounting.fallback_bucket(buckets, totals, models).collect()} == {("s", "m"), ("t", "unknown")}


@pytest.mark.parametrize("name,most", [("procedures", 0), ("analysis_report", 2)])
def test_what_several_parts_of_a_report_read_is_made_once(spark, name, most):
    from loomlog.plans import report_queries

    plan = report_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [event_id") <= most
