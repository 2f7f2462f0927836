"""Raw transcripts of both hosts to events, steps and signals."""

import json

import pytest
from pyspark.sql import functions as F

from loomlog.operators import mining, signals, trajectory
from loomlog.sources import transcripts as S


def a(kind, at, **more):
    return {"type": kind, "uuid": f"u{at}", "timestamp": f"2026-01-01T10:00:{at:02d}Z", **more}


def said(role, content):
    return {"message": {"role": role, "content": content}}


LINES_A = [
    a("system", 0, message="started"),
    a("user", 5, **said("user", "Please fix the parser")),
    a("assistant", 7, **said("assistant", [{"type": "text", "text": "Reading first"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/src/p.py"}}])),
    a("user", 9, **said("user", [{"type": "tool_result", "tool_use_id": "t1", "content": "def p(): ..."}])),
    a("assistant", 14, **said("assistant", [{"type": "tool_use", "id": "t2", "name": "Edit", "input": {"file_path": "/src/p.py", "old": "a", "new": "é \"q\""}}])),
    a("user", 15, **said("user", [{"type": "tool_result", "tool_use_id": "t2", "content": "ok"}])),
    a("assistant", 18, **said("assistant", [{"type": "thinking", "thinking": "now test"}, {"type": "tool_use", "id": "t3", "name": "Bash", "input": {"command": "python -m pytest -q"}}])),
    a("user", 20, **said("user", [{"type": "tool_result", "tool_use_id": "t3", "content": "1 passed", "is_error": False}])),
    a("pr-link", 21),
    a("odd", 22),
    a("user", 25, **said("user", "Thanks, that's perfect!")),
]
LINES_B = [
    {"type": "session_meta", "timestamp": "2026-01-01T00:00:00Z", "payload": {"id": "s", "cwd": "/w"}},
    {"type": "event_msg", "timestamp": "2026-01-01T00:00:01Z", "payload": {"type": "user_message", "message": "Run it"}},
    {"type": "response_item", "timestamp": "2026-01-01T00:00:01Z", "payload": {"type": "message", "role": "user", "content": "Run it"}},
    {"type": "response_item", "timestamp": "2026-01-01T00:00:02Z", "payload": {"type": "function_call", "name": "exec_command", "arguments": '{"cmd": "rg foo"}', "call_id": "c1"}},
    {"type": "response_item", "timestamp": "2026-01-01T00:00:03Z", "payload": {"type": "function_call_output", "call_id": "c1", "output": "Process exited with code 2"}},
    {"type": "event_msg", "timestamp": "2026-01-01T00:00:07Z", "payload": {"type": "patch_apply_end", "success": True, "changes": {"/a.py": {"type": "update"}}}},
    {"type": "event_msg", "timestamp": "2026-01-01T00:00:09Z", "payload": {"type": "new_thing"}},
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw")
    for name, lines in (("a", LINES_A), ("b", LINES_B)):
        (path / name).mkdir()
        text = [json.dumps(x, ensure_ascii=False) for x in lines]
        text[2:2] = ["", "{not json"] if name == "a" else []
        (path / name / f"s{name}.events.jsonl").write_text("\n".join(text) + "\n")
    return path


def test_lines_are_counted_with_blank_and_bad_ones(spark, folder):
    rows = S.read_lines(spark, f"{folder}/a").orderBy("line").collect()
    assert [r["line"] for r in rows] == [1, 2, *range(5, 14)] and {r["session_id"] for r in rows} == {"sa"}


def test_host_a(spark, folder):
    rows = S.normalise_a(S.read_lines(spark, f"{folder}/a")).orderBy("ord").collect()
    assert [(r["actor"], r["event_type"]) for r in rows] == [
        ("system", "message"), ("user", "message"), ("assistant", "message"), ("assistant", "file_read"), ("tool", "file_read"),
        ("assistant", "file_edit"), ("tool", "file_edit"), ("assistant", "reasoning"), ("assistant", "command"), ("tool", "command"),
        ("system", "attachment"), ("system", "unknown"), ("user", "message"),
    ]
    assert [r["sequence"] for r in rows] == [1, 2, 3, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11]
    assert rows[3]["event_id"] == "u7#1" and rows[4]["summary"] == "tool_result: Read" and rows[8]["summary"] == "Bash(command=python -m pytest -q)"
    assert json.loads(rows[5]["payload"]) == {"tool_id": "t2", "name": "Edit", "input": LINES_A[4]["message"]["content"][0]["input"]}
    assert json.loads(rows[9]["payload"])["is_error"] is False and json.loads(rows[1]["payload"]) == {"text": "Please fix the parser"}


def test_host_b(spark, folder):
    rows = S.normalise_b(S.read_lines(spark, f"{folder}/b")).orderBy("ord").collect()
    assert [(r["actor"], r["event_type"], r["sequence"]) for r in rows] == [
        ("system", "session_start", 1), ("user", "message", 2), ("assistant", "command", 4), ("tool", "tool_result", 5), ("tool", "file_edit", 6), ("system", "unknown", 7)
    ]
    assert json.loads(rows[2]["payload"]) == {"name": "exec_command", "arguments": {"cmd": "rg foo"}, "call_id": "c1"}
    assert rows[3]["summary"] == "tool_result: exec_command" and rows[4]["summary"] == "patch_apply success=true files=1"
    gap = S.gaps(S.normalise_b(S.read_lines(spark, f"{folder}/b"))).collect()
    assert gap[0]["unknown"] == 1


def test_signals(spark, folder):
    events = S.normalise_a(S.read_lines(spark, f"{folder}/a")).unionByName(S.normalise_b(S.read_lines(spark, f"{folder}/b")))
    got = {r["session_id"]: r for r in signals.measure(events).collect()}
    one, two = got["sa"], got["sb"]
    assert (one["command_count"], one["file_edit_count"], one["unique_files_edited"], one["unique_files_read"]) == (1, 2, 1, 1)
    assert (one["user_message_count"], one["assistant_message_count"]) == (2, 1)
    assert (one["session_duration_seconds"], one["time_to_first_edit_seconds"]) == (25, 9)
    assert one["failed_command_ratio"] == 0.0 and one["user_satisfaction_lexical"] == "positive" and one["capture_gap_signal"] and not one["secret_exposure_signal"]
    assert two["failed_command_count"] == 1 and two["failed_command_ratio"] == 1.0 and two["unique_files_edited"] == 1
    rows = signals.readings(signals.measure(events))
    figures = {r["signal"]: r for r in signals.aggregate(rows).collect()}
    assert figures["command_count"]["total"] == 2 and figures["capture_gap_signal"]["true_count"] == 2 and figures["user_satisfaction_lexical"]["present"] == 2
    with pytest.raises(KeyError):
        signals.measure(events, ["none"])
    with pytest.raises(ValueError):
        signals.register("command_count", "numeric")(lambda: F.lit(1))


def test_steps(spark, folder):
    events = S.normalise_a(S.read_lines(spark, f"{folder}/a"))
    rows = trajectory.build(events).orderBy("idx").collect()
    assert [r["category"] for r in rows] == ["explore", "generate_fix", "run_tests"]
    assert rows[0]["thought_event_ids"] == ["u7"] and rows[2]["thought_event_ids"] == ["u18"] and rows[2]["result_event_ids"] == ["u20"]
    measured = trajectory.measure(trajectory.build(events)).first()
    assert measured["validation_presence"] and measured["fix_validation_latency_steps"] == 1 and measured["phase_transition_count"] == 2
    assert measured["phase_coverage"] == 0.375 and measured["sequence_entropy"] == 1.585 and measured["exploration_ratio"] == 0.3333


def test_mining(spark, folder):
    events = S.normalise_a(S.read_lines(spark, f"{folder}/a"))
    found = mining.skills(events).collect()
    assert len(found) == 1 and found[0]["edits"] == 1 and found[0]["calls"] == 3 and found[0]["activation"] == "Please fix the parser" and found[0]["text"] == "Skill: investigate and patch a bug"
    assert mining.compact(events, 2, 1).count() == 3
    assert {r["rule"] for r in mining.refinements(events).collect()} <= set(mining.REFINEMENTS)
    made = mining.procedures(events).first()
    assert made["structured"]["steps"] == ["read 1 file", "edited 1 file", "ran 1 shell command"] and made["structured"]["goal"] == "Please fix the parser" and made["confidence"] == 0.7 and made["priority"] == 4
    bare = mining.procedures(events.where("actor = 'user'")).first()
    assert bare["text"] == mining.NO_STEPS and bare["confidence"] == 0.2 and bare["structured"] is None and len(bare["evidence_refs"]) == 1


def test_events_round_trip(spark, folder, tmp_path):
    events = S.normalise_a(S.read_lines(spark, f"{folder}/a"))
    S.write_events(events, f"{tmp_path}/events")
    assert S.read_events(spark, f"{tmp_path}/events").select(*S.EVENT).exceptAll(events).count() == 0


def test_authored(spark, tmp_path):
    (tmp_path / "m.md").write_text("---\nid: one\nkind: 'policy'\npriority: 4\n---\n\nAlways [[two]] test.\n")
    (tmp_path / "empty.md").write_text("---\nid: x\n---\n\n")
    rows = S.read_authored(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["fields"] == {"id": "one", "kind": "policy", "priority": "4"} and rows[0]["text"] == "Always [[two]] test."
