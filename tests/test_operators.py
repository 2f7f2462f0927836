"""Stateful operators against plain Python on random sessions, and scalar functions on single cases."""

import random

import pytest
from pyspark.sql import functions as F

from loomlog.functions import predicates as P
from loomlog.functions import text as X
from loomlog.operators import accounting, joins, memory, portfolio, search, trajectory, windows
from loomlog.streaming import sessions as streams


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "line,base",
    [("git commit -m 'test'", "git"), (".venv/bin/pytest tests/ -v", "pytest"), ("python -m ruff check src/", "ruff"), ("PORT=3000 python main.py", "main.py"),
     ("poetry run black .", "black"), ("npx next dev", "next"), ("  ", ""), (None, "")],
)
def test_base_command(spark, line, base):
    assert one(spark, X.base_command, line) == base


@pytest.mark.parametrize(
    "payload,line",
    [('{"input":{"command":"ls"}}', "ls"), ('{"input":"ls -l"}', "ls -l"), ('{"arguments":{"cmd":"rg x"}}', "rg x"), ('{"arguments":"{\\"command_line\\":\\"go\\"}"}', "go"),
     ('{"arguments":"plain"}', "plain"), ('{"cmd":"a"}', "a"), ("{}", None), ("bad", None)],
)
def test_command_line(spark, payload, line):
    assert one(spark, X.command_line, payload) == line


@pytest.mark.parametrize(
    "payload,kind,a,b,c",
    [('{"is_error":true}', "x", 1, 1, 1), ('{"success":false}', "x", 1, 1, 1), ('{"status":"FAILED"}', "x", 1, 1, 1), ('{"output":"Process exited with code 1"}', "x", 1, 0, 0),
     ('{"output":"\\"exit_code\\": 3"}', "x", 1, 1, 1), ('{"output":"\\"exit_code\\" : 3"}', "x", 1, 0, 1), ("{}", "error", 1, 1, 0), ('{"is_error":"true","success":true}', "x", 0, 0, 0), (None, "x", 0, 0, 0)],
)
def test_failed(spark, payload, kind, a, b, c):
    assert (one(spark, P.failed_event, payload, kind), one(spark, P.failed_dashboard, payload, kind)) == (bool(a), bool(b))
    assert one(spark, P.failed_turn, payload) == bool(c)


def test_texts(spark):
    assert one(spark, P.failed_text, "0 failed") and not one(spark, P.failed_text, "process exited with code 0")
    assert one(spark, P.correction, "No, that's wrong") and not one(spark, P.correction, "éno wrong way")
    assert one(spark, lambda t: P.secret_count(t), "key sk-proj-abcdefghijklmnopqrstuv") == 1 and "[REDACTED]" in one(spark, P.redact, "sk-proj-abcdefghijklmnopqrstuv")
    assert one(spark, lambda t: X.truncate(t, 5, True), "  ab\ncdef ") == "ab c…"
    assert one(spark, X.event_text, '{"message":"m","text":1}', "s") == "m" and one(spark, X.event_text, "{}", "s") == "s"
    assert one(spark, X.search_tokens, "Été, foo_bar 3x") == ["ete", "foo", "bar", "3x"]
    assert one(spark, X.wiki_links, "[[a|b]] [[c#d]] [[a]] [[ ]]") == ["a", "c"]
    assert one(spark, X.salient_terms, "see src/app.py and KeyError with this") == ["src/app.py", "KeyError"]
    assert one(spark, X.normal_fingerprint, "Run  0xFF in /tmp/abc 2026-01-01T00:00:00Z") == "run <addr> in /tmp/<tmp> <timestamp>"
    assert one(spark, X.slug, "Hello, World!").startswith("hello-world-") and one(spark, P.safe_status, "accepted", "my API_KEY here") == "needs_review"
    assert one(spark, X.content_hash, "A  b", "repo", "case", None) == one(spark, X.content_hash, "a b ", "repo", "case", "None")


def test_match_results(spark):
    rng = random.Random(1)
    calls, results, want = [], [], {}
    for session in range(40):
        events = []
        for i in range(rng.randint(1, 14)):
            if rng.random() < 0.5:
                events.append(("call", i, f"e{i}", rng.choice([None, f"k{rng.randint(0, 4)}"])))
            else:
                events.append(("result", i, rng.choice([None, f"k{rng.randint(0, 4)}"]), rng.choice([None, None, f"e{rng.randint(0, 12)}"])))
        by_id = {e[2]: e[1] for e in events if e[0] == "result" and e[2]}
        by_parent = {e[3]: e[1] for e in events if e[0] == "result" and e[3]}
        free = [e[1] for e in events if e[0] == "result" and not e[2] and not e[3]]
        for e in events:
            if e[0] == "call":
                calls.append(("h", str(session), e[1], e[2], e[3]))
                found = by_id.get(e[3]) if e[3] else None
                found = by_parent.get(e[2]) if found is None else found
                want[str(session), e[1]] = free.pop(0) if found is None and free else found
            else:
                results.append(("h", str(session), e[1], e[2], e[3]))
    got = joins.match_results(
        spark.createDataFrame(calls, "host string, session_id string, ord int, event_id string, call_id string"),
        spark.createDataFrame(results, "host string, session_id string, ord int, call_id string, parent_event_id string"),
    )
    assert {(r["session_id"], r["ord"]): r["result_ord"] for r in got.collect()} == want


def test_build_trajectory(spark):
    rng = random.Random(2)
    kinds = [("assistant", "message"), ("assistant", "reasoning"), ("assistant", "command"), ("tool", "tool_result"), ("user", "message")]
    rows, want = [], []
    for session in range(40):
        thoughts, steps = [], []
        is_open = False
        for i in range(rng.randint(0, 16)):
            actor, kind = rng.choice(kinds)
            rows.append(("h", str(session), i, f"e{i}", actor, kind, f"s{i}", "{}"))
            if kind == "command":
                steps.append((thoughts[-3:], f"e{i}", []))
                thoughts, is_open = [], True
            elif actor == "assistant":
                thoughts.append(f"e{i}")
                is_open = False
            elif actor == "tool" and is_open:
                steps[-1][2].append(f"e{i}")
        want += [(str(session), k, *map(lambda x: tuple(x) if isinstance(x, list) else x, s)) for k, s in enumerate(steps)]
    events = spark.createDataFrame(rows, "host string, session_id string, ord int, event_id string, actor string, event_type string, summary string, payload string")
    got = [(r["session_id"], r["idx"], tuple(r["thought_event_ids"]), r["action_event_id"], tuple(r["result_event_ids"])) for r in trajectory.build(events).collect()]
    assert sorted(got) == sorted(want)


def test_runs_and_next_other(spark):
    rng = random.Random(3)
    rows, longest, nexts = [], {}, {}
    for session in range(30):
        seq = [(rng.choice("ab"), rng.choice("xyz")) for _ in range(rng.randint(1, 12))]
        rows += [("h", str(session), i, c, f, False) for i, (c, f) in enumerate(seq)]
        best = run = 1
        for p, q in zip(seq, seq[1:]):
            run = run + 1 if p[0] == q[0] or p[1] == q[1] else 1
            best = max(best, run)
        longest[str(session)] = best
        for i, p in enumerate(seq):
            nexts[str(session), i] = next((j for j in range(i + 1, len(seq)) if seq[j] != p), None)
    steps = spark.createDataFrame(rows, "host string, session_id string, idx long, category string, fp string, failed boolean")
    assert {r["session_id"]: r["max_repetition_run"] for r in trajectory.measure(steps).collect()} == longest
    assert {(r["session_id"], r["idx"]): r["next_other"] for r in trajectory.annotate(steps).collect()} == nexts


def test_near_duplicates(spark):
    rng = random.Random(4)
    rows, want = [], []
    for session in range(25):
        items = []
        for i in range(rng.randint(0, 20)):
            text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(1, 5)))
            items.append((str(session), i, rng.choice("ab"), text, rng.choice(["low", "high"]), rng.choice([0.1, 0.5, 0.9]), rng.randint(1, 3)))
        rows += items
        kept = []
        for x in sorted(items, key=lambda x: (-x[6], -x[5], x[2], x[1])):
            words = set(x[3].split())
            if x[4] == "high" or x[5] < 0.4 or any(k[2] == x[2] and len(words & set(k[3].split())) / len(words | set(k[3].split())) >= 0.75 for k in kept):
                continue
            kept.append(x)
            if len(kept) == 3:
                break
        want += [(str(session), r, x[1]) for r, x in enumerate(kept, 1)]
    df = spark.createDataFrame(rows, "session_id string, id long, kind string, text string, risk string, confidence double, priority int")
    assert sorted(tuple(r) for r in memory.near_duplicates(df, keep=3).collect()) == sorted(want)


def test_rewards(spark):
    memories = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "id string, q_value double")
    rewards = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.0), ("x", 1, 1.0), ("a", 3, None)], "memory_id string, line long, reward double")
    got = {r["id"]: r for r in memory.fold_rewards(memories, rewards).collect()}
    assert got["a"]["q_value"] == pytest.approx(0.48) and (got["a"]["hits"], got["a"]["successes"], got["a"]["failures"]) == (2, 1, 1) and got["b"]["q_value"] == 0.5


def test_retrieval(spark):
    m = spark.createDataFrame(
        [("a", "case", "repo", "accepted", "alpha parser", "r1", 0.5, 0.0, "low", None), ("b", "case", "repo", "accepted", "alpha alpha", "r2", 0.5, 0.0, "low", None),
         ("c", "case", "global", "candidate", "alpha", None, 0.5, 0.0, "low", None), ("d", "policy", "repo", "accepted", "linked only", "r2", 0.9, 0.0, "low", 1.0)],
        "id string, kind string, scope string, status string, text string, origin_repo string, q_value double, quality_avg double, risk string, age_days double",
    )
    links = spark.createDataFrame([("a", "d"), ("a", "gone")], "src string, dst string")
    q = spark.createDataFrame([(1, "ALPHA"), (2, "nothing")], "qid int, query string")
    got = memory.retrieve(q, m, links, search.postings(m), cwd="r1")
    assert {r["id"] for r in got.collect()} == {"a", "d"}
    assert {r["id"] for r in memory.retrieve(q, m, links, search.postings(m), cwd="r1", include_candidates=True).collect()} == {"a", "c", "d"}
    assert memory.dangling(links, m).count() == 1
    assert memory.weave(got, m).first()["block"].startswith("- [")
    made = memory.normalise(spark.createDataFrame([("", "x y", 0.0)], "id string, text string, confidence double")).first()
    assert made["id"].startswith("x-y-") and made["confidence"] == 0.5 and made["status"] == "candidate" and made["priority"] == 3


def test_usage(spark):
    lines = spark.createDataFrame(
        [("h", "s", 1, "m", "r", "x", '{"input_tokens":5,"cache_read_input_tokens":2}', None), ("h", "s", 2, "m", "r", "x", '{"input_tokens":5}', None),
         ("h", "s", 3, None, None, "x", '{"output_tokens":1,"cache_creation":{"a":3,"b":4}}', 0.5), ("h", "s", 4, "n", "r", "<synthetic>", '{"input_tokens":9}', None)],
        "host string, session_id string, ord int, message_id string, request_id string, model string, usage string, cost_usd double",
    )
    r = accounting.usage_by_message(lines).first()
    assert (r["input_tokens"], r["cached_input_tokens"], r["output_tokens"], r["cache_creation_tokens"], r["embedded_cost"]) == (5, 2, 1, 7, 0.5)
    columns = ", ".join(f"{c} long" for c in accounting.COUNTERS)
    totals = spark.createDataFrame([("h", "s", 1, "m", 10, 0, 0, 0, 0, 0), ("h", "s", 2, None, 25, 0, 0, 0, 0, 0), ("h", "s", 3, "n", 20, 0, 0, 0, 0, 0)], f"host string, session_id string, ord int, model string, {columns}")
    assert {r["model"]: r["input_tokens"] for r in accounting.usage_by_total(totals).collect()} == {"m": 25}


def test_cost_modes(spark):
    priced = spark.createDataFrame([("h", "s", 1.0, 0.5, 0.25, 0.25, 0.0, 2.0), ("h", "t", 3.0, 3.0, 0.0, 0.0, 0.0, None)], "host string, session_id string, cost double, cost_input double, cost_cache_create double, cost_cache_read double, cost_output double, embedded_cost double")
    got = {m: {r["session_id"]: (r["total"], r["input"], r["source"]) for r in accounting.session_cost(priced, m).collect()} for m in ("auto", "calculate", "display")}
    assert got["auto"] == {"s": (2.0, 1.0, "embedded"), "t": (3.0, 3.0, "calculated")}
    assert got["calculate"]["s"] == (1.0, 0.5, "calculated") and got["display"]["t"] == (None, 0.0, "empty")
    with pytest.raises(ValueError):
        accounting.session_cost(priced, "other")


def test_cutoff_and_new_rows(spark):
    for n in (1, 2, 5, 23):
        values = [float((i * 7) % 11) for i in range(n)]
        positive = sorted(v for v in values if v > 0)
        got = portfolio.high_cost_cutoff(spark.createDataFrame([(v,) for v in values], "cost double")).first()["cutoff"]
        assert got == (positive[max(0, int(0.8 * len(positive)) - 1)] if positive else None)
    known = spark.createDataFrame([("a", 5, 1), ("b", 5, 1)], "id string, size long, mtime long")
    found = spark.createDataFrame([("a", 5, 1), ("b", 6, 1), ("c", 1, 1)], "id string, size long, mtime long")
    assert {r["id"] for r in joins.new_rows(found, known, "id").collect()} == {"b", "c"}


def test_interval_join(spark):
    spans = spark.createDataFrame([("k", 0, 7300), ("k", 5000, 4000)], "key string, a long, b long").select("key", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("end"))
    points = spark.createDataFrame([("k", 0), ("k", 7300), ("k", 7301), ("j", 5)], "key string, t long").select("key", F.timestamp_seconds("t").alias("ts"))
    assert joins.within(points, spans, "key").count() == 2


def test_streams(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 3).alias("user_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.read_stream(spark, f"{tmp_path}/in", rows.schema)
    for name, df in (("activity", streams.session_activity(stream)), ("blocks", streams.billing_blocks(stream))):
        query = df.writeStream.outputMode("complete" if name == "blocks" else "append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("blocks").agg(F.sum("n")).first()[0] == 40
    assert windows.top_k(spark.table("blocks"), ["n"], [F.col("start")], 1).count() >= 1


def test_costs_of_a_day_do_not_depend_on_the_order_of_its_sessions(spark, monkeypatch):
    from loomlog.plans import portfolio_queries as Q

    units = [123456789012345, 1, 3, 7] * 20  # as doubles their sum is off by some units
    rows = spark.createDataFrame([("codex", i, "2024-01-01", 1, 1, u / 1e11, 1) for i, u in enumerate(units)], "host string, session_id long, day string, project long, tokens long, cost double, n_events long")
    for order in ("session_id", "-session_id", "cost"):
        monkeypatch.setattr(Q, "_sessions", lambda *_: rows.coalesce(1).sortWithinPartitions(F.expr(order)))
        assert Q.by_day(spark, "").first()["cost"] == sum(units)


def test_points_are_counted_without_a_row_for_each_pair(spark):
    rnd = random.Random(3)
    at = lambda c: F.timestamp_seconds(c)
    points = [(rnd.choice("ab"), rnd.randrange(40)) for _ in range(60)] + [(None, 3), ("a", None)]
    spans = [(rnd.choice("abc"), str(i), x := rnd.randrange(40), x + rnd.choice([-1, 0, 5, 30])) for i in range(30)]
    p = spark.createDataFrame(points, "key string, t long").select("key", at("t").alias("ts"))
    s = spark.createDataFrame(spans, "key string, id string, a long, b long").select("key", "id", at("a").alias("start"), at("b").alias("end"))
    got = {r["id"]: r["n"] for r in joins.count_within(p, s, "key", ["id"]).collect()}
    assert got == {i: sum(k == q and t is not None and a <= t <= b for q, t in points) for k, i, a, b in spans if a <= b}
    n = 30_000  # 900,000,000 pairs
    many = spark.range(n).select(F.lit("k").alias("key"), at("id").alias("ts"))
    wide = spark.range(n).select(F.lit("k").alias("key"), "id", at(F.lit(0)).alias("start"), at(F.lit(n)).alias("end"))
    assert joins.count_within(many, wide, "key", ["id"]).agg(F.min("n"), F.max("n"), F.count("*")).first() == (n, n, n)


def test_tasks_of_usage_are_as_many_as_its_lines_ask_for(spark, monkeypatch):
    from loomlog.plans import portfolio_queries
    from loomlog.sources import views

    monkeypatch.setattr(views, "LINES", 200)
    folder = "/root/testdata/sf0.001"
    rows = views.usage(spark, folder)
    assert rows.rdd.getNumPartitions() == -(-views.table(spark, folder, "lineitem").count() // 200)
    plan = portfolio_queries.bucket_costs(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("relation [l_orderkey") == 1  # read once
