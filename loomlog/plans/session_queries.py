"""Queries over whole sessions and what is made of them, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..operators import joins as J
from ..operators import memory as M
from ..operators import mining, reports, signals
from ..operators import portfolio as R
from ..operators import sessions as S
from ..operators import trajectory as T
from ..sources import discovery as D
from ..sources import transcripts
from ..sources.views import HOST_A, HOST_B, SESSION_EVENTS_SQL, USER_TEXTS, event_steps, memories, session_events, table

KEYS = ["host", "session_id"]
#: Ranks by points.
RANKS = [(float("-inf"), "Novice Prompt Mechanic"), (300, "Context Orchestrator"), (1000, "Systems Director")]
FIRST_SIGNALS = (
    "command_count", "file_edit_count", "unique_files_edited", "unique_files_read", "web_search_count", "user_message_count", "assistant_message_count", "session_duration_seconds",
    "time_to_first_edit_seconds", "user_correction_count", "failed_command_count", "failed_command_ratio", "user_satisfaction_lexical", "interrupted_signal", "secret_exposure_count",
    "secret_exposure_signal", "unknown_event_count", "events_without_timestamps", "capture_gap_signal",
)


def failure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = session_events(spark, sf_dir)
    payload, kind = F.col("payload"), F.col("event_type")
    return e.select("event_id", P.failed_event(payload, kind).alias("analyzer"), P.failed_dashboard(payload, kind).alias("dashboard"), P.failed_turn(payload).alias("turn"), P.web_search(F.col("summary"), X.tool_name(payload), "miner").alias("searched"))


def session_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = signals.measure(session_events(spark, sf_dir), list(FIRST_SIGNALS))
    return measured.select(*KEYS, *[F.col(n).cast("long").alias(n) if signals.REGISTRY[n][0] == "numeric" and "ratio" not in n else F.col(n) for n in FIRST_SIGNALS])


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.readings(signals.measure(session_events(spark, sf_dir), list(FIRST_SIGNALS)))


def signal_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.aggregate(_readings(spark, sf_dir))


def signal_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.histogram(_readings(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def signal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the signals' summary, of flags and categories."""
    r = _readings(spark, sf_dir).where("kind <> 'numeric'")
    return reports.signal_summary(signals.aggregate(r), signals.histogram(r))


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_steps(spark, sf_dir).select(*KEYS).distinct()
    n = F.col("session_id").cast("long")
    return s.select(
        *KEYS, F.when(n % 5 == 0, F.concat(F.lit(" Title "), n.cast("string"), F.lit("\nmore"))).alias("title"), F.when(n % 4 == 0, "m1").alias("model"), F.when(n % 7 == 0, "OpenAI-x").alias("model_provider"),
        F.when(n % 3 == 0, F.concat(F.lit("p"), (n % 4).cast("string"))).alias("project_slug"), F.when(n % 11 != 0, F.concat(F.lit("/home/u/w"), (n % 6).cast("string"), F.lit("/"))).alias("cwd"),
    )


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summarise(session_events(spark, sf_dir), _meta(spark, sf_dir), HOST_A, HOST_B)


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return _sessions(spark, sf_dir).select(
        *KEYS, "title", "date", F.col("duration_seconds").cast("long").alias("duration_seconds"), "event_count", pairs("event_counts").alias("event_counts"), pairs("actor_counts").alias("actor_counts"),
        "user_messages", "assistant_messages", "tool_result_events", "command_events", "failed_events", "file_read_events", "file_edit_events", "web_search_events", "rate_limit_hits", "events_without_timestamps",
        "unique_files_touched", F.array_join("files_touched", ",").alias("files_touched"), F.array_join(F.transform("top_tools", lambda x: F.concat(x["name"], F.lit("="), x["count"])), ",").alias("top_tools"),
        "provider", F.array_join("models", ",").alias("models"), "cost_model", "project_name", "project_path",
    )


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with tokens and costs that follow from their numbers; every ninth has no cost."""
    s = _sessions(spark, sf_dir)
    n = F.col("session_id").cast("long")
    cost = lambda k: F.when(n % 9 != 0, (F.col("event_count") * k).cast("double") / 64)
    return s.select(
        "*", (F.col("event_count") * (n % 3)).alias("tokens"), cost(1).alias("cost_input"), cost(2).alias("cost_cache_create"), cost(3).alias("cost_cache_read"), cost(4).alias("cost_output"), cost(10).alias("cost"), n.alias("rank"),
    )


def portfolio_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.days(_priced(spark, sf_dir), (HOST_A, HOST_B))


def portfolio_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.overall(_priced(spark, sf_dir))
    return out.withColumn("avg_duration_seconds", F.col("avg_duration_seconds").cast("long"))


def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project_list(_priced(spark, sf_dir)).withColumn("hosts", F.array_join("hosts", ","))


def operator_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = T.measure(event_steps(spark, sf_dir)).select(*KEYS, "exploration_ratio", "exploitation_ratio")
    s = _priced(spark, sf_dir).join(ratios, KEYS, "left")
    k = table(spark, sf_dir, "events").select((F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int") % 4).alias("k"))
    tools = k.groupBy(F.element_at(F.array(F.lit("cargo"), F.lit("python"), F.lit("npm"), F.lit("go")), F.col("k") + 1).alias("name")).agg(F.count("*").alias("count"))
    return R.operator(s, tools).withColumn("recommendations", F.array_join("recommendations", "|"))


def session_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their readings as a map; of a signal read twice the later one holds."""
    r = _readings(spark, sf_dir).where("signal in ('command_count', 'user_satisfaction_lexical', 'capture_gap_signal')").withColumn("ord", F.lit(1))
    again = r.where("signal = 'command_count'").withColumn("ord", F.lit(2)).withColumn("value_num", F.col("value_num") + 1)
    s = _meta(spark, sf_dir).select(*KEYS)
    out = S.with_readings(s, r.unionByName(again).where("session_id <> '7'"))
    return out.select(*KEYS, F.size("signals_index").alias("n"), *[F.col("signals_index")[k].alias(k) for k in ("command_count", "user_satisfaction_lexical", "capture_gap_signal")])


def _trajectory_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = T.measure(event_steps(spark, sf_dir))
    names = ("step_count", "sequence_entropy", "action_redundancy", *(f"action_ratio_{c}" for c in T.CATEGORIES))
    flags = ("validation_presence", "premature_finish_without_validation")
    empty = F.lit(None)
    parts = [F.struct(F.lit(f"trajectory_{n}").alias("signal"), F.lit("numeric").alias("kind"), F.col(n).cast("double").alias("value_num"), empty.cast("boolean").alias("value_bool"), empty.cast("string").alias("value_str")) for n in names]
    parts += [F.struct(F.lit(f"trajectory_{n}").alias("signal"), F.lit("boolean").alias("kind"), empty.cast("double").alias("value_num"), F.col(n).alias("value_bool"), empty.cast("string").alias("value_str")) for n in flags]
    return m.select(*KEYS, F.inline(F.array(*parts)))


def experiments_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.experiments(signals.aggregate(_trajectory_readings(spark, sf_dir)))


def experiment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step counts of host A's sessions that repeat themselves, by title."""
    rows = S.experiment_rows(_trajectory_readings(spark, sf_dir), _meta(spark, sf_dir)).where("signal = 'trajectory_step_count'")
    badges = T.badges(T.measure(event_steps(spark, sf_dir)))
    return S.filter_experiments(rows.join(badges, KEYS), host=HOST_A, badge="repeat", text="1").select(*KEYS, "title", F.col("value_num").alias("steps"))


def refinements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.refinements(session_events(spark, sf_dir))
    return found.select(*KEYS, "rule", "kind", "confidence", "priority", "scope", F.array_join("evidence_refs", ",").alias("refs"))


def compact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.compact(session_events(spark, sf_dir), 20, 5).select("event_id")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories as candidates that two methods found in sessions of one user each."""
    m = memories(spark, sf_dir)
    return m.select(
        F.when(F.col("id") % 2 == 0, HOST_A).otherwise(HOST_B).alias("host"), (F.col("id") % 40).cast("string").alias("session_id"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("method"),
        F.col("id").cast("string").alias("id"), "kind", "scope", "origin_repo", F.substring("text", 1, 30).alias("text"), F.lit("when it fits").alias("when_to_use"), "confidence", "priority", "risk",
        F.when(F.col("id") % 5 == 0, "because").alias("scope_reason"), F.array(F.concat(F.lit("e"), F.col("id"))).alias("evidence_refs"),
    )


def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.prompt_block(_candidates(spark, sf_dir))


def candidate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of candidates with a high priority in the dashboard's and the browser's order, of those of one scope and text."""
    c = S.filter_memories(_candidates(spark, sf_dir), text="a", method="a").where("priority >= 4")
    from pyspark.sql import Window

    by = Window.partitionBy("host", "session_id")
    place = lambda form: F.row_number().over(by.orderBy(*reports.candidate_order(form), F.col("id"))).cast("long")
    return c.select("id", place("dashboard").alias("dashboard"), place("browser").alias("browser"))


def mined_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _candidates(spark, sf_dir).select(*KEYS).distinct()
    out = S.with_mined(s, _candidates(spark, sf_dir).where("risk <> 'high' and cast(session_id as int) % 4 <> 1"))
    return out.select(*KEYS, F.array_join(F.transform("mined", lambda x: F.concat(x["method"], F.lit("="), x["n"])), ",").alias("mined"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 3).cast("int").alias("root_rank"), F.concat(F.lit("/r/"), F.col("event_id")).alias("path"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("mtime"))


def first_root_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.first_root_wins(_found(spark, sf_dir)).select("session_id", "root_rank", "path")


def spawn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as threads: each was started by the one of a third of its number."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("thread_id"), F.expr("cast(c_custkey div 3 as string)").alias("parent"))
    out = D.spawn_edges(c.select("parent", F.col("thread_id").alias("child")), c)
    return out.select("thread_id", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.retention(_found(spark, sf_dir), F.lit("2024-02-01 00:00:00").cast("timestamp")).withColumn("age_days", F.round("age_days", 6))


def snapshot_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as models with prices a token in eighths of a millionth, some of them without cache prices or with bad ones."""
    p = table(spark, sf_dir, "part")
    n = lambda k: (F.col("p_size") * k / 8e6).cast("string")
    entry = F.concat(F.lit('{"input_cost_per_token":'), n(1), F.lit(',"output_cost_per_token":'), F.when(F.col("p_size") % 5 == 0, '"free"').otherwise(n(4)), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(',"cache_read_input_token_cost":'), n(2))).otherwise(""), F.lit("}"))
    rates = D.price_rates(p.select(F.col("p_partkey").cast("string").alias("key"), entry.alias("entry")))
    return rates.select("key", *[F.round(c, 6).alias(c) for c in ("input", "output", "cache_read", "cache_create")])


def text_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions on payloads and paths."""
    e = session_events(spark, sf_dir)
    k = F.col("k")
    path = F.concat(F.lit("/Users/u"), k, F.lit("/a/b"), F.when(k % 2 == 0, "/c/d/e").otherwise(""), F.lit("/f.py"))
    content = F.when(k % 3 == 0, F.concat(F.lit('"one '), k, F.lit('"'))).when(k % 3 == 1, F.concat(F.lit('[{"type":"text","text":"a"},{"input_text":"b'), k, F.lit('"},{"image":1}]'))).otherwise("5")
    return e.select(
        "event_id", X.anonymise(path).alias("anonymous"), X.describe_call(F.col("event_type"), F.col("payload")).alias("call"), X.content_text(content).alias("content"),
        F.array_join(X.leaves(F.col("payload")), ",").alias("leaves"), X.clamp(F.when(k % 4 == 0, "x").otherwise((k / 50).cast("string")), 0.0, 1.0, 0.5).alias("clamped"),
        X.stepped(k * 15, RANKS).alias("rank"), X.quoted(F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("a\n\nb"), k))).alias("quoted"), X.cut_lines(F.repeat(F.lit("ab"), k % 8), 9).alias("cut"),
    )


def memory_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    rows = m.select(F.col("id").alias("ord"), (F.col("id") % 1000).cast("string").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), (F.lit(10_000_000) - F.col("id")).alias("created_at"), "q_value", F.array(F.concat(F.lit("e"), F.col("id") % 7), F.lit("x")).alias("evidence"))
    out = M.upsert(rows)
    return out.select("id", "content_hash", "created_at", "q_value", F.col("evidence_count").cast("long").alias("evidence_count"), F.array_join("evidence", ",").alias("evidence"))


def phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often documents have the first two words of each benchmark text one after another, and its third word."""
    b = table(spark, sf_dir, "benchmark")
    w = X.search_tokens(F.col("text"))
    queries = b.select(F.col("item_id").alias("qid"), F.concat(F.get(w, F.lit(0)), F.lit("-"), F.get(w, F.lit(1)), F.lit(" "), F.get(w, F.lit(2))).alias("query")).where("query is not null")
    return M.unit_counts(M.query_units(queries), memories(spark, sf_dir))


def session_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits made during each session, orders standing for commits: the signal's value, null where the session has no times."""
    s = event_steps(spark, sf_dir).groupBy(*KEYS).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("ts").alias("n"))
    spans = s.where("n >= 2").select(*KEYS, (F.col("session_id").cast("long") % 5).alias("repo"), "start", "end")
    commits = event_steps(spark, sf_dir).where("category = 'run_tests'").select((F.col("session_id").cast("long") % 5).alias("repo"), "ts")
    made = J.count_within(commits, spans, "repo", KEYS).withColumnRenamed("n", "made")
    return s.join(made, KEYS, "left").select(*KEYS, F.when(F.col("n") >= 2, F.coalesce("made", F.lit(0))).alias("git_commits_made_during"))


def trajectory_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps built from events: what belongs to each, its category and fingerprint."""
    s = T.build(session_events(spark, sf_dir))
    return s.select(*KEYS, "idx", "action_event_id", F.array_join("result_event_ids", ",").alias("results"), "result_text", "action_text", "category", "fp_key", "failed")


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.skills(session_events(spark, sf_dir))
    return found.select(
        *KEYS, F.col("rank").cast("long").alias("rank"), F.col("turn").cast("long").alias("turn"), "text", "activation", F.array_join("steps", "|").alias("steps"), "termination", "verification", "confidence", "scope", F.array_join("evidence_refs", ",").alias("refs"),
    )


def _raw_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as raw lines of host B: a meta line first, calls with their outputs, messages that are logged twice."""
    e = session_events(spark, sf_dir)
    k = F.col("k").cast("string")
    call = F.concat(F.lit('"call_id":"c'), F.col("k") % 10, F.lit('"'))
    inner = (
        F.when(F.col("of") == "view", F.concat(F.lit('"response_item","payload":{"type":"function_call","name":"read_file","arguments":"{\\"path\\":\\"f'), k, F.lit('\\"}",'), call, F.lit("}")))
        .when(F.col("of") == "click", F.concat(F.lit('"response_item","payload":{"type":"custom_tool_call","name":"apply_patch","input":"p'), k, F.lit('",'), call, F.lit("}")))
        .when(F.col("of") == "purchase", F.concat(F.lit('"response_item","payload":{"type":"function_call_output","output":"o'), k, F.lit('",'), call, F.lit("}")))
        .when((F.col("of") == "signup") & (F.col("k") % 2 == 0), F.concat(F.lit('"event_msg","payload":{"type":"user_message","message":"m'), k, F.lit('"}')))
        .when(F.col("of") == "signup", F.concat(F.lit('"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"m'), k, F.lit('"}]}')))
        .when(F.col("k") % 2 == 0, F.concat(F.lit('"response_item","payload":{"type":"message","role":"developer","content":[{"type":"input_text","text":"d'), k, F.lit('"}]}')))
        .otherwise('"event_msg","payload":{"type":"never_heard_of"}')
    )
    raw = F.concat(F.lit('{"type":'), inner, F.lit("}"))
    return e.select(F.concat(F.lit("/raw/"), "session_id").alias("path"), "session_id", (F.col("ord") + 1).cast("int").alias("line"), raw.alias("raw"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of host B's raw lines: results take the name of the latest earlier call with their id."""
    e = transcripts.normalise_b(_raw_b(spark, sf_dir))
    text = F.coalesce(F.get_json_object("payload", "$.text"), F.get_json_object("payload", "$.output"), F.get_json_object("payload", "$.input"), F.get_json_object("payload", "$.arguments.path"))
    return e.select("event_id", F.col("sequence").cast("long").alias("sequence"), F.col("ord").cast("long").alias("ord"), "actor", "event_type", F.get_json_object("payload", "$.name").alias("name"), text.alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        failure_rules, session_signals, signal_figures, signal_histogram, signal_lines, session_summary, portfolio_days, portfolio_overall, project_list, operator_portfolio, session_readings,
        experiments_summary, experiment_rows, refinements, compact_events, prompt_blocks, candidate_orders, mined_sessions, first_root_wins, spawn_edges, retention, snapshot_rates, text_tools,
        memory_upserts, phrase_counts, session_commits, trajectory_steps, raw_events, skills,
    )
}

_SE = SESSION_EVENTS_SQL
_FAILED = "(of = 'purchase' AND k % 9 = 0) OR (of = 'error' AND (k % 2 = 0 OR (k % 10 = 7 AND k % 3 <> 0)))"
_TYPE = "CASE of WHEN 'view' THEN 'file_read' WHEN 'click' THEN 'command' WHEN 'purchase' THEN 'file_edit' WHEN 'signup' THEN 'message' ELSE 'tool_result' END"
_ACTOR = "CASE of WHEN 'signup' THEN 'user' WHEN 'error' THEN 'tool' ELSE 'assistant' END"
_TOOL = "CASE of WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Bash' WHEN 'purchase' THEN 'Edit' END"
_SIGNALS = f"""{_SE}, sig AS (SELECT host, session_id, count(*) FILTER (WHERE of = 'click') AS command_count, count(*) FILTER (WHERE of = 'purchase') AS file_edit_count,
  count(DISTINCT file) FILTER (WHERE of = 'purchase') AS unique_files_edited, count(DISTINCT file) FILTER (WHERE of = 'view') AS unique_files_read, CAST(0 AS BIGINT) AS web_search_count,
  count(*) FILTER (WHERE of = 'signup') AS user_message_count, CAST(0 AS BIGINT) AS assistant_message_count,
  CASE WHEN count(stamp) >= 2 THEN CAST(epoch(max(stamp)) - epoch(min(stamp)) AS BIGINT) END AS session_duration_seconds,
  CASE WHEN min_by(stamp, ord) FILTER (WHERE of = 'purchase' AND stamp IS NOT NULL) >= min_by(stamp, ord) FILTER (WHERE of = 'signup' AND stamp IS NOT NULL)
    THEN CAST(epoch(min_by(stamp, ord) FILTER (WHERE of = 'purchase' AND stamp IS NOT NULL)) - epoch(min_by(stamp, ord) FILTER (WHERE of = 'signup' AND stamp IS NOT NULL)) AS BIGINT) END AS time_to_first_edit_seconds,
  count(*) FILTER (WHERE of = 'signup' AND k % 5 IN (1, 2, 3)) AS user_correction_count, count(*) FILTER (WHERE bad) AS failed_command_count,
  round_even(count(*) FILTER (WHERE of = 'error' AND bad) / nullif(CAST(count(*) FILTER (WHERE of = 'error') AS DOUBLE), 0), 4) AS failed_command_ratio,
  CASE max_by(k, ord) FILTER (WHERE of = 'signup') % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 3 THEN 'negative' WHEN 2 THEN 'neutral' WHEN 4 THEN 'neutral' END AS user_satisfaction_lexical,
  false AS interrupted_signal, CAST(0 AS BIGINT) AS secret_exposure_count, false AS secret_exposure_signal, CAST(0 AS BIGINT) AS unknown_event_count,
  count(*) FILTER (WHERE stamp IS NULL) AS events_without_timestamps, bool_or(stamp IS NULL) AS capture_gap_signal FROM se GROUP BY host, session_id)"""
_KINDS = {n: signals.REGISTRY[n][0] for n in FIRST_SIGNALS}
_LONG = " UNION ALL ".join(
    f"SELECT '{n}' AS signal, '{kind}' AS kind, {f'CAST({n} AS DOUBLE)' if kind == 'numeric' else 'CAST(NULL AS DOUBLE)'} AS v, {n if kind == 'boolean' else 'CAST(NULL AS BOOLEAN)'} AS b, {n if kind == 'categorical' else 'CAST(NULL AS VARCHAR)'} AS s FROM sig"
    for n, kind in _KINDS.items()
)
_HIST = "hist AS (SELECT signal, s AS value, count(*) AS n, row_number() OVER (PARTITION BY signal ORDER BY count(*) DESC, s) AS rank FROM r WHERE s IS NOT NULL GROUP BY signal, s)"
_TRUTH = "count(*) FILTER (WHERE b) AS t, count(*) FILTER (WHERE NOT b) AS f"
_META = """meta AS (SELECT DISTINCT host, session_id, CASE WHEN n % 5 = 0 THEN 'Title ' || n END AS title, CASE WHEN n % 4 = 0 THEN 'm1' END AS model, n % 7 = 0 AS openai,
  CASE WHEN n % 3 = 0 THEN 'p' || (n % 4) END AS slug, CASE WHEN n % 11 <> 0 THEN '/home/u/w' || (n % 6) || '/' END AS cwd, n FROM (SELECT host, session_id, CAST(session_id AS BIGINT) AS n FROM ev))"""
_SESSIONS = f"""{_SE}, {_META},
files AS (SELECT host, session_id, count(*) AS n, string_agg(file, ',' ORDER BY file) FILTER (WHERE r <= 100) AS list FROM (SELECT host, session_id, file, row_number() OVER (PARTITION BY host, session_id ORDER BY file) AS r FROM (SELECT DISTINCT host, session_id, file FROM se WHERE of IN ('view', 'purchase'))) GROUP BY host, session_id),
tools AS (SELECT host, session_id, string_agg(tool || '=' || n, ',' ORDER BY n DESC, f) AS list FROM (SELECT host, session_id, {_TOOL} AS tool, count(*) AS n, min(ord) AS f FROM se WHERE of IN ('view', 'click', 'purchase') GROUP BY ALL) GROUP BY host, session_id),
named AS (SELECT host, session_id, 'm' || (k % 3) AS model, ord FROM se WHERE of = 'error' UNION ALL SELECT host, session_id, model, -1 FROM meta WHERE model IS NOT NULL),
models AS (SELECT host, session_id, string_agg(model, ',' ORDER BY n DESC, f) AS list FROM (SELECT host, session_id, model, count(*) AS n, min(ord) AS f FROM named GROUP BY ALL) GROUP BY host, session_id),
kinds AS (SELECT host, session_id, string_agg(t || '=' || n, ',' ORDER BY t) AS list FROM (SELECT host, session_id, {_TYPE} AS t, count(*) AS n FROM se GROUP BY ALL) GROUP BY host, session_id),
actors AS (SELECT host, session_id, string_agg(t || '=' || n, ',' ORDER BY t) AS list FROM (SELECT host, session_id, {_ACTOR} AS t, count(*) AS n FROM se GROUP BY ALL) GROUP BY host, session_id),
base AS (SELECT host, session_id, coalesce(min_by(says, ord) FILTER (WHERE of = 'signup'), min_by(coalesce({_TOOL}, 'tool_result: Bash'), ord)) AS said, coalesce(strftime(min(stamp), '%Y-%m-%d'), 'unknown') AS date,
  CASE WHEN count(stamp) >= 2 THEN CAST(epoch(max(stamp)) - epoch(min(stamp)) AS BIGINT) END AS duration_seconds, count(*) AS event_count, count(*) FILTER (WHERE of = 'signup') AS user_messages,
  count(*) FILTER (WHERE of = 'error') AS tool_result_events, count(*) FILTER (WHERE of = 'click') AS command_events, count(*) FILTER (WHERE {_FAILED}) AS failed_events, count(*) FILTER (WHERE of = 'view') AS file_read_events,
  count(*) FILTER (WHERE of = 'purchase') AS file_edit_events, count(*) FILTER (WHERE of = 'signup' AND k % 5 = 2) AS rate_limit_hits, count(*) FILTER (WHERE stamp IS NULL) AS events_without_timestamps FROM se GROUP BY host, session_id),
ss AS (SELECT base.*, coalesce(meta.title, said) AS title, coalesce(files.n, 0) AS unique_files_touched, files.list AS files_touched, tools.list AS top_tools, models.list AS models, kinds.list AS event_counts, actors.list AS actor_counts,
  CASE WHEN openai THEN 'openai' WHEN host = 'claude-code' THEN 'anthropic' ELSE 'openai' END AS provider, coalesce(slug, regexp_extract(cwd, '([^/]+)/$', 1), 'unknown') AS project_name, CASE WHEN slug IS NOT NULL THEN '' ELSE coalesce(cwd, '') END AS project_path, meta.n AS num
  FROM base JOIN meta USING (host, session_id) LEFT JOIN files USING (host, session_id) LEFT JOIN tools USING (host, session_id) LEFT JOIN models USING (host, session_id) LEFT JOIN kinds USING (host, session_id) LEFT JOIN actors USING (host, session_id))"""
_COSTS = {"cost_input": 1, "cost_cache_create": 2, "cost_cache_read": 3, "cost_output": 4, "cost": 10}
_PRICED = f"""{_SESSIONS}, pr AS (SELECT *, event_count * (num % 3) AS tokens, {", ".join(f"CASE WHEN num % 9 <> 0 THEN event_count * {k} / 64.0 END AS {c}" for c, k in _COSTS.items())}, CAST(0 AS BIGINT) AS assistant_messages, CAST(0 AS BIGINT) AS tool_call_events, CAST(0 AS BIGINT) AS unknown_events FROM ss)"""
_SUM = lambda c: f"round_even(coalesce(sum({c}), 0.0), 6) AS {c}" if c.startswith("cost") else f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}"
_TRAJ = """ent AS (SELECT host, session_id, round_even(-sum(p * log2(p)), 4) AS e FROM (SELECT host, session_id, category, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY host, session_id) AS p FROM ev GROUP BY host, session_id, category) GROUP BY host, session_id),
tj AS (SELECT host, session_id, count(*) AS steps, count(*) - count(DISTINCT fp) AS redundancy, coalesce(max(CASE WHEN category = 'run_tests' THEN idx END) > min(CASE WHEN category = 'generate_fix' THEN idx END), false) AS valid,
  coalesce(max(CASE WHEN category = 'generate_fix' THEN idx END) > coalesce(max(CASE WHEN category = 'run_tests' THEN idx END), -1), false) AS premature,
  avg(CAST(category IN ('explore', 'search') AS INTEGER)) AS exploring, avg(CAST(category IN ('generate_fix', 'run_tests') AS INTEGER)) AS exploiting FROM ev GROUP BY host, session_id)"""
_CAND = """WITH {mem}, ca AS (SELECT CASE WHEN id % 2 = 0 THEN 'claude-code' ELSE 'codex' END AS host, CAST(id % 40 AS VARCHAR) AS session_id, CASE WHEN id % 3 = 0 THEN 'b' ELSE 'a' END AS method, CAST(id AS VARCHAR) AS id, kind, scope, origin_repo,
  substr(text, 1, 30) AS text, confidence, priority, risk, CASE WHEN id % 5 = 0 THEN 'because' END AS scope_reason FROM mem)"""
_PICK = lambda texts: " ".join(f"WHEN {i} THEN '" + t.replace("'", "''") + "'" for i, t in enumerate(texts))


def _cand() -> str:
    from ..sources.views import MEMORIES_SQL

    return _CAND.replace("{mem}", MEMORIES_SQL)


def _rule(name: str, when: str, refs: str) -> str:
    kind, _, _, confidence, priority, _, scope, _ = mining.REFINEMENTS[name]
    refs = f"array_to_string(list_slice(list(CAST(event_id AS VARCHAR) ORDER BY ord) FILTER (WHERE {refs}), 1, 8), ',')" if refs else "CAST(min_by(event_id, ord) AS VARCHAR)"
    return f"SELECT host, session_id, '{name}' AS rule, '{kind}' AS kind, CAST({confidence} AS DOUBLE) AS confidence, {priority} AS priority, '{scope}' AS scope, {refs} AS refs FROM se GROUP BY host, session_id HAVING {when}"


_SAYS = lambda *ks: f"(of = 'signup' AND k % 5 IN ({', '.join(map(str, ks))}))"
_ADVICE = {n: t.replace("'", "''") for n, t in R.ADVICE.items()}

ORACLE_SQL = {
    "failure_rules": f"WITH {_SE} SELECT CAST(event_id AS VARCHAR) AS event_id, bad AS analyzer, {_FAILED} AS dashboard, {_FAILED} AS turn, false AS searched FROM se",
    "session_signals": f"WITH {_SIGNALS} SELECT * FROM sig",
    "signal_figures": f"""WITH {_SIGNALS}, r AS ({_LONG}), {_HIST}
SELECT signal, kind, count(*) FILTER (WHERE coalesce(v, CAST(b AS INTEGER)) IS NOT NULL OR s IS NOT NULL) AS present, count(*) FILTER (WHERE v IS NULL AND b IS NULL AND s IS NULL) AS missing, min(v) AS min, max(v) AS max, round_even(avg(v), 3) AS mean,
  median(v) AS median, round_even(quantile_cont(v, 0.9), 3) AS p90, round_even(sum(v), 3) AS total, CASE WHEN kind = 'boolean' THEN count(*) FILTER (WHERE b) END AS true_count, CASE WHEN kind = 'boolean' THEN count(*) FILTER (WHERE NOT b) END AS false_count,
  CASE WHEN kind = 'boolean' THEN round_even(count(*) FILTER (WHERE b) / nullif(CAST(count(b) AS DOUBLE), 0), 3) END AS true_ratio, (SELECT value FROM hist WHERE hist.signal = r.signal AND rank = 1) AS most_common FROM r GROUP BY signal, kind""",
    "signal_histogram": f"WITH {_SIGNALS}, r AS ({_LONG}), {_HIST} SELECT * FROM hist",
    "signal_lines": f"""WITH {_SIGNALS}, r AS ({_LONG}), {_HIST}, g AS (SELECT signal, kind, count(*) FILTER (WHERE b IS NOT NULL OR s IS NOT NULL) AS p, {_TRUTH} FROM r WHERE kind <> 'numeric' GROUP BY signal, kind)
SELECT signal, '| `' || signal || '` | ' || kind || ' | ' || p || ' | ' || CASE WHEN kind = 'boolean' THEN 'true=' || t || '/' || (t + f) || ' (' || coalesce(CAST(round_even(t / nullif(CAST(t + f AS DOUBLE), 0), 3) AS VARCHAR), 'None') || ')'
  ELSE coalesce((SELECT string_agg(value || '=' || n, ', ' ORDER BY rank) FROM hist WHERE hist.signal = g.signal AND rank <= 3), '—') END || ' |' AS line FROM g""",
    "session_summary": f"""WITH {_SESSIONS} SELECT host, session_id, title, date, duration_seconds, event_count, event_counts, actor_counts, user_messages, CAST(0 AS BIGINT) AS assistant_messages, tool_result_events, command_events, failed_events, file_read_events, file_edit_events,
  CAST(0 AS BIGINT) AS web_search_events, rate_limit_hits, events_without_timestamps, unique_files_touched, files_touched, top_tools, provider, models, coalesce(split_part(models, ',', 1), CASE WHEN provider = 'openai' THEN 'gpt-5' END) AS cost_model, project_name, project_path FROM ss""",
    "portfolio_days": f"WITH {_PRICED} SELECT date, count(*) AS sessions, count(*) FILTER (WHERE host = 'claude-code') AS sessions_a, count(*) FILTER (WHERE host = 'codex') AS sessions_b, {', '.join(map(_SUM, R.DAY_SUMS))} FROM pr GROUP BY date",
    "portfolio_overall": f"""WITH {_PRICED} SELECT count(*) AS sessions, {', '.join(map(_SUM, R.TOTAL_SUMS))}, count(*) FILTER (WHERE tokens > 0) AS sessions_with_tokens, count(cost) AS sessions_with_cost, count(DISTINCT date) FILTER (WHERE date <> 'unknown') AS active_days,
  CAST(floor(avg(duration_seconds)) AS BIGINT) AS avg_duration_seconds, round_even(sum(event_count) / CAST(count(*) AS DOUBLE), 1) AS avg_events, 0.0 AS avg_tool_calls, count(DISTINCT project_name) FILTER (WHERE project_name <> 'unknown') AS projects FROM pr""",
    "project_list": f"""WITH {_PRICED} SELECT project_name AS name, coalesce(max_by(project_path, num) FILTER (WHERE project_path <> ''), '') AS path, count(*) AS sessions, CAST(sum(tokens) AS BIGINT) AS tokens, round_even(sum(cost), 6) AS cost, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts FROM pr GROUP BY 1""",
    "operator_portfolio": f"""WITH {_PRICED}, {_TRAJ}, s AS (SELECT avg(user_messages) AS turns, sum(failed_events) / CAST(sum(command_events) AS DOUBLE) AS fails, avg(round_even(exploring, 4)) AS explore, avg(round_even(exploiting, 4)) AS exploit, sum(coalesce(cost, 0.0)) / count(*) AS cost FROM pr JOIN tj USING (host, session_id)),
t AS (SELECT count(*) FILTER (WHERE k % 4 IN (0, 3)) AS a, count(*) FILTER (WHERE k % 4 = 1) AS b, count(*) FILTER (WHERE k % 4 = 2) AS c FROM se)
SELECT round_even(turns, 1) AS avg_turns, round_even(fails, 3) AS cmd_failure_rate, round_even(explore, 3) AS explore_ratio, round_even(exploit, 3) AS exploit_ratio, round_even(cost, 4) AS avg_cost,
  CASE WHEN a > b AND a > c THEN 'Systems Programmer' WHEN b > a AND b > c THEN 'Data Scientist / ML Engineer' WHEN c > a AND c > b THEN 'Frontend Engineer' ELSE 'General Software Engineer' END AS role,
  CASE WHEN explore > 0.65 OR turns > 25 OR fails > 0.2 THEN concat_ws('|', CASE WHEN explore > 0.65 THEN '{_ADVICE["explore"]}' END, CASE WHEN turns > 25 THEN '{_ADVICE["turns"]}' END, CASE WHEN fails > 0.2 THEN '{_ADVICE["failures"]}' END) ELSE '{_ADVICE["fine"]}' END AS recommendations FROM s, t""",
    "session_readings": f"""WITH {_SIGNALS} SELECT host, session_id, CASE WHEN session_id <> '7' THEN 3 END AS n, CASE WHEN session_id <> '7' THEN (command_count + 1) || '.0' END AS command_count, CASE WHEN session_id <> '7' THEN user_satisfaction_lexical END AS user_satisfaction_lexical,
  CASE WHEN session_id <> '7' THEN CAST(capture_gap_signal AS VARCHAR) END AS capture_gap_signal FROM sig""",
    "experiments_summary": f"""WITH {_SE}, {_TRAJ}, c AS (SELECT category, avg(x) AS m FROM (SELECT host, session_id, y.category, round_even(count(*) FILTER (WHERE ev.category = y.category) / CAST(count(*) AS DOUBLE), 4) AS x FROM ev, (SELECT unnest({list(T.CORE)}) AS category) y GROUP BY ALL) GROUP BY category)
SELECT CAST({5 + len(T.CATEGORIES)} AS BIGINT) AS signal_count, round_even(avg(steps), 3) AS avg_steps, count(*) FILTER (WHERE premature) AS unvalidated_sessions, count(*) FILTER (WHERE valid) AS validation_sessions, round_even(avg(e), 3) AS mean_entropy,
  round_even(avg(redundancy), 3) AS mean_redundancy, (SELECT category FROM c ORDER BY round_even(m, 3) DESC, category DESC LIMIT 1) AS top_category FROM tj JOIN ent USING (host, session_id)""",
    "experiment_rows": f"""WITH {_SE}, {_META}, a AS (SELECT *, {', '.join(f"lag(category, {i}) OVER w AS c{i}, lag(fp, {i}) OVER w AS f{i}" for i in (1, 2, 3))} FROM ev WINDOW w AS (PARTITION BY host, session_id ORDER BY idx))
SELECT a.host, a.session_id, coalesce(' ' || any_value(title) || chr(10) || 'more', a.session_id) AS title, CAST(count(*) AS DOUBLE) AS steps FROM a JOIN meta USING (host, session_id) WHERE a.host = 'claude-code' GROUP BY a.host, a.session_id
HAVING count(*) FILTER (WHERE (category = c1 AND fp = f1) OR (category = c2 AND fp = f2) OR (category = c3 AND fp = f3)) > 0 AND contains(lower(a.host || ' ' || a.session_id || ' ' || coalesce(' ' || any_value(title) || chr(10) || 'more', a.session_id)), '1')""",
    "refinements": f"""WITH {_SE}, r AS ({_rule("corrected", f"bool_or({_SAYS(2)})", _SAYS(2))} UNION ALL {_rule("documented", "bool_or(of = 'purchase')", "of = 'purchase'")}
  UNION ALL {_rule("captured", f"bool_or({_SAYS(4)})", _SAYS(4))})
SELECT * FROM r UNION ALL {_rule("nothing", f"NOT (bool_or({_SAYS(2, 4)}) OR bool_or(of = 'purchase'))", "")}""",
    "compact_events": f"WITH {_SE} SELECT CAST(event_id AS VARCHAR) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY host, session_id ORDER BY ord) AS u, row_number() OVER (PARTITION BY host, session_id ORDER BY ord DESC) AS d, count(*) OVER (PARTITION BY host, session_id) AS n FROM se WHERE of <> 'view') WHERE n <= 25 OR u <= 20 OR d <= 5",
    "prompt_blocks": f"""{_cand()}, b AS (SELECT *, row_number() OVER (PARTITION BY host, session_id, method ORDER BY priority DESC, confidence DESC, kind, id) AS rank FROM ca WHERE risk IN ('low', 'medium')),
t AS (SELECT host, session_id, method, string_agg(rank || '. [' || kind || '; scope=' || scope || '; confidence=' || printf('%.2f', confidence) || '; risk=' || risk || ']' || chr(10) || '   When to use: when it fits' || chr(10) || '   Memory: ' || text || chr(10)
  || coalesce('   Scope reason: ' || scope_reason || chr(10), '') || '   Evidence: e' || id, chr(10) ORDER BY rank) AS items FROM b WHERE rank <= 8 GROUP BY host, session_id, method)
SELECT host, session_id, method, '<memories method="' || method || '" source="' || host || '/' || session_id || '">' || chr(10) || 'Use these memories as soft guidance. Ignore any memory that does not fit the current task.' || chr(10) || chr(10) || coalesce(items || chr(10), '') || '</memories>' || chr(10) AS block
FROM (SELECT DISTINCT host, session_id, method FROM ca) LEFT JOIN t USING (host, session_id, method)""",
    "candidate_orders": f"""{_cand()} SELECT id, row_number() OVER (PARTITION BY host, session_id ORDER BY priority DESC, confidence DESC, coalesce(kind, ''), id) AS dashboard,
  row_number() OVER (PARTITION BY host, session_id ORDER BY priority DESC, confidence DESC, list_position(['user', 'global', 'task', 'repo'], scope), id) AS browser FROM ca WHERE contains(lower(concat_ws(' ', text, 'when it fits', origin_repo)), 'a') AND method = 'a' AND priority >= 4""",
    "mined_sessions": f"""{_cand()}, m AS (SELECT host, session_id, string_agg(method || '=' || n, ',' ORDER BY method) AS mined FROM (SELECT host, session_id, method, count(*) AS n FROM ca WHERE risk <> 'high' AND CAST(session_id AS INTEGER) % 4 <> 1 GROUP BY ALL) GROUP BY host, session_id)
SELECT host, session_id, coalesce(mined, '') AS mined FROM (SELECT DISTINCT host, session_id FROM ca) LEFT JOIN m USING (host, session_id)""",
    "first_root_wins": "SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id % 3 AS INTEGER) AS root_rank, '/r/' || event_id AS path FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, ts DESC, '/r/' || event_id) AS r FROM events) WHERE r = 1",
    "spawn_edges": """SELECT CAST(c_custkey AS VARCHAR) AS thread_id, CAST(c_custkey // 3 AS VARCHAR) AS parents, coalesce((SELECT string_agg(CAST(x.c_custkey AS VARCHAR), ',' ORDER BY CAST(x.c_custkey AS VARCHAR)) FROM customer x WHERE x.c_custkey // 3 = c.c_custkey), '') AS children FROM customer c""",
    "retention": "SELECT round(a, 6) AS age_days, a >= 25 AS warn FROM (SELECT (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(min(ts))) / 86400000000.0 AS a FROM events)",
    "snapshot_rates": """SELECT CAST(p_partkey AS VARCHAR) AS key, round(p_size / 8.0, 6) AS input, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE round(p_size * 4 / 8.0, 6) END AS output, CASE WHEN p_size % 3 = 0 THEN round(p_size * 2 / 8.0, 6) ELSE round(p_size / 8.0, 6) END AS cache_read, round(p_size / 8.0, 6) AS cache_create FROM part""",
    "text_tools": f"""WITH {_SE}, x AS (SELECT *, CASE WHEN k % 10 = 7 THEN '{{"exit_code": ' || (k % 3) || '}}' ELSE 'Process exited with code ' || (k % 3) END AS output FROM se)
SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN k % 2 = 0 THEN '~/…/d/e/f.py' ELSE '~/a/b/f.py' END AS anonymous,
  CASE of WHEN 'view' THEN 'read file (' || file || ')' WHEN 'click' THEN 'run shell (' || command || ')' WHEN 'purchase' THEN 'edit file' WHEN 'signup' THEN 'message' ELSE 'tool_result' END AS call,
  CASE k % 3 WHEN 0 THEN 'one ' || k WHEN 1 THEN 'a' || chr(10) || 'b' || k ELSE '' END AS content,
  CASE of WHEN 'view' THEN 'Read,' || file WHEN 'click' THEN 'Bash,' || command WHEN 'purchase' THEN 'Edit,add,' || CASE WHEN k % 9 = 0 THEN 'failed' ELSE 'done' END WHEN 'signup' THEN says ELSE CASE WHEN k % 2 = 0 THEN '' ELSE 'true,' END || output || ',m' || (k % 3) END AS leaves,
  CASE WHEN k % 4 = 0 THEN 0.5 ELSE least(1.0, k / CAST(50 AS DOUBLE)) END AS clamped, CASE WHEN k * 15 < 300 THEN 'Novice Prompt Mechanic' WHEN k * 15 < 1000 THEN 'Context Orchestrator' ELSE 'Systems Director' END AS rank,
  CASE WHEN k % 5 = 0 THEN '> ' ELSE '> a' || chr(10) || '>' || chr(10) || '> b' || k END AS quoted, CASE WHEN k % 8 > 4 THEN substr(repeat('ab', k % 8), 1, 8) || chr(10) || '… [truncated]' ELSE repeat('ab', k % 8) END AS cut FROM x""",
    "memory_upserts": """WITH r AS (SELECT doc_id AS ord, CAST(doc_id % 1000 AS VARCHAR) AS raw, sha256(coalesce(text, '')) AS content_hash, 10000000 - doc_id AS created_at, (doc_id % 11) / 10.0 AS q_value, doc_id % 7 AS e FROM documents),
p AS (SELECT r.*, f.id FROM r JOIN (SELECT content_hash, min_by(raw, ord) AS id FROM r GROUP BY content_hash) f USING (content_hash))
SELECT id, max_by(content_hash, ord) AS content_hash, min(created_at) AS created_at, max_by(q_value, ord) AS q_value, 2 * count(*) AS evidence_count, string_agg(DISTINCT 'e' || e, ',' ORDER BY 'e' || e) || ',x' AS evidence FROM p GROUP BY id""",
    "phrase_counts": """WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM documents),
b AS (SELECT item_id AS qid, list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM benchmark),
u AS (SELECT qid, w[1] || '-' || w[2] AS unit, w[1] AS one, w[2] AS two FROM b UNION ALL SELECT qid, w[3], w[3], NULL FROM b WHERE w[3] IS NOT NULL),
t AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d),
h AS (SELECT u.qid, u.unit, x.id FROM u JOIN t x ON x.term = u.one LEFT JOIN t y ON y.id = x.id AND y.pos = x.pos + 1 AND y.term = u.two WHERE u.two IS NULL OR y.id IS NOT NULL)
SELECT qid, unit, id, count(*) AS tf FROM h GROUP BY ALL""",
    "session_commits": f"""WITH {_SE}, s AS (SELECT host, session_id, min(ts) AS a, max(ts) AS b, count(ts) AS n, CAST(session_id AS BIGINT) % 5 AS repo FROM ev GROUP BY host, session_id)
SELECT host, session_id, CASE WHEN n >= 2 THEN (SELECT count(*) FROM ev c WHERE c.category = 'run_tests' AND CAST(c.session_id AS BIGINT) % 5 = s.repo AND c.ts BETWEEN s.a AND s.b) END AS git_commits_made_during FROM s""",
    "trajectory_steps": f"""WITH {_SE}, n AS (SELECT *, sum(CASE WHEN of IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY host, session_id ORDER BY ord) AS step FROM se),
r AS (SELECT host, session_id, step, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ord) AS results, string_agg('tool_result: Bash', chr(10)) AS result_text FROM n WHERE of = 'error' AND step > 0 GROUP BY host, session_id, step),
a AS (SELECT *, CASE of WHEN 'view' THEN 'file_read assistant read read file_path=' || file WHEN 'click' THEN 'command assistant bash ' || command || ' command=' || command ELSE 'file_edit assistant edit edit' END AS fp FROM n WHERE of IN ('view', 'click', 'purchase'))
SELECT host, session_id, CAST(step - 1 AS BIGINT) AS idx, CAST(event_id AS VARCHAR) AS action_event_id, coalesce(results, '') AS results, coalesce(result_text, '') AS result_text,
  CASE of WHEN 'view' THEN 'Read' WHEN 'click' THEN command ELSE 'Edit' END AS action_text,
  CASE WHEN of = 'view' THEN 'explore' WHEN of = 'purchase' THEN CASE WHEN k % 9 = 0 THEN 'error' ELSE 'generate_fix' END ELSE CASE k % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'run_tests' WHEN 2 THEN 'explore' ELSE 'other' END END AS category,
  substr(sha256(fp), 1, 12) AS fp_key, false AS failed FROM a LEFT JOIN r USING (host, session_id, step)""",
    "raw_events": f"""WITH {_SE}, t AS (SELECT *, last_value(CASE of WHEN 'view' THEN 'read_file' WHEN 'click' THEN 'apply_patch' END IGNORE NULLS) OVER (PARTITION BY session_id, CASE WHEN of IN ('view', 'click', 'purchase') THEN k % 10 END ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tool
  FROM se WHERE NOT (of = 'signup' AND k % 2 = 1))
SELECT session_id || ':' || (ord + 1) AS event_id, CAST(ord + 1 AS BIGINT) AS sequence, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS ord, CASE of WHEN 'signup' THEN 'user' WHEN 'purchase' THEN 'tool' WHEN 'error' THEN 'system' ELSE 'assistant' END AS actor,
  CASE of WHEN 'view' THEN 'file_read' WHEN 'click' THEN 'file_edit' WHEN 'purchase' THEN 'tool_result' WHEN 'signup' THEN 'message' ELSE CASE WHEN k % 2 = 0 THEN 'message' ELSE 'unknown' END END AS event_type,
  CASE of WHEN 'view' THEN 'read_file' WHEN 'click' THEN 'apply_patch' WHEN 'purchase' THEN coalesce(tool, '?') END AS name,
  CASE of WHEN 'view' THEN 'f' || k WHEN 'click' THEN 'p' || k WHEN 'purchase' THEN 'o' || k WHEN 'signup' THEN 'm' || k ELSE CASE WHEN k % 2 = 0 THEN 'd' || k END END AS text FROM t""",
    "skills": f"""WITH {_SE}, n AS (SELECT *, sum(CASE WHEN of = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY host, session_id ORDER BY ord) AS turn,
    CASE of WHEN 'view' THEN 'read file (' || file || ')' WHEN 'click' THEN 'run shell (' || command || ')' WHEN 'purchase' THEN 'edit file' END AS line, of IN ('view', 'click', 'purchase') AS made FROM se),
g AS (SELECT host, session_id, turn, max(says) AS asked, max(CASE WHEN of = 'signup' THEN k % 5 END) AS mood, max(CASE WHEN of = 'signup' THEN CAST(event_id AS VARCHAR) END) AS asked_id, count(*) FILTER (WHERE made) AS calls, count(*) FILTER (WHERE of = 'purchase') AS edits,
  bool_or(of = 'error' AND (k % 2 = 0 OR (k % 10 = 7 AND k % 3 <> 0))) AS failed, list(line ORDER BY ord) FILTER (WHERE made) AS lines, list(CAST(event_id AS VARCHAR) ORDER BY ord) FILTER (WHERE made) AS ids,
  list(CASE WHEN of = 'click' AND k % 4 = 1 THEN command ELSE '' END ORDER BY ord DESC) FILTER (WHERE made) AS tests, max_by(file, ord) FILTER (WHERE of = 'purchase') AS edited, count(*) FILTER (WHERE of = 'click') AS clicks,
  max_by(of, ord) FILTER (WHERE made) AS last FROM n GROUP BY host, session_id, turn),
h AS (SELECT *, lead(mood) OVER w AS next_mood, lead(asked_id) OVER w AS next_id, list_filter(tests[1:6], lambda x: x <> '') AS ran FROM g WINDOW w AS (PARTITION BY host, session_id ORDER BY turn)),
b AS (SELECT *, row_number() OVER (PARTITION BY host, session_id ORDER BY edits DESC, calls DESC, turn) AS rank FROM h WHERE calls >= 2 AND NOT failed AND coalesce(next_mood, 0) NOT IN (1, 3))
SELECT host, session_id, rank, CAST(turn AS BIGINT) AS turn, 'Skill: ' || CASE WHEN edits > 0 THEN 'edit-then-verify workflow' WHEN clicks > 0 THEN 'investigate via shell commands' ELSE 'multi-step tool workflow' END AS text, coalesce(asked, '(no opening user message)') AS activation,
  array_to_string(lines[1:10], '|') || CASE WHEN calls > 10 THEN '|… (+' || (calls - 10) || ' more)' ELSE '' END AS steps,
  CASE WHEN edits > 0 THEN 'after writing ' || '/srv/' || split_part(edited, '/', 3) || '/docs/' || split_part(edited, '/', 5) WHEN last = 'click' THEN 'after the final command returns exit code 0' ELSE 'after `Read` returns success' END AS termination,
  CASE WHEN len(ran) > 0 THEN 'verified by running `' || ran[1] || '`' WHEN edits > 0 AND clicks = 0 THEN 'verified by reviewing the resulting file diff' ELSE '(no explicit verification observed)' END AS verification,
  round_even(CASE WHEN next_mood = 0 THEN 0.75 ELSE 0.55 END + CASE WHEN len(ran) > 0 OR (edits > 0 AND clicks = 0) THEN 0.05 ELSE 0.0 END, 2)::DOUBLE AS confidence, CASE WHEN edits > 0 OR clicks > 0 THEN 'task' ELSE 'repo' END AS scope,
  concat_ws(',', asked_id, array_to_string(ids[1:4], ','), next_id) AS refs FROM b WHERE rank <= 4""",
}
