"""Queries over events of all kinds: signals that they trigger, reports, and mining to the end; with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import joins, mining, reports, signals
from ..operators.windows import SESSION
from ..sources.views import HOST_A, HOST_B, TYPED_EVENTS_SQL, typed_events

TRIGGERED = ("web_search_count", "assistant_message_count", "interrupted_signal", "secret_exposure_count", "secret_exposure_signal", "unknown_event_count", "failed_command_count", "capture_gap_signal")


def signal_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of sessions that have searches, interruptions, secrets behind quotes and unknown events, and of some that have none."""
    return signals.measure(typed_events(spark, sf_dir), list(TRIGGERED)).withColumn("secret_exposure_count", F.col("secret_exposure_count").cast("long"))


def analysis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = typed_events(spark, sf_dir)
    return reports.analysis(e, joins.calls(e), (HOST_A, HOST_B))


def named_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call with its command and whether its result failed."""
    return joins.calls(typed_events(spark, sf_dir)).select("event_id", "tool", "is_command", "command_line", "base_command", "failed")


def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One procedure a session, mined and filtered."""
    p = mining.mine(typed_events(spark, sf_dir), "procedures", ("risk_aware",))
    s = F.col("structured")
    return p.select(
        *SESSION, "id", "rank", "text", "when_to_use", "confidence", "priority", "scope", "scope_reason", "origin_repo", F.array_join("evidence_refs", ",").alias("refs"), s["goal"].alias("goal"),
        *[F.array_join(s[c], "|").alias(c) for c in ("preconditions", "steps", "warnings")], s["outcome"].alias("outcome"),
    )


def refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed candidates behind the filter by risk, confidence and likeness."""
    found = mining.mine(typed_events(spark, sf_dir), "refine", ("risk_aware",))
    return found.select(*SESSION, "rule", "id", "rank", "confidence", "priority", F.array_join("evidence_refs", ",").alias("refs"))


QUERIES = {f.__name__: f for f in (signal_triggers, analysis_report, named_calls, procedures, refined)}

_q = lambda s: s.replace("'", "''")
_ANY = lambda t, needles: "(" + " OR ".join(f"contains({t}, '{_q(n)}')" for n in needles) + ")"
_AT = lambda *paths: ", ".join(f"payload ->> '$.{p}'" for p in paths)
_TEXT = f"coalesce({_AT('text', 'message', 'thinking')}, summary, '')"
_SECRETS = " + ".join(f"len(regexp_extract_all(txt, '{_q(p)}'))" for p in P.SECRET_PATTERNS.values())
_CALLS = f"""{TYPED_EVENTS_SQL}, c AS (SELECT *, payload ->> '$.name' AS tool, CASE WHEN event_type = 'command' THEN payload ->> '$.input.command' END AS command_line, row_number() OVER (PARTITION BY host, session_id ORDER BY ord) AS n
  FROM te WHERE actor = 'assistant' AND event_type IN ('tool_call', 'command', 'file_read', 'file_edit')),
r AS (SELECT host, session_id, k % 3 <> 0 AS bad, row_number() OVER (PARTITION BY host, session_id ORDER BY ord) AS n FROM te WHERE actor = 'tool'),
calls AS (SELECT c.host, c.session_id, c.event_id, tool, event_type = 'command' AS is_command, command_line, coalesce(split_part(command_line, ' ', 1), '') AS base_command, coalesce(bad, false) AS failed FROM c LEFT JOIN r USING (host, session_id, n))"""
_PCT = lambda a, b: f"format('{{:.1f}}%', CASE WHEN {b} > 0 THEN {a} * 100.0 / {b} ELSE 0.0 END)"
_FIXED = lambda section, lines: " UNION ALL ".join(f"SELECT {section}, {i - len(lines)}, '{_q(line)}'" for i, line in enumerate(lines))


def _table(i: int, title: str, column: str, key: str) -> str:
    shown = "CASE WHEN length(key) > 60 THEN substr(key, 1, 57) || '...' ELSE key END" if key == "command_line" else "key"
    only = "" if key == "tool" else "WHERE is_command"
    return f"""{_FIXED(i, ("", f"## {title}", "", f"| {column} | Host | Executions | Failure Rate |", "|---|---|---|---|"))}
UNION ALL SELECT {i}, rank, '| `' || {shown} || '` | ' || host || ' | ' || n || ' | ' || {_PCT("f", "n")} || ' |' FROM (SELECT *, row_number() OVER (ORDER BY n DESC, key, host) AS rank FROM (SELECT {key} AS key, host, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM calls {only} GROUP BY ALL)) WHERE rank <= 15"""


_TABLES = "\nUNION ALL ".join(_table(i, *t) for i, t in enumerate(reports.ANALYSIS_TABLES, 1))
_PHASE = "CASE WHEN actor <> 'assistant' THEN NULL WHEN event_type = 'command' THEN 'ran # shell command' WHEN event_type = 'file_edit' THEN 'edited # file' WHEN event_type = 'file_read' THEN 'read # file' WHEN event_type = 'tool_call' THEN CASE payload ->> '$.name' WHEN 'WebSearch' THEN 'performed # web research call' ELSE 'delegated # sub-task' END END"
_FOUND = " || ".join(f"list_transform(regexp_extract_all(txt, '(?i){_q(p)}'), lambda x: {{'p': {i}, 'piece': regexp_replace(trim(x), '\\.+$', '')}})" for i, p in enumerate(mining.WARNINGS))
_ROW = lambda name: f"'{name}' AS rule, {mining.REFINEMENTS[name][3]}::DOUBLE AS confidence, {mining.REFINEMENTS[name][4]} AS priority, '{mining.REFINEMENTS[name][0]}' AS kind"


def _rule(name: str, flag: str, proof: str) -> str:
    return f"SELECT host, session_id, {list(mining.REFINEMENTS).index(name)} AS place, {_ROW(name)}, array_to_string((list(event_id ORDER BY ord) FILTER (WHERE {proof}))[1:8], ',') AS refs FROM e GROUP BY host, session_id HAVING {flag}"


_MINED = {
    "corrected": (_ANY("low", mining.CORRECTION_NEEDLES) + " AND actor = 'user'", None),
    "searched": ("contains(lower(summary), 'search')", None),
}
ORACLE_SQL = {
    "signal_triggers": f"""WITH {TYPED_EVENTS_SQL}, x AS (SELECT *, concat_ws(chr(10), summary, {_AT('text', 'thinking', 'name', 'cwd', 'input.command', 'input.query', 'input.file_path', 'gitBranch', 'output', 'type', 'message')}) AS txt, lower(summary) || ' ' || substr(lower(raw), 1, 500) AS low FROM te)
SELECT host, session_id, count(*) FILTER (WHERE payload ->> '$.name' = 'WebSearch' OR contains(lower(summary), 'web_search')) AS web_search_count, count(*) FILTER (WHERE actor = 'assistant' AND event_type = 'message') AS assistant_message_count,
  bool_or({_ANY("low", P.INTERRUPT_NEEDLES)}) AS interrupted_signal, CAST(least(50, sum({_SECRETS})) AS BIGINT) AS secret_exposure_count, sum({_SECRETS}) > 0 AS secret_exposure_signal, count(*) FILTER (WHERE event_type = 'unknown') AS unknown_event_count,
  count(*) FILTER (WHERE regexp_extract(coalesce(payload ->> '$.output', ''), 'Process exited with code ([0-9]+)', 1) NOT IN ('', '0')) AS failed_command_count, bool_or(event_type = 'unknown') AS capture_gap_signal FROM x GROUP BY host, session_id""",
    "named_calls": f"WITH {_CALLS} SELECT CAST(event_id AS VARCHAR) AS event_id, tool, is_command, command_line, base_command, failed FROM calls",
    "analysis_report": f"""WITH {_CALLS}, h AS (SELECT * FROM (VALUES ('{HOST_A}', 1), ('{HOST_B}', 2), ('total', 3)) AS v(host, rank)),
s AS (SELECT h.host, rank, count(DISTINCT te.host || '/' || session_id) AS s FROM h LEFT JOIN te ON h.host IN (te.host, 'total') GROUP BY ALL),
o AS (SELECT h.host, count(*) FILTER (WHERE is_command) AS c, count(*) FILTER (WHERE is_command AND failed) AS cf, count(calls.host) AS t, count(*) FILTER (WHERE failed) AS tf FROM h LEFT JOIN calls ON h.host IN (calls.host, 'total') GROUP BY h.host),
t AS (SELECT a, event_type AS b, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY host, session_id ORDER BY ord) AS a FROM te) WHERE a IS NOT NULL GROUP BY ALL),
lines(section, rank, line) AS ({_FIXED(0, reports.ANALYSIS_HEAD)}
UNION ALL SELECT 0, rank, '| ' || CASE host WHEN 'total' THEN 'Total (All Hosts)' ELSE host END || ' | ' || s || ' | ' || c || ' | ' || {_PCT("cf", "c")} || ' | ' || t || ' | ' || {_PCT("tf", "t")} || ' |' FROM s JOIN o USING (host)
UNION ALL {_TABLES}
UNION ALL {_FIXED(4, reports.TRANSITIONS_HEAD)}
UNION ALL SELECT 4, rank, '| ' || a || ' | ' || b || ' | ' || n || ' |' FROM (SELECT *, row_number() OVER (ORDER BY n DESC, a, b) AS rank FROM t) WHERE rank <= 15
UNION ALL SELECT 5, -1, '') SELECT CAST(section AS INTEGER) AS section, CAST(rank AS INTEGER) AS rank, line FROM lines""",
    "procedures": f"""WITH {TYPED_EVENTS_SQL}, e AS (SELECT *, {_TEXT} AS txt, {_PHASE} AS phase FROM te),
b AS (SELECT host, session_id, arg_min(txt, ord) FILTER (WHERE actor = 'user') AS goal, min(payload ->> '$.cwd') AS cwd, arg_min(payload ->> '$.gitBranch', ord) FILTER (WHERE event_type = 'file_edit') AS branch,
  arg_max(txt, ord) FILTER (WHERE actor = 'assistant' AND event_type = 'message') AS outcome, count(*) FILTER (WHERE event_type = 'file_edit') AS edits, arg_min(event_id, ord) AS first FROM e GROUP BY host, session_id),
p AS (SELECT *, sum(CASE WHEN was IS DISTINCT FROM phase THEN 1 ELSE 0 END) OVER (PARTITION BY host, session_id ORDER BY ord) AS run FROM (SELECT *, lag(phase) OVER (PARTITION BY host, session_id ORDER BY ord) AS was FROM e WHERE phase IS NOT NULL)),
s AS (SELECT host, session_id, string_agg(replace(phase, '#', CAST(n AS VARCHAR)) || CASE WHEN n = 1 THEN '' ELSE 's' END, '|' ORDER BY run) AS steps, count(*) AS n FROM (SELECT host, session_id, run, any_value(phase) AS phase, count(*) AS n FROM p WHERE run <= 12 GROUP BY ALL) GROUP BY host, session_id),
f AS (SELECT host, session_id, ord, u.p AS p, u.piece AS piece FROM (SELECT host, session_id, ord, unnest({_FOUND}) AS u FROM e WHERE event_type = 'message') WHERE length(u.piece) BETWEEN 5 AND 139),
w AS (SELECT host, session_id, string_agg(piece, '|' ORDER BY place) AS warnings FROM (SELECT *, row_number() OVER (PARTITION BY host, session_id ORDER BY place) AS r FROM (SELECT host, session_id, lower(piece) AS l, min(ord * 10 + p) AS place, arg_min(piece, ord * 10 + p) AS piece FROM f GROUP BY ALL)) WHERE r <= 5 GROUP BY host, session_id),
v AS (SELECT host, session_id, array_to_string(list(event_id ORDER BY ord)[1:6], ',') AS refs FROM (SELECT *, row_number() OVER (PARTITION BY host, session_id, event_type ORDER BY ord) AS r FROM e WHERE event_type IN ('message', 'command', 'file_edit', 'tool_call')) WHERE r <= 2 GROUP BY host, session_id)
SELECT host, session_id, session_id || ':procedures:1' AS id, 1 AS rank, CASE WHEN goal IS NULL THEN 'Procedure for this rollout''s overall task' ELSE 'Procedure for: ' || goal END AS text, CASE WHEN goal IS NULL THEN 'Use when starting a task with a similar overall shape.' ELSE 'Use when the user''s request resembles: ' || goal END AS when_to_use,
  round_even(least(0.85, 0.45 + 0.05 * n + 0.05 * edits), 2)::DOUBLE AS confidence, CASE WHEN n >= 3 THEN 4 ELSE 2 END AS priority, CASE WHEN cwd IS NOT NULL AND edits > 0 THEN 'repo' ELSE 'task' END AS scope,
  CASE WHEN cwd IS NULL THEN 'no origin repo known; treating as task-shaped procedure' WHEN edits = 0 THEN 'session has no file edits inside the origin repo' ELSE 'procedure edits ' || edits || ' file(s) inside ' || cwd END AS scope_reason, cwd AS origin_repo, refs, coalesce(goal, '') AS goal,
  concat_ws('|', 'host=' || host, 'cwd=' || cwd, 'git_branch=' || branch) AS preconditions, steps, coalesce(warnings, '') AS warnings, coalesce(outcome, '') AS outcome FROM b JOIN s USING (host, session_id) LEFT JOIN w USING (host, session_id) LEFT JOIN v USING (host, session_id)""",
    "refined": f"""WITH {TYPED_EVENTS_SQL}, e AS (SELECT *, lower({_TEXT}) AS low FROM te),
m AS ({_rule("corrected", f"bool_or({_MINED['corrected'][0]})", _MINED["corrected"][0])} UNION ALL {_rule("searched", f"bool_or({_MINED['searched'][0]})", _MINED["searched"][0])}
  UNION ALL SELECT host, session_id, 4, {_ROW("nothing")}, CAST(arg_min(event_id, ord) AS VARCHAR) FROM e GROUP BY host, session_id HAVING NOT bool_or({_MINED['corrected'][0]}) AND NOT bool_or({_MINED['searched'][0]})),
n AS (SELECT *, session_id || ':refine:' || row_number() OVER (PARTITION BY host, session_id ORDER BY place) AS id FROM m)
SELECT host, session_id, rule, id, CAST(row_number() OVER (PARTITION BY host, session_id ORDER BY priority DESC, confidence DESC, kind, id) AS INTEGER) AS rank, confidence, priority, refs FROM n WHERE confidence >= 0.4""",
}
