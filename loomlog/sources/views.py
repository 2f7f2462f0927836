"""Tables that give the canonical shapes from star-schema and corpus tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hosts of sessions, and the category each event type stands for.
HOST_A, HOST_B = "claude-code", "codex"
CATEGORY_OF = {"view": "explore", "click": "search", "purchase": "generate_fix", "signup": "run_tests", "error": "error"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Events that a task reads the payloads of, about.
EVENTS = 100_000


def event_steps(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Events as the steps of one session a user: host, session_id, idx (from 0), category, fp, failed, ts, value.

    ``spread``: for work that is long for the bytes of its rows, tasks are as many as the rows ask for.
    """
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": *(\d+)', 1)
    category = F.create_map(*[F.lit(x) for kv in CATEGORY_OF.items() for x in kv])[F.col("event_type")]
    order = Window.partitionBy("host", "session_id").orderBy("ts", "event_id")
    df = e.select(
        F.when(F.col("user_id") % 2 == 0, HOST_A).otherwise(HOST_B).alias("host"),
        F.col("user_id").cast("string").alias("session_id"),
        "event_id", "event_type", "ts", "value",
        F.coalesce(category, F.lit("other")).alias("category"),
        F.concat_ws(":", "event_type", k).alias("fp"),
    )
    if spread:
        df = df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(e.count() / EVENTS)), "host", "session_id")
    return df.withColumn("idx", (F.row_number().over(order) - 1).cast("long")).withColumn("failed", F.col("category") == "error")


STEPS_SQL = """ev AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'claude-code' ELSE 'codex' END AS host, CAST(user_id AS VARCHAR) AS session_id,
         event_id, event_type, ts, value,
         CASE event_type WHEN 'view' THEN 'explore' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'generate_fix'
              WHEN 'signup' THEN 'run_tests' WHEN 'error' THEN 'error' ELSE 'other' END AS category,
         event_type || ':' || regexp_extract(props, '"k": *([0-9]+)', 1) AS fp,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
         event_type = 'error' AS failed
  FROM events)"""


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the canonical shape, payloads and all, one session a user; five kinds that differ by the number k of their props."""
    e = event_steps(spark, sf_dir).withColumn("k", F.substring_index("fp", ":", -1).cast("int")).withColumnRenamed("event_type", "of")
    k = F.col("k")
    pick = lambda *texts: F.element_at(F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts]), k % len(texts) + 1)
    json = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    folder = F.concat(F.lit("/srv/p"), k % 7)
    command = pick(F.concat(F.lit("rg needle"), k, F.lit(" src")), F.concat(F.lit("pytest -q tests/t"), k, F.lit(".py")), "ls -la", "npm run build")
    says = pick(*USER_TEXTS)
    output = F.when(k % 10 == 7, F.concat(F.lit('{\\"exit_code\\": '), k % 3, F.lit("}"))).otherwise(F.concat(F.lit("Process exited with code "), k % 3))
    payload = (
        F.when(F.col("of") == "view", json('{"name":"Read","input":{"file_path":"', folder, "/f", k, '.py"}}'))
        .when(F.col("of") == "click", json('{"name":"Bash","input":{"command":"', command, '"}}'))
        .when(F.col("of") == "purchase", json('{"name":"Edit","changes":{"', folder, "/docs/d", k, '.md":{"type":"add"}},"status":"', F.when(k % 9 == 0, "failed").otherwise("done"), '"}'))
        .when(F.col("of") == "signup", json('{"text":"', says, '"}'))
        .otherwise(json('{"is_error":', F.when(k % 2 == 0, "true").otherwise('"true"'), ',"output":"', output, '","model":"m', k % 3, '"}'))
    )
    by = lambda **texts: F.coalesce(*[F.when(F.col("of") == x, F.lit(v)) for x, v in texts.items()])
    return e.select(
        "host", "session_id", F.col("idx").alias("ord"), F.col("event_id").cast("string").alias("event_id"), "of", "k", "value", "ts",
        by(view="assistant", click="assistant", purchase="assistant", signup="user", error="tool").alias("actor"),
        by(view="file_read", click="command", purchase="file_edit", signup="message", error="tool_result").alias("event_type"),
        F.when(F.col("of") == "signup", says).otherwise(by(view="Read", click="Bash", purchase="Edit", error="tool_result: Bash")).alias("summary"),
        payload.alias("payload"),
        F.when(F.col("event_id") % 97 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        F.lit(None).cast("string").alias("parent_event_id"),
    )


#: Fixed values of the view: what users say.
USER_TEXTS = ("thanks, great work", "no, that's wrong", "you're right, rate limit", "please revert it", "the full rollout and memory")
_SAYS = " ".join(f"WHEN {i} THEN '" + t.replace("'", "''") + "'" for i, t in enumerate(USER_TEXTS))
SESSION_EVENTS_SQL = f"""{{steps}}, se AS (
  SELECT host, session_id, idx AS ord, event_id, event_type AS of, k, value, ts,
         CASE WHEN event_type = 'signup' THEN CASE k % 5 {_SAYS} END END AS says,
         '/srv/p' || (k % 7) || CASE event_type WHEN 'view' THEN '/f' || k || '.py' WHEN 'purchase' THEN '/docs/d' || k || '.md' END AS file,
         CASE WHEN event_type = 'click' THEN CASE k % 4 WHEN 0 THEN 'rg needle' || k || ' src' WHEN 1 THEN 'pytest -q tests/t' || k || '.py' WHEN 2 THEN 'ls -la' ELSE 'npm run build' END END AS command,
         CASE WHEN event_id % 97 <> 0 THEN date_trunc('second', ts) END AS stamp,
         (event_type = 'purchase' AND k % 9 = 0) OR (event_type = 'error' AND (k % 2 = 0 OR k % 3 <> 0)) AS bad
  FROM (SELECT *, CAST(split_part(fp, ':', 2) AS INTEGER) AS k FROM ev))""".replace("{steps}", STEPS_SQL)


#: Fixed values of the second event view: actor, type, summary and payload by kind; @k is the number of the props, @m its rest by 3.
KINDS_OF_EVENTS = (
    ("user", "message", "do @k", '{"text":"please don\'t use tabs in f@k. Always run tests @k"}'),
    ("assistant", "message", "said @k", '{"text":"Done: wrote report @k"}'),
    ("tool", "tool_result", "tool_result: Bash", '{"output":"Process exited with code @m","is_error":false}'),
    ("assistant", "file_edit", "Edit", '{"name":"Edit","input":{"file_path":"/srv/p/src/a@k.py"},"gitBranch":"b@k"}'),
    ("assistant", "file_read", "Read", '{"name":"Read","input":{"file_path":"/srv/p/r@k.py"}}'),
    ("assistant", "reasoning", "thought @k", '{"thinking":"look at @k"}'),
    ("assistant", "command", "Bash", '{"name":"Bash","cwd":"/srv/p","input":{"command":"export TOKEN=\\"abcdefghijkl@k\\""}}'),
    ("assistant", "tool_call", "WebSearch(query=q@k)", '{"name":"WebSearch","input":{"query":"q@k"}}'),
    ("system", "unknown", "unknown: type=t@k", '{"type":"t@k"}'),
    ("system", "message", "request was canceled @k", '{"message":"note @k"}'),
    ("assistant", "tool_call", "Task", '{"name":"Task","input":{"n":@k}}'),
    ("assistant", "command", "Bash", '{"name":"Bash","input":{"command":"pytest -q tests/a_test_with_quite_a_long_name_for_a_table_@k.py"}}'),
)


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all kinds, one session a user: every third has only the first five, the others have web searches, secrets, interruptions, thoughts and unknown ones, too."""
    e = event_steps(spark, sf_dir, spread=True).withColumn("k", F.substring_index("fp", ":", -1).cast("int"))
    kind = F.when(F.col("session_id").cast("long") % 3 == 0, F.col("k") % 5).otherwise(F.col("k") % len(KINDS_OF_EVENTS))
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("@k"), F.col("k").cast("string")), F.lit("@m"), (F.col("k") % 3).cast("string"))
    pick = lambda i: F.element_at(F.array(*[filled(row[i]) for row in KINDS_OF_EVENTS]), kind + 1)
    return e.select(
        "host", "session_id", F.col("idx").alias("ord"), F.col("event_id").cast("string").alias("event_id"), "ts", "k", pick(0).alias("actor"), pick(1).alias("event_type"), pick(2).alias("summary"),
        pick(3).alias("payload"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(None).cast("string").alias("parent_event_id"),
    )


_PICK = lambda i: "CASE kind " + " ".join(f"WHEN {n} THEN '" + row[i].replace("'", "''") + "'" for n, row in enumerate(KINDS_OF_EVENTS)) + " END"
_FILLED = lambda i: f"replace(replace({_PICK(i)}, '@k', CAST(k AS VARCHAR)), '@m', CAST(k % 3 AS VARCHAR))"
TYPED_EVENTS_SQL = f"""{STEPS_SQL}, te AS (SELECT host, session_id, idx AS ord, event_id, ts, k, {_PICK(0)} AS actor, {_PICK(1)} AS event_type, {_FILLED(2)} AS summary, CAST({_FILLED(3)} AS JSON) AS payload, {_FILLED(3)} AS raw
  FROM (SELECT *, CASE WHEN CAST(session_id AS BIGINT) % 3 = 0 THEN k % 5 ELSE k % {len(KINDS_OF_EVENTS)} END AS kind FROM (SELECT *, CAST(split_part(fp, ':', 2) AS INTEGER) AS k FROM ev)))"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as message events: session_id, ord, actor, text."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), F.col("role").alias("actor"), "text")


MESSAGES_SQL = "conv AS (SELECT conv_id AS session_id, turn AS ord, role AS actor, text FROM conversations)"

#: Fixed values of the memory view: repositories and scopes by source.
SCOPES = ("global", "user", "task", "repo")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories; labels give quality and risk, doc_id the rest."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    scope = F.array(*[F.lit(s) for s in SCOPES])[(F.col("doc_id") % 4).cast("int")]
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("kind"),
        scope.alias("scope"),
        F.when(F.col("doc_id") % 7 == 0, "candidate").otherwise("accepted").alias("status"),
        "text",
        F.col("source").alias("origin_repo"),
        (F.col("doc_id") % 11 / 10.0).alias("q_value"),
        F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("quality_avg"),
        F.when(F.col("toxic") == 1, "high").when(F.col("toxic") == 0, "low").otherwise("medium").alias("risk"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 30).cast("double").alias("age_days"),
        ((F.col("doc_id") % 5) + 1).cast("int").alias("priority"),
        (F.col("doc_id") % 10 / 10.0).alias("confidence"),
        (F.col("doc_id") % 13).alias("hits"),
    )


MEMORIES_SQL = """mem AS (
  SELECT d.doc_id AS id, lang AS kind, CASE d.doc_id % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'user' WHEN 2 THEN 'task' ELSE 'repo' END AS scope,
         CASE WHEN d.doc_id % 7 = 0 THEN 'candidate' ELSE 'accepted' END AS status, text, source AS origin_repo,
         (d.doc_id % 11) / 10.0 AS q_value, coalesce(CAST(quality AS DOUBLE), 0.0) AS quality_avg,
         CASE toxic WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS risk,
         CASE WHEN d.doc_id % 3 = 0 THEN CAST(d.doc_id % 30 AS DOUBLE) END AS age_days,
         CAST(d.doc_id % 5 + 1 AS INTEGER) AS priority, (d.doc_id % 10) / 10.0 AS confidence, d.doc_id % 13 AS hits
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)"""


#: Order lines that a task joins and sums up, about.
LINES = 300_000


def part_model() -> Column:
    return F.lower(F.concat_ws("-", "p_brand", "p_type"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as token buckets of sessions: one order a session, one brand a model.

    Tasks are as many as the lines ask for, so that none grows with the table;
    a session's lines end up in one of them, and sums by session need no shuffle.
    """
    li = table(spark, sf_dir, "lineitem")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(li.count() / LINES))
    li = li.repartition(n, "l_partkey").join(table(spark, sf_dir, "part").repartition(n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    li = li.repartition(n, "l_orderkey").join(table(spark, sf_dir, "orders").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(
        F.when(F.col("o_orderkey") % 2 == 0, HOST_A).otherwise(HOST_B).alias("host"),
        F.col("o_orderkey").alias("session_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        (F.col("o_custkey") % 50).alias("project"),
        part_model().alias("model"),
        (F.col("l_quantity").cast("long") * 1000).alias("input_tokens"),
        (F.col("l_linenumber").cast("long") * 100).alias("output_tokens"),
        (F.col("l_suppkey") * 10).alias("cached_input_tokens"),
        (F.col("l_partkey") % 97).alias("cache_creation_tokens"),
    )


USAGE_SQL = """usage AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'claude-code' ELSE 'codex' END AS host, o_orderkey AS session_id,
         strftime(o_orderdate, '%Y-%m-%d') AS day, o_custkey % 50 AS project, lower(p_brand || '-' || p_type) AS model,
         CAST(l_quantity AS BIGINT) * 1000 AS input_tokens, CAST(l_linenumber AS BIGINT) * 100 AS output_tokens,
         l_suppkey * 10 AS cached_input_tokens, l_partkey % 97 AS cache_creation_tokens
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
