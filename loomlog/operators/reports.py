"""Reports and artifacts as DataFrames of text, written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.folders import durable
from .windows import SESSION, top_k

#: Characters of a message, a result, an input and a JSON value that a transcript shows.
MESSAGE_CHARS, RESULT_CHARS, INPUT_CHARS, VALUE_CHARS = 8000, 4000, 2000, 600


def joined(rows: DataFrame, keys: list[str], order: str | Column, line: Column, name: str, by: str = "\n") -> DataFrame:
    """The lines of each key in order as one text; a group must fit a task, as one report does."""
    lines = F.array_sort(F.collect_list(F.struct(F.struct(order).alias("o"), line.alias("line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["line"]), by).alias(name))


def rendered_event(kind: Column, actor: Column, payload: Column, summary: Column, stamp: Column) -> Column:
    """One event in Markdown, by its kind."""
    text = X.event_text(payload, summary)
    output = F.coalesce(F.get_json_object(payload, "$.output"), F.get_json_object(payload, "$.content"), F.lit(""))
    given = F.coalesce(F.get_json_object(payload, "$.input"), F.get_json_object(payload, "$.arguments"), F.lit(""))
    head = F.concat(F.lit("### "), kind, F.lit(" · "), F.coalesce(actor, F.lit("unknown")), F.coalesce(F.concat(F.lit(" · "), stamp), F.lit("")))
    body = (
        F.when(kind == "message", X.cut_lines(text, MESSAGE_CHARS))
        .when(kind == "reasoning", X.quoted(X.cut_lines(text, RESULT_CHARS)))
        .when(kind.isin("tool_result", "error"), X.fenced(X.cut_lines(F.coalesce(F.nullif(output, F.lit("")), text), RESULT_CHARS)))
        .when(kind.isin("command", "tool_call", "file_read", "file_edit"), F.concat(F.coalesce(summary, F.lit("")), F.lit("\n"), X.fenced(X.cut_lines(given, INPUT_CHARS))))
        .otherwise(X.truncate(F.coalesce(summary, payload, F.lit("")), VALUE_CHARS))
    )
    return F.concat(head, F.lit("\n\n"), body)


def transcript(events: DataFrame) -> DataFrame:
    """(host, session_id, markdown): a header with the number of events of each kind, then the events in order."""
    kinds = events.groupBy(*SESSION, "event_type").agg(F.count("*").alias("n"))
    header = joined(kinds, list(SESSION), "event_type", F.concat(F.lit("- "), F.col("event_type"), F.lit(": "), F.col("n")), "_counts")
    line = rendered_event(*[F.col(c) for c in ("event_type", "actor", "payload", "summary", "timestamp")])
    body = joined(events, list(SESSION), "ord", line, "_body", "\n\n")
    title = F.concat(F.lit("# Session "), F.col("session_id"), F.lit(" ("), F.col("host"), F.lit(")"))
    return body.join(header, list(SESSION)).select(*SESSION, F.concat_ws("\n\n", title, "_counts", "_body").alias("markdown"))


#: Headings of the analysis report, and the columns of its tables.
ANALYSIS_HEAD = (
    "# Command & Tool Use Analysis Report", "", "This report analyzes command execution, tool usage, and transition patterns ", "across all capture agent sessions.", "",
    "## Overview Summary", "", "| Host | Sessions | Total Commands | Command Failure Rate | Total Tool Calls | Tool Failure Rate |", "|---|---|---|---|---|---|",
)
ANALYSIS_TABLES = (("Top Base Commands", "Base Command", "base_command"), ("Top Full Command Lines", "Command Line", "command_line"), ("Top Tool Calls", "Tool Name", "tool"))
TRANSITIONS_HEAD = ("", "## Action Transition Patterns", "", "| From Event Type | To Event Type | Occurrences |", "|---|---|---|")


def _percent(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f%%", F.bround(F.when(whole > 0, part / whole * 100).otherwise(0.0), 1))


def analysis(events: DataFrame, calls: DataFrame, hosts: tuple[str, ...], k: int = 15) -> DataFrame:
    """The analysis report, (section, rank, line), to be written in this order.

    An overview by host and of all, then the ``k`` most frequent base commands,
    command lines and tools by host with how many failed (``calls`` as joins.calls
    gives them), and the transitions between event types.  Ties go by name and host.
    """
    spark = events.sparkSession
    fixed = lambda section, lines: spark.createDataFrame([(section, i - len(lines), line) for i, line in enumerate(lines)], "section int, rank int, line string")
    # commands without a line count as tools only
    command = F.col("is_command") & F.col("command_line").isNotNull()
    # all tables sum up these counts, so that calls are matched with their results once
    calls = durable(calls.groupBy("host", "tool", "is_command", "command_line", "base_command").agg(F.count("*").alias("_n"), F.count_if("failed").alias("_f")))
    total = lambda c, when=None: F.coalesce(F.sum(F.col(c) if when is None else F.when(when, F.col(c))), F.lit(0))
    both = lambda df: df.where(F.col("host").isin(*hosts)).withColumn("host", F.explode(F.array(F.col("host"), F.lit("total"))))
    counted = both(calls).groupBy("host").agg(total("_n", command).alias("c"), total("_f", command).alias("cf"), total("_n").alias("t"), total("_f").alias("tf"))
    sessions = both(events.select(*SESSION).distinct()).groupBy("host").agg(F.count("*").alias("s"))
    place = spark.createDataFrame([(h, i + 1) for i, h in enumerate((*hosts, "total"))], "host string, rank int")
    known = place.join(sessions, "host", "left").join(counted, "host", "left").fillna(0)
    label = F.when(F.col("host") == "total", "Total (All Hosts)").otherwise(F.col("host"))
    line = F.format_string("| %s | %d | %d | %s | %d | %s |", label, "s", "c", _percent(F.col("cf"), F.col("c")), "t", _percent(F.col("tf"), F.col("t")))
    out = fixed(0, ANALYSIS_HEAD).unionByName(known.select(F.lit(0).alias("section"), "rank", line.alias("line")))
    for i, (title, column, key) in enumerate(ANALYSIS_TABLES, 1):
        used = calls.where(F.col("host").isin(*hosts)).where(F.lit(True) if key == "tool" else command)
        n = used.groupBy(F.col(key).alias("key"), "host").agg(total("_n").alias("n"), total("_f").alias("f"))
        best = top_k(n.withColumn("_all", F.lit(0)), ["_all"], [F.desc("n"), F.col("key"), F.col("host")], k)
        shown = F.when(F.length("key") > 60, F.concat(F.substring("key", 1, 57), F.lit("..."))).otherwise(F.col("key")) if key == "command_line" else F.col("key")
        line = F.format_string("| `%s` | %s | %d | %s |", shown, "host", "n", _percent(F.col("f"), F.col("n")))
        out = out.unionByName(fixed(i, ("", f"## {title}", "", f"| {column} | Host | Executions | Failure Rate |", "|---|---|---|---|"))).unionByName(best.select(F.lit(i).alias("section"), "rank", line.alias("line")))
    before = F.lag("event_type").over(Window.partitionBy(*SESSION).orderBy("ord"))
    steps = events.where(F.col("host").isin(*hosts)).select(before.alias("a"), F.col("event_type").alias("b")).where("a is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    best = top_k(steps.withColumn("_all", F.lit(0)), ["_all"], [F.desc("n"), F.col("a"), F.col("b")], k)
    last = len(ANALYSIS_TABLES) + 1
    out = out.unionByName(fixed(last, TRANSITIONS_HEAD)).unionByName(best.select(F.lit(last).alias("section"), "rank", F.format_string("| %s | %s | %d |", "a", "b", "n").alias("line")))
    return out.unionByName(fixed(last + 1, ("",)))


def signal_summary(aggregates: DataFrame, histogram: DataFrame) -> DataFrame:
    """(signal, line): a line of the signals' summary table; what it says depends on the signal's kind."""
    top = histogram.where("rank <= 3")
    top = joined(top, ["signal"], "rank", F.concat("value", F.lit("="), F.col("n").cast("string")), "_top", ", ")
    says = (
        F.when((F.col("kind") == "numeric") & F.col("mean").isNotNull(), F.concat(F.lit("mean="), F.col("mean"), F.lit(", median="), F.col("median"), F.lit(", max="), F.col("max")))
        .when(F.col("kind") == "boolean", F.concat(F.lit("true="), F.col("true_count"), F.lit("/"), F.col("true_count") + F.col("false_count"), F.lit(" ("), F.coalesce(F.col("true_ratio").cast("string"), F.lit("None")), F.lit(")")))
        .when(F.col("_top").isNotNull(), F.col("_top")).otherwise("—")
    )
    line = F.concat(F.lit("| `"), F.col("signal"), F.lit("` | "), F.col("kind"), F.lit(" | "), F.col("present"), F.lit(" | "), says, F.lit(" |"))
    return aggregates.join(top, "signal", "left").select("signal", line.alias("line"))


def write_signals(readings: DataFrame, aggregates: DataFrame, summary: DataFrame, folder: str) -> None:
    """Readings by host as JSON lines, aggregates as JSON, and the summary's lines in order as text."""
    readings.write.mode("overwrite").partitionBy("host").json(f"{folder}/readings")
    aggregates.coalesce(1).write.mode("overwrite").json(f"{folder}/aggregates")
    summary.orderBy("signal").coalesce(1).select("line").write.mode("overwrite").text(f"{folder}/summary")


def write_mined(candidates: DataFrame, blocks: DataFrame, folder: str) -> None:
    """Candidates by method and host as JSON, and their prompt blocks as text."""
    candidates.write.mode("overwrite").partitionBy("method", "host").json(f"{folder}/candidates")
    blocks.select("method", "host", F.col("block").alias("value")).write.mode("overwrite").partitionBy("method", "host").text(f"{folder}/blocks")


def candidate_order(form: str = "prompt") -> list[Column]:
    """How candidates are sorted in a prompt, on the dashboard, and in the browser."""
    first = [F.desc("priority"), F.desc("confidence")]
    scopes = F.array_position(F.array(*[F.lit(s) for s in ("user", "global", "task", "repo")]), F.col("scope"))
    return {"prompt": [*first, F.col("kind"), F.col("id")], "dashboard": [*first, F.coalesce("kind", F.lit(""))], "browser": [*first, F.when(scopes == 0, 9).otherwise(scopes)]}[form]


def prompt_block(candidates: DataFrame, k: int = 8) -> DataFrame:
    """(host, session_id, method, block): the ``k`` best candidates of low or medium risk as a block for a prompt."""
    keys = [*SESSION, "method"]
    best = top_k(candidates.where("risk in ('low', 'medium')"), keys, candidate_order("prompt"), k)
    head = F.format_string("%d. [%s; scope=%s; confidence=%.2f; risk=%s]", "rank", "kind", "scope", "confidence", "risk")
    lines = [head, F.concat(F.lit("   When to use: "), F.col("when_to_use")), F.concat(F.lit("   Memory: "), F.col("text")), F.concat(F.lit("   Scope reason: "), F.nullif("scope_reason", F.lit("")))]
    proof = F.coalesce(F.nullif(F.array_join("evidence_refs", ", "), F.lit("")), F.lit("no explicit evidence"))
    blocks = joined(best, keys, "rank", F.concat_ws("\n", *lines, F.concat(F.lit("   Evidence: "), proof)), "_items")
    open_ = F.format_string('<memories method="%s" source="%s/%s">', "method", "host", "session_id")
    guide = F.lit("Use these memories as soft guidance. Ignore any memory that does not fit the current task.")
    every = candidates.select(*keys).distinct().join(blocks, keys, "left")
    return every.select(*keys, F.concat(F.concat_ws("\n", open_, guide, F.lit(""), "_items", F.lit("</memories>")), F.lit("\n")).alias("block"))


def dashboard(sessions: DataFrame, **parts: DataFrame) -> DataFrame:
    """(part, json): each row of the sessions and of the other parts as JSON, for a dashboard to load."""
    out = sessions.select(F.lit("sessions").alias("part"), F.to_json(F.struct("*")).alias("json"))
    for name, rows in parts.items():
        out = out.unionByName(rows.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("json")))
    return out
