"""Joins of events within sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from .prefix import Total, scan
from .windows import SESSION, so_far


def match_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (session keys, ord, event_id, call_id) with the ord of their result (call_id, parent_event_id), or null.

    First the last result with the call's call_id; else the last one whose
    parent is the call; else the n-th result without either key goes to the
    n-th call that is still open.
    """
    keys = list(SESSION)
    by_id = results.where("call_id is not null").groupBy(*keys, "call_id").agg(F.max("ord").alias("_by_id"))
    by_parent = results.where("parent_event_id is not null").groupBy(*keys, F.col("parent_event_id").alias("event_id")).agg(F.max("ord").alias("_by_parent"))
    df = calls.join(by_id, [*keys, "call_id"], "left").join(by_parent, [*keys, "event_id"], "left")
    df = df.withColumn("_known", F.coalesce("_by_id", "_by_parent"))
    turn = F.row_number().over(Window.partitionBy(*keys, F.col("_known").isNull()).orderBy("ord"))
    df = df.withColumn("_turn", F.when(F.col("_known").isNull(), turn))
    free = results.where("call_id is null and parent_event_id is null")
    free = free.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("ord")).alias("_turn"), F.col("ord").alias("_free"))
    tier = F.when(F.col("_by_id").isNotNull(), 1).when(F.col("_by_parent").isNotNull(), 2).when(F.col("_free").isNotNull(), 3)
    return df.join(free, [*keys, "_turn"], "left").select(*calls.columns, F.coalesce("_known", "_free").alias("result_ord"), tier.alias("tier"))


def calls(events: DataFrame) -> DataFrame:
    """(host, session_id, ord, event_id, tool, is_command, command_line, base_command, failed) of each named call of the assistant.

    It has failed if its result has, by the analyzer's rule; without a result, if it has itself.
    """
    e = P.with_doc(events).withColumn("_call", P.field(P.payload(), "call_id")).withColumn("_failed", P.failed_event(P.payload(), F.col("event_type")))
    name = F.coalesce(F.nullif(P.field(P.payload(), "name"), F.lit("")), F.split("summary", r"\(")[0])
    mine = e.where((F.col("actor") == "assistant") & F.col("event_type").isin("tool_call", "command", "file_read", "file_edit"))
    mine = mine.withColumn("tool", name).where("tool not in ('', '?')")
    command = F.col("tool").isin("Bash", "exec_command", "shell") | (F.col("event_type") == "command")
    line = F.when(command, F.nullif(X.command_line(P.payload()), F.lit("")))
    mine = mine.select(*SESSION, "ord", "event_id", F.col("_call").alias("call_id"), "tool", command.alias("is_command"), line.alias("command_line"), F.col("_failed").alias("_own"))
    results = e.where("actor = 'tool'").select(*SESSION, "ord", F.nullif("_call", F.lit("")).alias("call_id"), F.nullif("parent_event_id", F.lit("")).alias("parent_event_id"), F.col("_failed").alias("_theirs"))
    met = match_results(mine, results.drop("_theirs"))
    met = met.join(results.select(*SESSION, F.col("ord").alias("result_ord"), "_theirs"), [*SESSION, "result_ord"], "left")
    return met.select(*SESSION, "ord", "event_id", "tool", "is_command", "command_line", X.base_command(F.col("command_line")).alias("base_command"), F.coalesce("_theirs", "_own").alias("failed"))


def latest_before(rows: DataFrame, is_right: str, key: str, value: str) -> DataFrame:
    """As-of: left rows with the value of the latest earlier right row of their session and key; no join needed."""
    seen = F.last(F.when(F.col(is_right), F.col(value)), True).over(so_far("ord", (*SESSION, key)))
    return rows.withColumn(f"latest_{value}", seen).where(f"not {is_right}")


def within(points: DataFrame, spans: DataFrame, key: str, width_seconds: int = 3600) -> DataFrame:
    """Spans (key, start, end) with the points (key, ts) inside, ends included: one row a pair.

    Both sides are dealt by time buckets of ``width_seconds``, so it is an equal
    join and each pair meets once, in the point's bucket.
    """
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / width_seconds)
    cut = spans.where("start <= end").withColumn("_bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    dealt = points.withColumn("_bucket", bucket(F.col("ts")))
    return cut.join(dealt, [key, "_bucket"]).where(F.col("ts").between(F.col("start"), F.col("end"))).drop("_bucket")


def count_within(points: DataFrame, spans: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """(ids, n): how many points (key, ts) each span (key, start, end, ids) holds, ends included; spans that hold none have 0.

    A span's points are those up to its end less those before its start, so the
    work is that of putting points and ends in order, whatever the spans hold.
    """
    of = lambda rows, ts, at, named: rows.select(key, F.col(ts).alias("ts"), F.lit(at).alias("at"), *[(F.col(c) if named else F.lit(None).cast(spans.schema[c].dataType)).alias(c) for c in ids])
    fine = spans.where("start <= end")
    rows = of(fine, "start", 0, True).unionByName(of(points, "ts", 1, False)).unionByName(of(fine, "end", 2, True)).where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    counted = scan(rows, (key,), ("ts", "at"), _upto=Total((F.col("at") == 1).cast("int"))).where("at <> 1")
    return counted.groupBy(*ids).agg(F.sum(F.when(F.col("at") == 2, F.col("_upto")).otherwise(-F.col("_upto"))).alias("n"))


def new_rows(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Sources that are not imported yet, or have grown or changed since (size, mtime)."""
    have = known.select(key, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    joined = found.join(have, key, "left")
    return joined.where(F.col("_size").isNull() | (F.col("size") > F.col("_size")) | (F.col("mtime") > F.col("_mtime"))).drop("_size", "_mtime")
