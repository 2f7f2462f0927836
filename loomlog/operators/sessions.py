"""Sessions as one wide row each, and what is joined to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from .windows import SESSION, top_k

#: Files of a session that are listed, and tools.
MAX_FILES, MAX_TOOLS = 100, 12


def files_of(payload: Column) -> Column:
    """Paths among all strings of a payload, and the keys of its changes; distinct."""
    return F.array_distinct(F.concat(F.filter(X.leaves(payload), P.looks_like_path), X.object_keys(payload, "changes")))


def files_touched(events: DataFrame) -> DataFrame:
    """(host, session_id, unique_files_touched, files_touched): distinct paths, the first MAX_FILES in order.

    Paths are made distinct before they are gathered, in partial sums.
    """
    rows = events.select(*SESSION, F.explode(files_of(F.col("payload"))).alias("file")).distinct()
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*SESSION).orderBy("file")))
    return ranked.groupBy(*SESSION).agg(
        F.count("*").alias("unique_files_touched"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= MAX_FILES, F.struct("rank", "file")))), lambda x: x["file"]).alias("files_touched"),
    )


def histogram(events: DataFrame, column: str, name: str) -> DataFrame:
    """(host, session_id, name): a map of each value's count, in the order of values; null counts as unknown."""
    counted = events.groupBy(*SESSION, F.coalesce(column, F.lit("unknown")).alias("_v")).agg(F.count("*").alias("_n"))
    return counted.groupBy(*SESSION).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "_n")))).alias(name))


def top_tools(events: DataFrame, k: int = MAX_TOOLS) -> DataFrame:
    """(host, session_id, top_tools): the most used tools with their counts, of equal ones the first used."""
    used = P.with_doc(events).withColumn("name", X.tool_name(P.payload())).where("name is not null").groupBy(*SESSION, "name").agg(F.count("*").alias("count"), F.min("ord").alias("_first"))
    best = top_k(used, list(SESSION), [F.desc("count"), F.col("_first"), F.col("name")], k)
    return best.groupBy(*SESSION).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "count"))), lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"))).alias("top_tools"))


def payload_model(payload: Column | P.Payload) -> Column:
    """The model that a payload names: itself, or its info, data, result or response."""
    places = ("", "info.", "data.", "result.", "response.")
    return F.coalesce(*[F.nullif(P.field(payload, f"{place}{key}"), F.lit("")) for place in places for key in ("model", "model_name", "metadata.model")])


def models(events: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(host, session_id, models): models by how often they are named, the session's own one counting once."""
    named = P.with_doc(events).select(*SESSION, payload_model(P.payload()).alias("model"), F.col("ord"))
    if meta is not None:
        named = named.unionByName(meta.select(*SESSION, F.nullif("model", F.lit("")).alias("model"), F.lit(-1).cast("long").alias("ord")))
    counted = named.where("model is not null").groupBy(*SESSION, "model").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counted.groupBy(*SESSION).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "model"))), lambda x: x["model"]).alias("models"))


def provider(host: Column, named: Column, host_a: str, host_b: str) -> Column:
    """openai or anthropic, as the session's provider or else its host tells."""
    low = F.lower(named)
    return (
        F.when(low.contains("openai"), "openai")
        .when(low.contains("anthropic") | low.contains("claude"), "anthropic")
        .when(host == host_a, "anthropic").when(host == host_b, "openai").otherwise("unknown")
    )


def cost_model(models_: Column, provider_: Column, host: Column, host_b: str) -> Column:
    """The model by which a session's tokens are priced; null where nothing tells."""
    return F.coalesce(F.get(models_, F.lit(0)), F.when((host == host_b) | (provider_ == "openai"), "gpt-5"))


def project(slug: Column, cwd: Column) -> tuple[Column, Column]:
    """Name and path of the project: a slug, else the last part of the working directory."""
    some, where = F.nullif(slug, F.lit("")), F.nullif(cwd, F.lit(""))
    last = F.coalesce(F.nullif(F.element_at(F.split(F.regexp_replace(where, "/+$", ""), "/"), -1), F.lit("")), where)
    return F.coalesce(some, last, F.lit("unknown")), F.when(some.isNotNull(), F.lit("")).otherwise(F.coalesce(where, F.lit("")))


def project_path(paths: DataFrame) -> DataFrame:
    """(host, session_id, project_path) of (host, session_id, ord, slug, path): up to the slug in the first path that has it, else the first path's folder."""
    rows = paths.where(F.col("path").startswith("/")).withColumn("_parts", F.split("path", "/"))
    at = F.array_position("_parts", F.col("slug"))
    inside = F.when(at > 0, F.array_join(F.slice("_parts", F.lit(1), at.cast("int")), "/"))
    folder = F.array_join(F.slice("_parts", F.lit(1), F.greatest(F.size("_parts") - 1, F.lit(0))), "/")
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("ord")))
    return rows.groupBy(*SESSION).agg(F.coalesce(first(inside), first(folder), F.lit("")).alias("project_path"))


def title(events: DataFrame) -> DataFrame:
    """(host, session_id, title): the first line of the first user message, else the first event's summary, in 180 characters."""
    user = (F.col("actor") == "user") & (F.col("event_type") == "message")
    first = F.min_by(F.when(user, F.coalesce("summary", F.lit(""))), F.when(user, F.col("ord")))
    line = F.substring(F.split(X.strip(first), r"\r?\n")[0], 1, 180)
    return events.groupBy(*SESSION).agg(F.coalesce(line, F.substring(F.min_by("summary", "ord"), 1, 180), F.lit("untitled")).alias("title"))


def summarise(events: DataFrame, meta: DataFrame, host_a: str, host_b: str) -> DataFrame:
    """One row a session: its counts, times, files, tools, models, title and project.

    ``meta`` has host, session_id, title, model, model_provider, project_slug and
    cwd, any of them null; sessions without it stay.
    """
    kind, actor = F.col("event_type"), F.col("actor")
    stamp = F.try_to_timestamp("timestamp")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    events = P.with_doc(events)
    name = X.tool_name(P.payload())
    texts = [F.col("summary"), *[P.field(P.payload(), k) for k in ("text", "message", "error", "output", "raw_content")]]
    micros = F.unix_micros(F.max(stamp)) - F.unix_micros(F.min(stamp))
    base = events.groupBy(*SESSION).agg(
        F.min(stamp).alias("first_ts"), F.max(stamp).alias("last_ts"), F.when(F.count(stamp) >= 2, F.floor(micros / 1000000)).alias("duration_seconds"),
        F.count("*").alias("event_count"), count((actor == "user") & (kind == "message")).alias("user_messages"), count((actor == "assistant") & (kind == "message")).alias("assistant_messages"),
        *[count(kind == k).alias(n) for k, n in (("reasoning", "reasoning_events"), ("tool_call", "tool_call_events"), ("tool_result", "tool_result_events"), ("command", "command_events"), ("file_read", "file_read_events"), ("file_edit", "file_edit_events"), ("unknown", "unknown_events"))],
        count(P.failed_dashboard(P.payload(), kind)).alias("failed_events"), count(P.web_search(F.col("summary"), name, "dashboard")).alias("web_search_events"),
        count(P.rate_limited(*texts)).alias("rate_limit_hits"), count(F.coalesce("timestamp", F.lit("")) == "").alias("events_without_timestamps"),
    )
    keys = list(SESSION)
    own = meta.select(*SESSION, F.nullif("title", F.lit("")).alias("_title"), "model_provider", "project_slug", "cwd")
    df = base.join(own, keys, "left")
    for more in (histogram(events, "event_type", "event_counts"), histogram(events, "actor", "actor_counts"), files_touched(events), top_tools(events), models(events, meta), title(events)):
        df = df.join(more, keys, "left")
    name, path = project(F.col("project_slug"), F.col("cwd"))
    said = F.substring(F.split(X.strip(F.col("_title")), r"\r?\n")[0], 1, 180)
    df = df.select(
        "*", F.coalesce(F.date_format("first_ts", "yyyy-MM-dd"), F.lit("unknown")).alias("date"), provider(F.col("host"), F.col("model_provider"), host_a, host_b).alias("provider"),
        name.alias("project_name"), path.alias("project_path"), F.coalesce(said, "title").alias("_said"),
    ).drop("title", "_title", "project_slug", "cwd", "model_provider").withColumnRenamed("_said", "title")
    return df.withColumn("cost_model", cost_model(F.col("models"), F.col("provider"), F.col("host"), host_b)).fillna({"unique_files_touched": 0})


def with_readings(sessions: DataFrame, readings: DataFrame) -> DataFrame:
    """Sessions with ``signals_index``: a map of each signal's reading as text, the last one of its name (by ord)."""
    value = F.coalesce("value_str", F.col("value_bool").cast("string"), F.col("value_num").cast("string"))
    last = readings.groupBy(*SESSION, "signal").agg(F.max_by(value, "ord").alias("_v"))
    index = last.groupBy(*SESSION).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "_v")))).alias("signals_index"))
    return sessions.join(index, list(SESSION), "left")


def experiment_rows(readings: DataFrame, sessions: DataFrame, prefix: str = "trajectory_") -> DataFrame:
    """Readings of the trajectory signals with their session's title, or its id where it has none."""
    mine = readings.where(F.col("signal").startswith(prefix))
    known = sessions.select(*SESSION, F.nullif("title", F.lit("")).alias("_title"))
    return mine.join(known, list(SESSION), "left").withColumn("title", F.coalesce("_title", "session_id")).drop("_title")


def with_mined(sessions: DataFrame, mined: DataFrame) -> DataFrame:
    """Sessions with ``mined``: an array of (method, n candidates), by method; empty where nothing was mined."""
    counted = mined.groupBy(*SESSION, "method").agg(F.count("*").alias("n"))
    lists = counted.groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("method", "n"))).alias("mined"))
    return sessions.join(lists, list(SESSION), "left").withColumn("mined", F.coalesce("mined", F.array().cast("array<struct<method:string,n:bigint>>")))


def filter_experiments(rows: DataFrame, host: str | None = None, badge: str | None = None, text: str | None = None) -> DataFrame:
    """Sessions of a host, with a badge that holds a text, and a text in their id or title."""
    if host:
        rows = rows.where(F.col("host") == host)
    if badge:
        rows = rows.where(F.exists("badges", lambda b: b.contains(badge)))
    if text:
        rows = rows.where(F.lower(F.concat_ws(" ", "host", "session_id", "title")).contains(text.lower()))
    return rows


def filter_memories(rows: DataFrame, text: str | None = None, **only: str) -> DataFrame:
    """Candidates of a host, scope, kind, method or risk whose text, use, title or origin holds a text."""
    for column, value in only.items():
        rows = rows.where(F.col(column) == value)
    if text:
        there = [c for c in ("text", "when_to_use", "title", "origin_repo") if c in rows.columns]
        rows = rows.where(F.lower(F.concat_ws(" ", *there)).contains(text.lower()))
    return rows
