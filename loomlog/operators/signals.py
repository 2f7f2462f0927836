"""Per-session figures of events in one grouped pass, as a registry that users can add to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from .windows import SESSION

#: Signal name to (kind, aggregate over a session's events).
REGISTRY: dict[str, tuple[str, Callable[[], Column]]] = {}


def register(name: str, kind: str):
    """Add a signal; kind is numeric, boolean or categorical."""

    def add(make: Callable[[], Column]) -> Callable[[], Column]:
        if name in REGISTRY:
            raise ValueError(f"signal {name} is there already")
        REGISTRY[name] = (kind, make)
        return make

    return add


def _text() -> Column:
    return X.event_text(P.payload(), F.col("summary"))


def _is(event_type: str, actor: str | None = None) -> Column:
    return (F.col("event_type") == event_type) & ((F.col("actor") == actor) if actor else F.lit(True))


def _failed() -> Column:
    return P.failed_event(P.payload(), F.col("event_type"))


def paths() -> Column:
    """Files that an event names."""
    keys = ("file_path", "path", "filepath")
    own = [P.field(P.payload(), k) for k in keys] + [P.field(P.payload(), f"input.{k}") for k in keys]
    changed = F.coalesce(F.json_object_keys(F.get_json_object("payload", "$.changes")), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array_compact(F.array(*own)), changed))


def _count(name: str, make: Callable[[], Column]) -> None:
    REGISTRY[name] = ("numeric", lambda: F.count_if(F.coalesce(make(), F.lit(False))))


def _files(event_type: str) -> Column:
    return F.size(F.array_distinct(F.flatten(F.collect_list(F.when(_is(event_type), paths())))))


def _stamp() -> Column:
    return F.try_to_timestamp("timestamp")


_count("command_count", lambda: _is("command", "assistant"))
_count("file_edit_count", lambda: _is("file_edit"))
REGISTRY["unique_files_edited"] = ("numeric", lambda: _files("file_edit"))
REGISTRY["unique_files_read"] = ("numeric", lambda: _files("file_read"))
_count("web_search_count", lambda: P.web_search(F.col("summary"), P.field(P.payload(), "name")))
_count("user_message_count", lambda: _is("message", "user"))
_count("assistant_message_count", lambda: _is("message", "assistant"))
_count("user_correction_count", lambda: _is("message", "user") & P.correction(_text()))
_count("failed_command_count", _failed)
_count("unknown_event_count", lambda: _is("unknown"))
_count("events_without_timestamps", lambda: F.coalesce("timestamp", F.lit("")) == "")


@register("session_duration_seconds", "numeric")
def _duration() -> Column:
    micros = F.unix_micros(F.max(_stamp())) - F.unix_micros(F.min(_stamp()))
    return F.when(F.count(_stamp()) >= 2, F.floor(micros / 1000000))


@register("time_to_first_edit_seconds", "numeric")
def _first_edit() -> Column:
    at = lambda c: F.min_by(F.when(c & _stamp().isNotNull(), _stamp()), F.when(c & _stamp().isNotNull(), F.col("ord")))
    seconds = (F.unix_micros(at(_is("file_edit"))) - F.unix_micros(at(_is("message", "user")))) / 1000000
    return F.when(seconds >= 0, F.floor(seconds))


@register("failed_command_ratio", "numeric")
def _ratio() -> Column:
    mine = (F.col("actor") == "tool") & F.col("event_type").isin("tool_result", "command")
    n = F.count_if(mine)
    return F.when(n > 0, F.bround(F.count_if(mine & _failed()) / n, 4))


@register("user_satisfaction_lexical", "categorical")
def _satisfied() -> Column:
    user = _is("message", "user")
    return P.satisfaction(F.max_by(F.when(user, _text()), F.when(user, F.col("ord"))))


@register("interrupted_signal", "boolean")
def _interrupted() -> Column:
    return F.bool_or(P.interrupted(F.col("summary"), F.col("payload")))


def searched() -> Column:
    """What secrets are looked for in: the summary, and all keys and texts of the payload, a line each."""
    return F.concat_ws("\n", F.nullif("summary", F.lit("")), F.array_join(X.leaves(F.col("payload"), keys=True), "\n"))


@register("secret_exposure_count", "numeric")
def _secrets() -> Column:
    return F.least(F.lit(50), F.sum(P.secret_count(searched())))


@register("secret_exposure_signal", "boolean")
def _secret() -> Column:
    return F.sum(P.secret_count(searched())) > 0


@register("capture_gap_signal", "boolean")
def _gap() -> Column:
    return F.bool_or(_is("unknown") | (F.coalesce("timestamp", F.lit("")) == ""))


def measure(events: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row a session; an unknown name is a KeyError."""
    return P.with_doc(events).groupBy(*SESSION).agg(*[REGISTRY[n][1]().alias(n) for n in (names or list(REGISTRY))])


def select(events: DataFrame, host: str | None = None, sessions: tuple[str, ...] | None = None) -> DataFrame:
    """Events of a host and of some sessions; filters that a scan of events by host takes over."""
    if host:
        events = events.where(F.col("host") == host)
    return events.where(F.col("session_id").isin(*sessions)) if sessions is not None else events


def secrets(events: DataFrame, most: int = 50) -> DataFrame:
    """(host, session_id, n, type, event_id, snippet): secrets as they come in each session, the first ``most``, with 40 characters around and the secret cut out."""
    text = searched()
    rows = None
    for place, (name, pattern) in enumerate(P.SECRET_PATTERNS.items()):
        flags, bare = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
        whole = F.lit(f"{flags}((?s:.{{0,40}}?))(?:{bare})(?=((?s:.{{0,40}})))")
        before, behind = (F.regexp_extract_all(F.col("_text"), whole, i) for i in (1, 2))
        around = F.zip_with(before, behind, lambda x, y: F.concat(x, F.lit("[REDACTED]"), y))
        part = events.withColumn("_text", text).select(*SESSION, "ord", "event_id", F.lit(place).alias("place"), F.lit(name).alias("type"), F.posexplode(around).alias("at", "snippet"))
        rows = part if rows is None else rows.unionByName(part)
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy(*SESSION).orderBy("ord", "place", "at"))).where(F.col("n") <= most)
    return ranked.select(*SESSION, "n", "type", "event_id", F.substring(F.replace("snippet", F.lit("\n"), F.lit(" ")), 1, 180).alias("snippet"))


def readings(measured: DataFrame) -> DataFrame:
    """One row a session and signal, with its value in the column of its kind."""
    rows = []
    for name, (kind, _) in REGISTRY.items():
        if name in measured.columns:
            value = lambda k, t: (F.col(name) if kind == k else F.lit(None)).cast(t)  # noqa: E731, B023
            rows.append(F.struct(F.lit(name).alias("signal"), F.lit(kind).alias("kind"), value("numeric", "double").alias("value_num"), value("boolean", "boolean").alias("value_bool"), value("categorical", "string").alias("value_str")))
    return measured.select(*SESSION, F.inline(F.array(*rows)))


def aggregate(rows: DataFrame) -> DataFrame:
    """Per signal: readings present and missing, and the figures of its kind only.

    Numeric: min, max, mean, median, p90 and total; boolean: true_count,
    false_count and true_ratio; categorical: its most common value (see histogram()).
    """
    number, flag = F.col("value_num"), F.col("value_bool")
    here = number.isNotNull() | flag.isNotNull() | F.col("value_str").isNotNull()
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    yes, no = F.count_if(flag), F.count_if(~flag)
    return rows.groupBy("signal", "kind").agg(
        F.count_if(here).alias("present"), F.count_if(~here).alias("missing"), F.min(number).alias("min"), F.max(number).alias("max"), F.bround(F.avg(number), 3).alias("mean"),
        F.median(number).alias("median"), F.bround(F.percentile(number, 0.9), 3).alias("p90"), F.bround(F.sum(number), 3).alias("total"),
        of("boolean", yes).alias("true_count"), of("boolean", no).alias("false_count"), of("boolean", F.bround(yes / F.nullif(yes + no, F.lit(0)), 3)).alias("true_ratio"),
        F.mode("value_str", True).alias("most_common"),
    )


def histogram(rows: DataFrame) -> DataFrame:
    """(signal, value, n, rank) of categorical readings, the most frequent first."""
    counted = rows.where("kind = 'categorical' and value_str is not null").groupBy("signal", F.col("value_str").alias("value")).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("signal").orderBy(F.desc("n"), "value")))


def with_plugin(events: DataFrame, function, schema: str) -> DataFrame:
    """Readings of a user's own function of a session's events (a pandas DataFrame in order); one session must fit a task."""
    return events.groupBy(*SESSION).applyInPandas(lambda rows: function(rows.sort_values("ord")), schema)
