"""Raw transcripts as JSON lines, and the canonical event table made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.predicates import field, with_doc
from .views import HOST_A, HOST_B

#: Fixed values.
TOOL_TYPES_A = {"Read": "file_read", "Edit": "file_edit", "Write": "file_edit", "MultiEdit": "file_edit", "NotebookEdit": "file_edit", "Bash": "command"}
TOOL_TYPES_B = {"exec_command": "command", "shell": "command", "apply_patch": "file_edit", "read_file": "file_read", "view_image": "file_read"}
ATTACHMENTS_A = ("file-history-snapshot", "ai-title", "last-prompt", "pr-link")
INPUT_KEYS_A = ("file_path", "path", "command", "pattern", "url", "query", "description")
EVENT = ("host", "session_id", "ord", "event_id", "sequence", "actor", "event_type", "summary", "payload", "timestamp", "parent_event_id", "path", "line")


#: Parts of files that are broadcast to their lines; more are joined by shuffle.
MAX_SPLITS = 200_000


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, raw) of all lines of text files, blank ones too; lines count from 1 and end with a line feed, before which a carriage return goes.

    A large file is many tasks: each split's lines are counted first, and a
    line's number is its place in its split behind the lines of the file's
    splits before.  Both scans see the files as they were when listed.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    splits = rows.groupBy("path", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "_block", (1 + F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    if splits.limit(MAX_SPLITS + 1).count() <= MAX_SPLITS:
        splits = F.broadcast(splits)
    return rows.join(splits, ["path", "_block"]).select("path", (F.col("_at") + F.col("_shift")).alias("line"), F.regexp_replace("value", "\r$", "").alias("raw"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, session_id, line, raw) of JSON-lines files: lines count from 1, blank ones too; lines that are no JSON are left out.

    The session is the file's name without its endings.
    """
    session = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?:\.events)?\.jsonl$", "")
    rows = numbered(spark, path).where(F.try_parse_json("raw").isNotNull() & (F.btrim("raw") != ""))
    return rows.select("path", session.alias("session_id"), "line", "raw")


def _get(path: str, of: str = "raw") -> Column:
    return F.get_json_object(F.col(of), f"$.{path}")


def _json(**parts: Column) -> Column:
    """A JSON object; each part is JSON text already (null: left out), keys in the order given."""
    items = [F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}"))


def _quoted(text: Column) -> Column:
    """A string as JSON text."""
    inner = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(inner, F.lit(2), F.length(inner) - 2))


def _kind_of(json: Column) -> Column:
    first = F.substring(F.ltrim(json), 1, 1)
    return F.when(first == "[", "list").when(first == "{", "object").when(json.isNull(), "null").otherwise("scalar")


def _is_string(path: str, of: str = "raw") -> Column:
    return field(F.col(of), path).isNotNull()


def _as_json(path: str, of: str = "raw") -> Column:
    """The value at a path as JSON text, strings quoted again."""
    return F.when(_is_string(path, of), _quoted(field(F.col(of), path))).otherwise(_get(path, of))


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def summarise_input(json: Column, keys: tuple[str, ...] = INPUT_KEYS_A) -> Column:
    """The first telling key of an input, else the input, in 80 characters."""
    named = [F.concat(F.lit(f"{k}="), X.truncate(F.get_json_object(json, f"$.{k}"), 80, flatten=True)) for k in keys]
    return F.coalesce(*named, X.truncate(json, 80, flatten=True))


def normalise_a(lines: DataFrame) -> DataFrame:
    """Events of host A's transcripts: the parts of a message become events of their own.

    A tool's result takes the type and name of the latest earlier call with its
    id; that is a window over the session, not a join.
    """
    kind = _get("type")
    own = Window.partitionBy("path").orderBy("line")
    df = lines.withColumn("sequence", F.row_number().over(own))
    content = _get("message.content")
    is_list = (_kind_of(content) == "list") & ~_is_string("message.content") & kind.isin("user", "assistant")
    parts = F.when(is_list, F.from_json(content, "array<string>")).otherwise(F.array(F.lit(None).cast("string")))
    df = df.select("*", kind.alias("kind"), content.alias("content"), is_list.alias("is_list"), _is_string("message.content").alias("is_text"), F.posexplode(parts).alias("idx", "part"))
    part_type = F.when(F.col("is_list"), _get("type", "part"))
    df = df.withColumn("part_type", part_type)
    df = df.withColumn("tool_id", F.when(F.col("part_type") == "tool_use", _get("id", "part")).when(F.col("part_type") == "tool_result", _get("tool_use_id", "part")))
    call = F.when(F.col("part_type") == "tool_use", F.coalesce(_get("name", "part"), F.lit("?")))
    seen = F.last(call, True).over(Window.partitionBy("path", "tool_id").orderBy("line", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("tool", F.when(F.col("tool_id").isNotNull(), seen).otherwise(call))
    user, assistant, listed = F.col("kind") == "user", F.col("kind") == "assistant", F.col("is_list")
    part = F.col("part_type")
    uuid = F.coalesce(_get("uuid"), F.concat_ws(":", "session_id", F.col("line").cast("string")))
    text = F.coalesce(_get("text", "part"), F.lit(""))
    result = user & listed & (part == "tool_result")
    use = assistant & listed & (part == "tool_use")
    plain = (user | assistant) & ~listed
    messages = plain | (listed & (part == "text"))
    thought = assistant & listed & (part == "thinking")
    system = F.col("kind") == "system"
    actor = F.when(result, "tool").when(user, "user").when(assistant, "assistant").otherwise("system")
    event_type = (
        F.when(messages | (system & ~listed), "message").when(thought, "reasoning")
        .when(use | result, F.when(result & F.col("tool").isNull(), "tool_result").otherwise(_lookup(TOOL_TYPES_A, F.col("tool"), "tool_call")))
        .when(F.col("kind") == "permission-mode", "permission").when(F.col("kind").isin("attachment", *ATTACHMENTS_A), "attachment").otherwise("unknown")
    )
    name = F.coalesce("tool", F.lit("?"))
    index = F.col("idx").cast("string")
    unknown_part = F.concat(F.col("kind"), F.lit(" content["), index, F.lit("].type="), F.coalesce(part, F.lit("None")))
    summary = (
        F.when(result, F.concat(F.lit("tool_result: "), name)).when(use, F.concat(name, F.lit("("), summarise_input(_get("input", "part")), F.lit(")")))
        .when(plain, X.truncate(F.coalesce("content", F.lit("None")), 200, flatten=True)).when(listed & (part == "text"), X.truncate(text, 200, flatten=True))
        .when(thought, X.truncate(_get("thinking", "part"), 200, flatten=True)).when(listed, unknown_part)
        .when(system, X.truncate(F.coalesce(_get("message"), F.lit("")), 200, flatten=True)).when(F.col("kind") == "attachment", F.concat(F.lit("attachment: "), F.coalesce(_get("attachment.type"), F.lit("?"))))
        .when(F.col("kind") == "permission-mode", F.concat(F.lit("permission-mode="), F.coalesce(_get("permissionMode"), F.lit("None")))).when(F.col("kind").isin(*ATTACHMENTS_A), F.col("kind"))
        .otherwise(F.concat(F.lit("unknown: type="), F.coalesce("kind", F.lit("None"))))
    )
    payload = (
        F.when(result, _json(tool_use_id=_as_json("tool_use_id", "part"), tool_name=_quoted(name), is_error=F.coalesce(_get("is_error", "part"), F.lit("false")), content=_as_json("content", "part")))
        .when(use, _json(tool_id=_as_json("id", "part"), name=_quoted(name), input=F.coalesce(_as_json("input", "part"), F.lit("{}"))))
        .when(plain & F.col("is_text") & user, _json(text=_quoted(F.col("content")))).when(plain, _json(raw_content=_as_json("message.content")))
        .when(listed & (part == "text"), _json(text=_quoted(text))).when(thought, _json(thinking=_quoted(_get("thinking", "part")))).when(listed, _json(part=F.col("part")))
        .when(system, _json(message=_as_json("message"))).when(F.col("kind") == "attachment", _json(attachment=_as_json("attachment"))).otherwise(F.col("raw"))
    )
    event_id = F.when(F.col("idx") == 0, uuid).otherwise(F.concat(uuid, F.lit("#"), index))
    out = df.select(F.lit(HOST_A).alias("host"), "session_id", event_id.alias("event_id"), "sequence", actor.alias("actor"), event_type.alias("event_type"), summary.alias("summary"), payload.alias("payload"), _get("timestamp").alias("timestamp"), _get("parentUuid").alias("parent_event_id"), "path", "line", "idx")
    order = Window.partitionBy("host", "session_id").orderBy("line", "idx")
    return out.withColumn("ord", F.row_number().over(order)).select(*EVENT)


def normalise_b(lines: DataFrame) -> DataFrame:
    """Events of host B's transcripts: one a line, without the user and assistant messages that are logged twice."""
    kind, p = _get("type"), _get("payload.type")
    call_id = _get("payload.call_id")
    df = lines.select("*", kind.alias("kind"), p.alias("p"), call_id.alias("call_id"), F.get_json_object("raw", "$.payload").alias("payload_"))
    call = F.when(F.col("p").isin("function_call", "custom_tool_call"), F.coalesce(_get("payload.name"), F.lit("?")))
    seen = F.last(call, True).over(Window.partitionBy("path", "call_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("tool", F.coalesce(F.when(F.col("call_id").isNotNull(), seen).otherwise(call), F.lit("?")))
    item, msg = F.col("kind") == "response_item", F.col("kind") == "event_msg"
    role = _get("payload.role")
    df = df.where(~F.coalesce(item & (F.col("p") == "message") & role.isin("user", "assistant"), F.lit(False)))
    on = lambda group, *names: group & F.col("p").isin(*names)
    calls, outputs = on(item, "function_call", "custom_tool_call"), on(item, "function_call_output", "custom_tool_call_output")
    actor = (
        F.when(on(msg, "user_message"), "user").when(on(msg, "agent_message") | on(item, "reasoning", "web_search_call") | calls, "assistant")
        .when(on(msg, "patch_apply_end", "web_search_end") | outputs, "tool").otherwise("system")
    )
    event_type = (
        F.when(F.col("kind") == "session_meta", "session_start").when(F.col("kind") == "turn_context", "attachment")
        .when(on(msg, "user_message", "agent_message") | on(item, "message"), "message").when(on(msg, "task_started", "task_complete", "token_count"), "attachment")
        .when(on(msg, "patch_apply_end"), "file_edit").when(on(msg, "web_search_end") | outputs, "tool_result").when(on(item, "reasoning"), "reasoning")
        .when(calls, _lookup(TOOL_TYPES_B, F.col("tool"), "tool_call")).when(on(item, "web_search_call"), "tool_call").otherwise("unknown")
    )
    said = F.coalesce(_get("payload.message"), F.lit(""))
    args = _get("payload.arguments")
    parsed = F.when(F.try_parse_json(args).isNotNull(), args).otherwise(_quoted(args))
    files = F.coalesce(F.size(F.json_object_keys(_get("payload.changes"))), F.lit(0)).cast("string")
    summary = (
        F.when(on(msg, "user_message", "agent_message"), X.truncate(said, 200, flatten=True)).when(on(msg, "task_started"), F.concat(F.lit("task_started turn="), F.coalesce(_get("payload.turn_id"), F.lit("None"))))
        .when(on(msg, "task_complete"), F.concat(F.lit("task_complete duration_ms="), F.coalesce(_get("payload.duration_ms"), F.lit("None")))).when(on(msg, "token_count"), "token_count")
        .when(on(msg, "patch_apply_end"), F.concat(F.lit("patch_apply success="), F.coalesce(_get("payload.success"), F.lit("None")), F.lit(" files="), files))
        .when(on(msg, "web_search_end"), F.concat(F.lit("web_search query="), X.truncate(F.coalesce(_get("payload.query"), F.lit("")), 200, flatten=True)))
        .when(on(item, "reasoning"), "reasoning (encrypted)").when(on(item, "function_call"), F.concat("tool", F.lit("("), summarise_input(parsed, ("cmd", "command", "path", "query")), F.lit(")")))
        .when(on(item, "custom_tool_call"), F.concat("tool", F.lit(" (custom_tool)"))).when(outputs, F.concat(F.lit("tool_result: "), F.col("tool"))).when(on(item, "web_search_call"), "web_search")
        .when(on(item, "message"), X.truncate(X.content_text(_as_json("payload.content")), 200, flatten=True)).when(item, F.concat(F.lit("response_item unknown payload.type="), F.coalesce("p", F.lit("None"))))
        .otherwise(F.coalesce("kind", F.lit("unknown")))
    )
    payload = (
        F.when(on(msg, "user_message", "agent_message"), _json(text=_quoted(said))).when(on(item, "function_call"), _json(name=_quoted(F.col("tool")), arguments=parsed, call_id=_quoted(F.col("call_id"))))
        .when(on(item, "custom_tool_call"), _json(name=_quoted(F.col("tool")), input=_as_json("payload.input"), call_id=_quoted(F.col("call_id"))))
        .when(outputs, _json(call_id=_quoted(F.col("call_id")), name=_quoted(F.col("tool")), output=_as_json("payload.output")))
        .when(on(item, "message"), _json(text=_quoted(X.content_text(_as_json("payload.content"))))).otherwise(F.coalesce("payload_", "raw"))
    )
    event_id = F.concat_ws(":", "session_id", F.col("line").cast("string"))
    out = df.select(F.lit(HOST_B).alias("host"), "session_id", event_id.alias("event_id"), F.col("line").alias("sequence"), actor.alias("actor"), event_type.alias("event_type"), summary.alias("summary"), payload.alias("payload"), _get("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("parent_event_id"), "path", "line")
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("host", "session_id").orderBy("line"))).select(*EVENT)


def gaps(events: DataFrame) -> DataFrame:
    """Unknown events of each session and what they are."""
    return events.where("event_type = 'unknown'").groupBy("host", "session_id").agg(F.count("*").alias("unknown"), F.array_sort(F.collect_set("summary")).alias("labels"))


def write_events(events: DataFrame, path: str) -> None:
    """Parquet by host, with the payload as VARIANT in ``doc``, so that no reader parses it again; sessions are keys, not folders, so files stay large."""
    with_doc(events).write.mode("overwrite").partitionBy("host").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_event_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events that were written as JSON lines; a line that is no JSON, or does not fit the schema, fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_authored(spark: SparkSession, path: str) -> DataFrame:
    """Memories written by hand as Markdown: front matter lines as a map, and the body; files without a body are left out."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---", 1)
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n*", "")
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    key = lambda x: X.strip(F.substring_index(x, ":", 1))
    value = lambda x: F.regexp_replace(X.strip(F.regexp_replace(x, r"^[^:]*:", "")), r"""^['"](.*)['"]$""", "$1")
    fields = F.map_from_entries(F.transform(lines, lambda x: F.struct(key(x), value(x))))
    return files.select("path", fields.alias("fields"), X.strip(body).alias("text")).where("text <> ''")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Records of memories from JSON lines: each line is one, or a result that holds several."""
    rows = read_lines(spark, path)
    several = F.from_json(_get("candidates"), "array<string>")
    return rows.select("path", "line", F.explode(F.coalesce(several, F.array("raw"))).alias("record"))
