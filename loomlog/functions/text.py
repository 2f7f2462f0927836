"""Scalar text functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import Payload, field, text_of

#: Fixed values.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
STOPWORDS = ("this", "that", "with", "from", "have", "there", "their", "would", "could", "should", "process", "exited", "code", "output", "error", "failed")
_EDGES = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def truncate(text: Column, n: int, flatten: bool = False) -> Column:
    """Stripped; newlines as spaces on demand; what is longer than n ends with an ellipsis."""
    text = strip(text)
    if flatten:
        text = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def event_text(payload: Column | Payload, summary: Column) -> Column:
    """First text of text, message and thinking (an empty one counts), raw_content, then the summary."""
    raw = F.get_json_object(text_of(payload), "$.raw_content")
    return F.coalesce(field(payload, "text"), field(payload, "message"), field(payload, "thinking"), raw, summary, F.lit(""))


def base_command(line: Column) -> Column:
    """The executable of a command line, behind assignments, interpreters and runners."""
    line = F.regexp_replace(strip(F.coalesce(line, F.lit(""))), r"^(?:[a-zA-Z_]\w*=\S+\s+)+", "")
    parts = F.split(line, r"\s+")
    base = lambda c: F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)
    exe = base(parts[0])
    n = F.size(parts)
    python = exe.isin("python", "python3", "pythonw", "py", "python.exe") | exe.startswith("python3.")
    return (
        F.when(line == "", "")
        .when(python & (n > 2) & (F.get(parts, F.lit(1)) == "-m"), base(F.get(parts, F.lit(2))))
        .when(python & (n > 1), base(F.get(parts, F.lit(1))))
        .when(exe.isin("npx", "bunx", "npx.cmd") & (n > 1), F.get(parts, F.lit(1)))
        .when((exe == "poetry") & (n > 2) & (F.get(parts, F.lit(1)) == "run"), F.get(parts, F.lit(2)))
        .otherwise(exe)
    )


def command_line(payload: Column | Payload) -> Column:
    """The command of a payload: input's, input itself, arguments' (also as JSON text), then its own."""
    args = field(payload, "arguments")
    parsed = lambda *keys: F.coalesce(*[field(args, k) for k in keys])
    keys = ("cmd", "command", "command_line")
    own = [field(payload, f"arguments.{k}") for k in keys]
    not_json = F.when(F.try_parse_json(args).isNull(), args)
    return F.coalesce(field(payload, "input.command"), field(payload, "input.cmd"), field(payload, "input"), *own, parsed(*keys), not_json, field(payload, "command"), field(payload, "cmd"))


def command_text(payload: Column | Payload, summary: Column) -> Column:
    """The text by which a step's command is judged; empty values don't count."""
    some = lambda path: F.nullif(field(payload, path), F.lit(""))
    shown = F.nullif(F.regexp_extract(F.coalesce(field(payload, "output"), F.lit("")), r"(?:cmd|command)=([^,\n)]+)", 1), F.lit(""))
    return F.coalesce(some("cmd"), some("command"), some("text"), some("input.cmd"), some("input.command"), shown, summary, F.lit(""))


def tool_name(payload: Column | Payload) -> Column:
    return F.coalesce(field(payload, "name"), field(payload, "tool_name"), field(payload, "action.type"))


def normal_fingerprint(text: Column) -> Column:
    """Lower case without colours, ids, addresses, times, temporary paths and runs of white space."""
    for pattern, put in (
        (r"\x1b\[[0-9;]*m", ""),
        (r"\b[0-9a-f]{8}-[0-9a-f-]{27,}\b", "<uuid>"),
        (r"\b0x[0-9a-f]+\b", "<addr>"),
        (r"\b\d{4}-\d{2}-\d{2}[t ][0-9:.\-+z]+\b", "<timestamp>"),
        (r"/(?:private/)?tmp/[^\s'\",)]+", "/tmp/<tmp>"),
        (r"\s+", " "),
    ):
        text = F.regexp_replace(F.lower(text) if put == "" else text, pattern, put)
    return truncate(text, 240)


def fingerprint_key(fingerprint: Column) -> Column:
    return F.substring(F.sha2(fingerprint, 256), 1, 12)


def salient_terms(text: Column) -> Column:
    """Up to 20 identifiers, paths, names and errors, as they first occur."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_./-]{3,})"), 1)
    low = lambda t: F.regexp_replace(F.lower(t), r"^[./]+|[./]+$", "")
    named = lambda t: t.rlike("[./_]") | t.rlike("^[A-Z]") | low(t).rlike("(?:error|exception)$")
    kept = F.filter(found, lambda t: ~low(t).isin(*STOPWORDS) & (F.length(low(t)) >= 4) & named(t))
    return F.slice(F.array_distinct(F.transform(kept, lambda t: F.regexp_replace(t, r"^[.,]+|[.,]+$", ""))), 1, 20)


def search_tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, without accents."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), *ACCENTS)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def word_set(text: Column) -> Column:
    """Distinct lower-case words of a letter and more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z][a-z0-9_]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def slug(text: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.coalesce(F.nullif(F.substring(base, 1, 48), F.lit("")), F.lit("memory")), F.lit("-"), F.substring(F.sha1(text.cast("binary")), 1, 10))


def content_hash(text: Column, scope: Column, kind: Column, origin: Column) -> Column:
    """Same text, scope and kind (and, in a repository's scope, origin) give the same hash."""
    normal = F.regexp_replace(strip(F.lower(text)), r"\s+", " ")
    where = F.when(scope == "repo", F.coalesce(origin, F.lit("None"))).otherwise("")
    return F.sha2(F.concat_ws("\0", scope, kind, where, normal), 256)


def wiki_links(text: Column) -> Column:
    """Distinct targets of [[target|alias]] and [[target#part]]."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"), 1)
    return F.array_distinct(F.filter(F.transform(found, strip), lambda x: x != ""))


def object_keys(payload: Column, key: str) -> Column:
    """Keys of an object in a payload; none where it is no object."""
    value = F.get_json_object(payload, f"$.{key}")
    return F.coalesce(F.json_object_keys(F.when(F.substring(F.ltrim(value), 1, 1) == "{", value)), F.array().cast("array<string>"))


def leaves(payload: Column, keys: bool = False) -> Column:
    """All strings in JSON text, at any depth, in their order; keys of objects only on demand.

    A key is told by the colon after it.  Escapes are undone; bad JSON has none.
    """
    good = F.when(F.try_parse_json(payload).isNotNull(), payload)
    found = F.regexp_extract_all(F.coalesce(good, F.lit("")), F.lit(r'("(?:[^"\\]|\\.)*"(?:\s*:)?)'), 1)
    if keys:
        found = F.transform(found, lambda x: F.regexp_replace(x, r"\s*:$", ""))
    kept = F.filter(found, lambda x: ~x.endswith(":"))
    return F.transform(kept, lambda x: F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>")[0])


def content_text(content: Column) -> Column:
    """Text of a message content given as JSON: a string, or the text and input_text parts of a list, a line each."""
    whole = F.from_json(F.concat(F.lit("["), content, F.lit("]")), "array<string>")[0]
    parts = F.from_json(content, "array<struct<text:string,input_text:string>>")
    lines = F.array_compact(F.transform(parts, lambda p: F.coalesce(p["text"], p["input_text"])))
    return F.when(F.substring(F.ltrim(content), 1, 1) == "[", F.array_join(lines, "\n")).when(F.substring(F.ltrim(content), 1, 1) == '"', whole).otherwise(F.lit(""))


def clamp(value: Column, low: float, high: float, default: float) -> Column:
    """A number between two bounds; the default where it is none."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("double"), F.lit(default))))


def anonymise(path: Column) -> Column:
    """A path with ~ for a user's home folder; of more than five parts the first and the last three."""
    short = F.regexp_replace(path, r"^/Users/[^/]+/?", "~/")
    parts = F.split(short, "/")
    first = F.coalesce(F.nullif(F.get(parts, F.lit(0)), F.lit("")), F.lit("/"))
    return F.when(F.size(parts) > 5, F.concat_ws("/", first, F.lit("…"), F.slice(parts, -3, 3))).otherwise(short)


def describe_call(kind: Column, payload: Column) -> Column:
    """A call in words: what it does, and the telling part of its input."""
    name = F.coalesce(F.nullif(field(payload, "name"), F.lit("")), F.nullif(field(payload, "tool_name"), F.lit("")), kind)
    given = F.coalesce(F.get_json_object(payload, "$.input"), F.get_json_object(payload, "$.arguments"))
    keys = ("command", "cmd", "file_path", "path", "pattern", "query", "url", "description")
    detail = F.coalesce(*[F.nullif(F.get_json_object(given, f"$.{k}"), F.lit("")) for k in keys])
    label = F.when(kind == "command", "run shell").when(kind == "file_edit", "edit file").when(kind == "file_read", "read file").otherwise(name)
    return F.when(detail.isNotNull(), F.concat(label, F.lit(" ("), truncate(detail, 80, flatten=True), F.lit(")"))).otherwise(label)


def fenced(text: Column) -> Column:
    """Text in a Markdown fence that is longer than any run of backticks in it."""
    runs = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(`+)"), 1), F.length)
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(fence, F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n"), fence)


def quoted(text: Column) -> Column:
    """Text as a Markdown quotation, line by line; an empty one is one empty quotation."""
    lines = F.transform(F.split(F.regexp_replace(text, "\n$", ""), "\n"), lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x)))
    return F.when(F.coalesce(text, F.lit("")) == "", "> ").otherwise(F.array_join(lines, "\n"))


def cut_lines(text: Column, limit: int) -> Column:
    """Text of at most ``limit`` characters with its lines, and a mark where it was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("\n… [truncated]"))).otherwise(text)


def stepped(value: Column, steps: list[tuple[float, str]]) -> Column:
    """The name of the last step that a value has reached; steps in any order, null below the first."""
    out = F.lit(None).cast("string")
    for least, name in sorted(steps):
        out = F.when(value >= least, name).otherwise(out)
    return out


def money(amount: Column) -> Column:
    return F.format_string("$%.2f", F.coalesce(amount, F.lit(0.0)))


def duration(seconds: Column) -> Column:
    whole = F.coalesce(seconds.cast("long"), F.lit(0))
    minutes = F.floor(whole / 60)
    return F.when(whole < 60, F.concat(whole.cast("string"), F.lit("s"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))
