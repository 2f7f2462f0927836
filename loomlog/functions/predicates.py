"""Conditions on events as Column builders.  An event has ``event_type``, ``actor``,
``summary`` and ``payload`` (JSON text, kept in its source order)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
RATE_LIMIT_PHRASES = (
    "rate limit", "reached the limit", "wait until", "quota exceeded", "exceeded quota", "exceeded your quota",
    "resource_exhausted", "resource exhausted", "throttled", "too many requests", "try again in",
)
INTERRUPT_NEEDLES = ("interrupt", "user aborted", "request was canceled", "cancelled by user")
FAILURE_NEEDLES = ("traceback", "exception", "error:", "failed", "failure", "is_error", "success': false", '"success": false')
CORRECTION_PATTERNS = (
    r"\bno+\b[, ]+(that('?| i)s|it'?s)? (not|wrong|incorrect)",
    r"\b(don'?t|do not) (do|use|run|add|delete|remove)",
    r"\bstop\b.*\b(doing|using|saying)",
    r"\bnot\b\s+(what|exactly)\s+i\s+",
    r"\bthat'?s (wrong|incorrect|not right)",
    r"\bgood catch\b",
    r"\byou'?re right\b",
    r"\bactually,?\s+(i|it|we|that)",
    r"\bovers(t|ta)ated",
    r"\b(use|prefer)\s+\w+\s+instead\b",
    r"\brevert\b",
    r"\bundo\b",
)
#: Word borders spelled out, so that letters with accents count as letters everywhere.
B = r"(?:^|[^\p{L}\p{N}_])"
E = r"(?:$|[^\p{L}\p{N}_])"
POSITIVE = rf"{B}(?:thanks?|thank you|nice|great|perfect|awesome|amazing|love it|works|fixed it|ship it|lgtm){E}"
NEGATIVE = rf"{B}(?:broken|wrong|doesn'?t work|still failing|that'?s bad|terrible|hate|undo|revert){E}"
SECRET_PATTERNS = {
    "openai_api_key": r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b",
    "anthropic_api_key": r"\bsk-ant-[A-Za-z0-9_-]{20,}\b",
    "github_token": r"\bgh[opsru]_[A-Za-z0-9_]{20,}\b",
    "aws_access_key_id": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{25,}\b",
    "stripe_secret_key": r"\bsk_(?:live|test)_[0-9A-Za-z]{20,}\b",
    "slack_token": r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
    "generic_secret_assignment": r"(?i)\b(?:api[_-]?key|secret|token|password|passwd|private[_-]?key)\b\s*[:=]\s*['\"]?[^'\"\s]{12,}",
}
SUSPICIOUS_MARKERS = (
    "ignore previous instructions", "disregard previous instructions", "system prompt", "api_key", "secret_key", "password=",
    "-----begin private key-----",
)
INVISIBLE = "[​‌‍⁠﻿]"
PATCH_NAMES = ("apply_patch", "edit", "write", "multiedit")
SEARCH_COMMANDS, EXPLORE_COMMANDS = ("rg", "grep", "find", "fd", "ag"), ("ls", "pwd", "sed", "cat", "head", "tail", "tree", "wc")
SEARCH_NEEDLES = ("web_search", "search_query", "search tool", "ripgrep", "search_code", "search_method")
EXPLORE_NEEDLES = ("read_file", "open(", "list files")
LOCATE_NEEDLES = ("stack trace", "traceback", "definition", "references", "git blame", "symbol", "line ", "locate")
REPRODUCE_NEEDLES = ("reproduce", "repro", "regression", "failing test", "minimal test")
REFACTOR_NEEDLES = ("refactor", "rename", "format", "black", "prettier", "ruff --fix", "doc-only", "comments only")
TEST_PATTERN = (
    r"(?i)\b(?:pytest|npm (?:run )?test|pnpm (?:run )?test|yarn (?:run )?test|go test|cargo test|mvn test|gradle test|tox|tsc|mypy|ruff|eslint"
    r"|pre-commit|make (?:check|test))\b|-m (?:pytest|unittest)\b"
)


@dataclass(frozen=True)
class Payload:
    """A payload as JSON text, and parsed as VARIANT; what reads fields takes either this or the text alone."""

    text: Column
    doc: Column


def with_doc(events: DataFrame) -> DataFrame:
    """Events with their payloads parsed once, in the VARIANT column ``doc``; as they are if they were stored with it."""
    return events if "doc" in events.columns else events.withColumn("doc", F.try_parse_json("payload"))


def payload(text: str = "payload", doc: str = "doc") -> Payload:
    return Payload(F.col(text), F.col(doc))


def text_of(payload: Column | Payload) -> Column:
    return payload.text if isinstance(payload, Payload) else payload


def any_of(text: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def field(payload: Column | Payload, path: str, kind: str = "string") -> Column:
    """A value of the payload if it is there and of this type, else null; bad JSON gives null."""
    parsed = payload.doc if isinstance(payload, Payload) else F.try_parse_json(payload)
    if kind == "string":  # numbers and objects are not texts
        value = F.try_variant_get(parsed, f"$.{path}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(parsed, f"$.{path}", "string"))
    if kind == "boolean":  # nor are texts flags
        value = F.try_variant_get(parsed, f"$.{path}", "variant")
        return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(parsed, f"$.{path}", "boolean"))
    return F.try_variant_get(parsed, f"$.{path}", kind)


def failed_flag(payload: Column | Payload) -> Column:
    """is_error true, success false, or status failed or error."""
    no = F.lit(False)
    return (
        F.coalesce(field(payload, "is_error", "boolean"), no)
        | F.coalesce(~field(payload, "success", "boolean"), no)
        | F.coalesce(F.lower(field(payload, "status")).isin("failed", "error"), no)
    )


def _code(output: Column, pattern: str) -> Column:
    """Whether the first number that the pattern finds is not zero."""
    return F.coalesce(F.regexp_extract(F.coalesce(output, F.lit("")), pattern, 1).try_cast("bigint") != 0, F.lit(False))


def failed_event(payload: Column | Payload, event_type: Column) -> Column:
    """The analyzer's rule: flags, a non-zero exit code in the output, or an error event."""
    output = field(payload, "output")
    return failed_flag(payload) | _code(output, r'"exit_code"\s*:\s*(\d+)') | _code(output, r"Process exited with code (\d+)") | (event_type == "error")


def failed_dashboard(payload: Column | Payload, event_type: Column) -> Column:
    """The dashboard's rule: no process exit clause, and the exit code's key without a space before the colon."""
    output = field(payload, "output")
    return failed_flag(payload) | (F.coalesce(output.contains('"exit_code":'), F.lit(False)) & _code(output, r'"exit_code"\s*:\s*(\d+)')) | (event_type == "error")


def failed_turn(payload: Column | Payload) -> Column:
    """The turn miner's rule: flags or an exit code; error events don't count by themselves."""
    return failed_flag(payload) | _code(field(payload, "output"), r'"exit_code"\s*:\s*(\d+)')


def failed_text(text: Column) -> Column:
    """The trajectory's rule on text; "0 failed" counts as failed too."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (low.contains("process exited with code ") & ~low.rlike(r"process exited with code 0\b")) | any_of(low, FAILURE_NEEDLES)


def rate_limited(*texts: Column) -> Column:
    return any_of(F.lower(F.concat_ws(" ", *texts)), RATE_LIMIT_PHRASES)


def plain_letters(text: Column) -> Column:
    """Each letter or digit beyond ASCII as a z, so that word borders are the same in all engines."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{L}\p{N}&&[^\x00-\x7F]]", "z")


def correction(text: Column) -> Column:
    return plain_letters(text).rlike("(?i)" + "|".join(f"(?:{p})" for p in CORRECTION_PATTERNS))


def web_search(summary: Column, name: Column, form: str = "signal") -> Column:
    """A web search by its tool's name or its summary: as signals, the dashboard or the miner tell it."""
    named = F.coalesce(name.isin("WebSearch", "web_search"), F.lit(False))
    summary = F.coalesce(summary, F.lit(""))
    if form == "signal":
        return named | F.lower(summary).contains("web_search")
    if form == "dashboard":
        return named | summary.contains("web_search")
    return F.lower(summary).contains("search")


def satisfaction(text: Column) -> Column:
    pos, neg = text.rlike("(?i)" + POSITIVE), text.rlike("(?i)" + NEGATIVE)
    return F.when(text.isNull(), None).when(pos & ~neg, "positive").when(neg & ~pos, "negative").otherwise("neutral")


def interrupted(summary: Column, payload: Column) -> Column:
    text = F.concat(F.lower(F.coalesce(summary, F.lit(""))), F.lit(" "), F.substring(F.lower(F.coalesce(payload, F.lit(""))), 1, 500))
    return any_of(text, INTERRUPT_NEEDLES)


def secret_count(text: Column) -> Column:
    """Matches of all secret patterns."""
    total = F.lit(0)
    for pattern in SECRET_PATTERNS.values():
        total = total + F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))
    return total


def redact(text: Column) -> Column:
    for pattern in SECRET_PATTERNS.values():
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def safe_status(status: Column, text: Column) -> Column:
    bad = any_of(F.lower(text), SUSPICIOUS_MARKERS) | text.rlike(INVISIBLE)
    return F.when((status == "accepted") & bad, "needs_review").otherwise(status)


def looks_like_path(text: Column) -> Column:
    return text.startswith("/") & (F.length(text) < 300) & ~text.contains("\n")


def is_thought(actor: Column, kind: Column) -> Column:
    return (actor == "assistant") & kind.isin("reasoning", "message")


def is_action(actor: Column, kind: Column) -> Column:
    return (actor == "assistant") & kind.isin("tool_call", "command", "file_read", "file_edit", "permission")


def is_result(actor: Column, kind: Column) -> Column:
    return (actor == "tool") | kind.isin("tool_result", "error")


def in_scope(scope: Column, origin: Column, cwd: str | None) -> Column:
    own = F.lit(True) if not cwd else F.coalesce(origin == cwd, F.lit(False))
    return scope.isin("global", "user", "task") | ((scope == "repo") & own)
