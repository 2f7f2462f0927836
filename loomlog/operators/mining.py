"""Candidates of memories from sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..sources.folders import durable
from .windows import SESSION, top_k, turns

#: Fixed values.
CORRECTION_NEEDLES = ("you are right", "you're right", "good catch", "fair", "overstated", "not actually", "doesn't", "does not", "none of these", "is this actually")
REFINEMENTS = {
    "corrected": (
        "failure_trigger", "When the user challenges a research or tool claim, verify the raw evidence and revise the artifact rather than defending the earlier summary.",
        "Use when a user asks whether a previous conclusion is actually supported.", 0.82, 5, "low", "user", "assistant-behavior pattern; applies across all repos",
    ),
    "documented": (
        "procedure", "For project-planning or research requests, create durable docs artifacts under docs/ or specs/, then report the exact paths.",
        "Use when the user asks for a spec, project purpose, research note, or landscape scan.", 0.78, 4, "medium", "user", "working-style preference for durable docs/specs artifacts",
    ),
    "searched": (
        "tool_lesson",
        "Distinguish current, directly verified sources from broad search results. If the topic is fast-moving, prefer recent primary sources and label uncertainty.",
        "Use when researching recent tools, papers, APIs, or agent-memory claims.", 0.7, 4, "medium", "user", "cross-repo tool-use lesson",
    ),
    "captured": (
        "risk_rule",
        "Do not equate persistent memory with full rollout capture. Check whether a system stores raw prompts, assistant messages, tool calls, tool results, file edits, and replayable event traces.",
        "Use when evaluating memory systems for Codex, Claude Code, or coding agents.", 0.86, 5, "low", "global", "foundational rule about evaluating memory/capture systems",
    ),
    "nothing": (
        "procedure",
        "Review the captured rollout before starting a similar task, but do not inject specific advice unless there is clear evidence from user corrections or successful outcomes.",
        "Use when no high-confidence pattern was mined from the rollout.", 0.45, 1, "medium", "task", "fallback when nothing concrete was extracted",
    ),
}


KINDS = ("procedure", "skill", "failure_trigger", "user_preference", "repo_convention", "tool_lesson", "risk_rule", "case")
SCOPES, RISKS = ("user", "repo", "task", "global"), ("low", "medium", "high")
#: Characters of an event's text and of a prompt, and candidates that an answer may have.
EVENT_CHARS, PROMPT_CHARS, MAX_ANSWERS = 900, 55_000, 8

#: Methods (events to candidates) and filters (candidates to candidates) by name; users add to them.
METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {}
FILTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(table: dict, name: str):
    def add(function):
        if name in table:
            raise ValueError(f"{name} is there already")
        table[name] = function
        return function

    return add


def mine(events: DataFrame, method: str, filters: tuple[str, ...] = ()) -> DataFrame:
    """Candidates of a method, behind a chain of filters; unknown names are KeyErrors, no events a ValueError."""
    for table, name in ((METHODS, method), *((FILTERS, f) for f in filters)):
        if name not in table:
            raise KeyError(f"{name}; registered: {sorted(table)}")
    if not events.limit(1).count():
        raise ValueError("no events")
    found = METHODS[method](events).withColumn("method", F.lit(method))
    if "id" not in found.columns:
        # the place among a session's candidates; those of a method without a rank of its own stand by its rules' order
        order = [c for c in ("rank", "_place") if c in found.columns] or [F.lit(1)]
        n = F.row_number().over(Window.partitionBy(*SESSION).orderBy(*order))
        found = found.withColumn("id", F.concat_ws(":", "session_id", "method", n.cast("string"))).drop("_place")
    for name in filters:
        found = FILTERS[name](found)
    return found


def prompts(events: DataFrame) -> DataFrame:
    """(host, session_id, prompt): the compact events of each session as redacted JSON, for a model to read."""
    parts = [F.get_json_object("payload", f"$.{k}") for k in ("text", "message", "thinking", "output", "arguments", "input")]
    text = F.coalesce(F.nullif(F.concat_ws("\n", *parts), F.lit("")), F.substring("payload", 1, EVENT_CHARS), F.lit(""))
    rows = compact(events).select(*SESSION, "ord", F.to_json(F.struct("event_id", "timestamp", "actor", "event_type", P.redact(F.coalesce("summary", F.lit(""))).alias("summary"), P.redact(X.truncate(text, EVENT_CHARS)).alias("text"))).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    whole = F.concat(F.lit("["), F.array_join(lines, ",\n"), F.lit("]"))
    cut = F.when(F.length(whole) > PROMPT_CHARS, F.concat(F.substring(whole, 1, PROMPT_CHARS), F.lit("\n\n[truncated compact rollout]"))).otherwise(whole)
    return rows.groupBy(*SESSION).agg(cut.alias("prompt"))


def validated(answers: DataFrame) -> DataFrame:
    """Candidates of models' answers (host, session_id, answer as JSON): the first MAX_ANSWERS, figures within their bounds, those without text or use left out."""
    item = "struct<kind:string,text:string,when_to_use:string,evidence_refs:array<string>,confidence:string,priority:string,scope:string,risk:string,scope_reason:string>"
    rows = answers.select(*SESSION, F.posexplode(F.slice(F.from_json(F.get_json_object("answer", "$.candidates"), f"array<{item}>"), 1, MAX_ANSWERS)).alias("rank", "c"))
    c = lambda name: F.col("c")[name]
    word = lambda name, default: F.coalesce(c(name), F.lit(default)).alias(name)
    said = lambda name: X.strip(F.coalesce(c(name), F.lit(""))).alias(name)
    return rows.select(
        *SESSION, (F.col("rank") + 1).alias("rank"), word("kind", "procedure"), said("text"), said("when_to_use"), F.slice(F.coalesce(c("evidence_refs"), F.array().cast("array<string>")), 1, 8).alias("evidence_refs"),
        X.clamp(c("confidence"), 0.0, 1.0, 0.5).alias("confidence"), X.clamp(c("priority"), 1.0, 5.0, 3.0).cast("int").alias("priority"), word("scope", "task"), word("risk", "medium"), said("scope_reason"),
    ).where("text <> '' and when_to_use <> ''")


def compact(events: DataFrame, head: int = 70, tail: int = 20) -> DataFrame:
    """What a summary needs of a session: key events and user events, of long ones the first ``head`` and last ``tail``."""
    kinds = ("message", "command", "file_edit", "tool_call", "tool_result", "error", "unknown")
    rows = events.where(F.col("event_type").isin(*kinds) | (F.col("actor") == "user"))
    own = Window.partitionBy(*SESSION)
    rows = rows.withColumn("_up", F.row_number().over(own.orderBy("ord"))).withColumn("_down", F.row_number().over(own.orderBy(F.col("ord").desc()))).withColumn("_n", F.count("*").over(own))
    return rows.where((F.col("_n") <= head + tail) | (F.col("_up") <= head) | (F.col("_down") <= tail)).drop("_up", "_down", "_n")


#: What a user says of a turn before, runs that verify, and titles by words of the request.
COMPLAINT = r"\b(no+|nope|wrong|incorrect|don'?t|stop|revert|undo|that'?s wrong|not (what|right))\b"
PRAISE = r"\b(thanks?|great|perfect|nice|works|ship it|lgtm|love it|exactly)\b"
VERIFYING = (
    r"\bpytest\b|\bnpm (?:run )?test\b|\b(?:pnpm|yarn) (?:run )?test\b|\bgo test\b|\bcargo test\b|\btypecheck\b|\btsc(?:\s|$)|\bmypy\b|\bruff\b|\beslint\b"
    r"|\bmake (?:check|test)\b|\bpre-commit\b|-m (?:pytest|unittest)\b"
)
TITLES = {
    "spec": "draft a spec doc", "test": "add or update tests", "benchmark": "run a benchmark", "plan": "write an implementation plan", "refactor": "refactor existing code", "fix": "investigate and patch a bug",
    "research": "research a topic and summarize findings", "review": "review the changes on this branch", "dashboard": "build or update a dashboard", "import": "import data from a host",
}


def skills(events: DataFrame, k: int = 4, steps: int = 10) -> DataFrame:
    """The best turns of each session as skills: at least two calls, no failed result, and no complaint in the next user message.

    A turn goes from a user message to the next one; those with more edits, then
    more calls, then the earlier ones come first.  A skill says when it starts
    (activation), its steps, when it ends and how it was verified.
    """
    kind, actor = F.col("event_type"), F.col("actor")
    user = (actor == "user") & (kind == "message")
    call = kind.isin("tool_call", "command", "file_edit", "file_read") & (actor == "assistant")
    given = F.coalesce(F.get_json_object("payload", "$.input"), F.get_json_object("payload", "$.arguments"), F.lit(""))
    ran = F.coalesce(*[F.nullif(F.get_json_object(given, f"$.{c}"), F.lit("")) for c in ("command", "cmd")], given)
    edited = F.coalesce(*[P.field(F.col("payload"), f"input.{c}") for c in ("file_path", "path", "file")], F.get(X.object_keys(F.col("payload"), "changes"), F.lit(0)))
    rows = events.withColumn("turn", turns(user)).withColumn("_text", X.event_text(F.col("payload"), F.col("summary")))
    one = F.struct("ord", "event_id", "event_type", X.describe_call(kind, F.col("payload")).alias("line"), X.truncate(ran, 80, flatten=True).alias("ran"), edited.alias("edited"), F.coalesce(P.field(F.col("payload"), "name"), F.lit("the last tool call")).alias("name"))
    first = lambda v: F.min_by(F.when(user, v), F.when(user, F.col("ord")))
    t = rows.groupBy(*SESSION, "turn").agg(
        first(F.col("_text")).alias("asked"), first(F.col("event_id")).alias("asked_id"), F.array_sort(F.collect_list(F.when(call, one))).alias("made"), F.count_if(call & (kind == "file_edit")).alias("edits"),
        F.coalesce(F.bool_or((actor == "tool") & P.failed_turn(F.col("payload"))), F.lit(False)).alias("failed"),
    )
    w = Window.partitionBy(*SESSION).orderBy("turn")
    t = t.withColumn("next", F.lead("asked").over(w)).withColumn("next_id", F.lead("asked_id").over(w)).withColumn("calls", F.size("made"))
    complains = F.coalesce(P.plain_letters(F.col("next")).rlike("(?i)" + COMPLAINT), F.lit(False))
    best = top_k(t.where((F.col("calls") >= 2) & ~F.col("failed") & ~complains), list(SESSION), [F.col("edits").desc(), F.col("calls").desc(), F.col("turn")], k)
    last = F.element_at("made", -1)
    edit = F.element_at(F.filter("made", lambda x: x["event_type"] == "file_edit"), F.lit(-1))
    ends = (
        F.when((F.col("edits") > 0) & edit["edited"].isNotNull(), F.concat(F.lit("after writing "), X.anonymise(edit["edited"]))).when(F.col("edits") > 0, "after the last file edit succeeds")
        .when(last["event_type"] == "command", "after the final command returns exit code 0").otherwise(F.concat(F.lit("after `"), last["name"], F.lit("` returns success")))
    )
    tail = F.filter(F.slice("made", F.greatest(F.col("calls") - 5, F.lit(1)), F.lit(6)), lambda x: (x["event_type"] == "command") & x["ran"].rlike("(?i)" + VERIFYING))
    commands = F.exists("made", lambda x: x["event_type"] == "command")
    verified = F.when(F.size(tail) > 0, F.concat(F.lit("verified by running `"), F.try_element_at(tail, F.lit(-1))["ran"], F.lit("`"))).when((F.col("edits") > 0) & ~commands, "verified by reviewing the resulting file diff")
    asked = F.lower(F.coalesce("asked", F.lit("")))
    hinted = F.coalesce(*[F.when(asked.contains(word), title) for word, title in TITLES.items()], F.when(F.col("edits") > 0, "edit-then-verify workflow"), F.when(commands, "investigate via shell commands"))
    praised = F.coalesce(P.plain_letters(F.col("next")).rlike("(?i)" + PRAISE), F.lit(False))
    confidence = F.when(praised, 0.75).otherwise(0.55)
    lines = F.transform(F.slice("made", 1, steps), lambda x: x["line"])
    more = F.when(F.col("calls") > steps, F.array(F.format_string("… (+%d more)", F.col("calls") - steps))).otherwise(F.array().cast("array<string>"))
    title = F.concat(F.lit("Skill: "), F.coalesce(hinted, F.lit("multi-step tool workflow")))
    activation = F.coalesce(F.nullif(X.truncate(F.col("asked"), 180, flatten=True), F.lit("")), F.lit("(no opening user message)"))
    return best.select(
        *SESSION, "rank", "turn", X.slug(title).alias("id"), F.lit("skill").alias("kind"), title.alias("text"), F.concat(F.lit("Use when the user asks for: "), activation).alias("when_to_use"),
        activation.alias("activation"), F.concat(lines, more).alias("steps"), ends.alias("termination"), F.coalesce(verified, F.lit("(no explicit verification observed)")).alias("verification"),
        F.bround(F.when(verified.isNotNull(), F.least(F.lit(0.85), confidence + 0.05)).otherwise(confidence), 2).alias("confidence"), F.lit(4).alias("priority"), F.lit("medium").alias("risk"),
        F.when(hinted.isNotNull(), "task").otherwise("repo").alias("scope"),
        F.slice(F.array_compact(F.concat(F.array("asked_id"), F.transform(F.slice("made", 1, 4), lambda x: x["event_id"]), F.array("next_id"))), 1, 6).alias("evidence_refs"), "edits", "calls",
    )


#: Advice in messages, words of a conclusion, and phrases of phases.
WARNINGS = (r"\b(?:don'?t|do not) (?:do|use|run|add|delete|remove)[^.\n]{0,80}", r"\b(?:avoid|never|skip|always) [^.\n]{3,80}", r"\bwarn(?:ing)?: [^.\n]{3,80}")
CONCLUDING = ("done", "completed", "shipped", "wrote", "summary", "result", "task complete")
PHASES = {
    "shell": ("ran %d shell command", ""), "edit": ("edited %d file", ""), "read": ("read %d file", ""), "research": ("performed %d web research call", ""),
    "delegate": ("delegated %d sub-task", ""), "tool": ("made %d tool call", ""),
}
NO_STEPS = "This rollout did not contain a coherent tool sequence to abstract into a procedure. Inspect the raw transcript before reusing it."


def _phase(payload: P.Payload) -> Column:
    """Which phase a call belongs to; null for what is no call of the assistant."""
    kind = F.col("event_type")
    name = F.lower(F.coalesce(F.nullif(P.field(payload, "name"), F.lit("")), P.field(payload, "tool_name"), F.lit("")))
    tool = F.when(P.any_of(name, ("search", "fetch", "web")), "research").when(P.any_of(name, ("task", "agent")), "delegate").otherwise("tool")
    named = F.when(kind == "command", "shell").when(kind == "file_edit", "edit").when(kind == "file_read", "read").when(kind == "tool_call", tool)
    return F.when(F.col("actor") == "assistant", named)


def procedures(events: DataFrame, runs: int = 12) -> DataFrame:
    """One procedure a session: its goal, preconditions, phases, warnings and outcome, with its scope and evidence.

    Phases are runs of calls of one kind, the first ``runs``; warnings the first
    five pieces of advice in messages; the outcome is the last message of the
    assistant that concludes, else the last one.  A session without calls gives
    a fallback of little confidence.
    """
    # read for each of the parts below, and parsed once for all
    e = durable(P.with_doc(events).withColumn("_text", X.event_text(P.payload(), F.col("summary"))))
    payload, none = P.payload(), F.lit("")
    message, kind, actor = F.col("event_type") == "message", F.col("event_type"), F.col("actor")
    text = F.col("_text")
    flat = F.replace(X.strip(text), F.lit("\n"), F.lit(" "))
    some = lambda *keys: F.coalesce(*[F.nullif(P.field(payload, k), none) for k in keys])
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("ord")))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("ord")))
    says = (actor == "assistant") & message
    base = e.groupBy(*SESSION).agg(
        first(F.when((actor == "user") & message & (flat != ""), X.truncate(flat, 200))).alias("goal"), first(some("cwd")).alias("_cwd"), first(some("gitBranch", "git_branch", "branch")).alias("_branch"),
        first(some("cwd", "current_working_directory")).alias("origin_repo"), F.coalesce(last(F.when(says & P.any_of(F.lower(text), CONCLUDING), X.truncate(flat, 220))), last(F.when(says, X.truncate(flat, 220))), none).alias("outcome"),
        F.count_if(kind == "file_edit").alias("_edits"), F.min_by("event_id", "ord").alias("_first"),
    )

    called = e.withColumn("phase", _phase(payload)).where("phase is not null").select(*SESSION, "ord", "phase")
    own = Window.partitionBy(*SESSION).orderBy("ord")
    new = F.coalesce(F.lag("phase").over(own) != F.col("phase"), F.lit(True))
    numbered = called.withColumn("_new", new).withColumn("run", F.sum(F.col("_new").cast("int")).over(own)).where(F.col("run") <= runs)
    counted = numbered.groupBy(*SESSION, "run").agg(F.first("phase").alias("phase"), F.count("*").alias("n"))
    said = F.coalesce(*[F.when(F.col("phase") == p, F.format_string(words, "n")) for p, (words, _) in PHASES.items()])
    line = F.concat(said, F.when(F.col("n") == 1, "").otherwise("s"))
    steps = counted.groupBy(*SESSION).agg(F.transform(F.array_sort(F.collect_list(F.struct("run", line.alias("line")))), lambda x: x["line"]).alias("steps"))

    advice = e.where(message).select(*SESSION, "ord", F.array(*[F.regexp_extract_all(text, F.lit(f"(?i)({p})"), 1) for p in WARNINGS]).alias("found"))
    advice = advice.select(*SESSION, "ord", F.posexplode("found").alias("p", "found")).select(*SESSION, "ord", "p", F.posexplode("found").alias("at", "piece"))
    piece = X.strip(F.regexp_replace(X.strip(F.col("piece")), r"\.+$", ""))
    advice = advice.withColumn("piece", piece).where(F.length("piece").between(5, 139))
    once = advice.groupBy(*SESSION, F.lower("piece").alias("_low")).agg(F.min(F.struct("ord", "p", "at", "piece")).alias("r"))
    best = top_k(once, list(SESSION), [F.col("r")], 5)
    warnings = best.groupBy(*SESSION).agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["piece"]).alias("warnings"))

    proof = e.where(kind.isin("message", "command", "file_edit", "tool_call")).withColumn("_n", F.row_number().over(Window.partitionBy(*SESSION, "event_type").orderBy("ord"))).where("_n <= 2")
    proof = proof.groupBy(*SESSION).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "event_id"))), 1, 6), lambda x: x["event_id"]).alias("_refs"))

    found = base.withColumn("_origin", F.col("origin_repo"))
    edits = e.where(kind == "file_edit").join(found.select(*SESSION, "_origin"), list(SESSION))
    inside = F.coalesce(F.lit(0) + F.coalesce(*[F.when(P.field(payload, f"input.{k}").contains(F.col("_origin")), 1) for k in ("file_path", "path", "file")], F.lit(0)), F.lit(0))
    inside = inside + F.exists(X.object_keys(F.col("payload"), "changes"), lambda c: c.contains(F.col("_origin"))).cast("int")
    local = edits.groupBy(*SESSION).agg(F.sum(F.coalesce(inside, F.lit(0))).alias("_local"))
    df = found
    for more in (steps, warnings, proof, local):
        df = df.join(more, list(SESSION), "left")
    empty = F.array().cast("array<string>")
    n = F.coalesce(F.size("steps"), F.lit(0))
    there = F.col("steps").isNotNull()
    goal = F.coalesce("goal", none)
    local_ = F.coalesce("_local", F.lit(0))
    confidence = F.bround(F.least(F.lit(0.85), 0.45 + 0.05 * n + 0.05 * F.col("_edits")), 2)
    reason = (
        F.when(~there, "fallback when no procedure was extracted").when(F.col("origin_repo").isNull(), "no origin repo known; treating as task-shaped procedure")
        .when(local_ == 0, "session has no file edits inside the origin repo").otherwise(F.format_string("procedure edits %d file(s) inside %s", local_, "origin_repo"))
    )
    before = F.array_compact(F.array(F.concat(F.lit("host="), "host"), F.concat(F.lit("cwd="), "_cwd"), F.concat(F.lit("git_branch="), "_branch")))
    return df.select(
        *SESSION, F.lit("procedure").alias("kind"),
        F.when(~there, NO_STEPS).when(goal != "", F.concat(F.lit("Procedure for: "), goal)).otherwise("Procedure for this rollout's overall task").alias("text"),
        F.when(~there, "Skip; insufficient evidence.").when(goal != "", F.concat(F.lit("Use when the user's request resembles: "), X.truncate(goal, 160))).otherwise("Use when starting a task with a similar overall shape.").alias("when_to_use"),
        F.when(there, F.coalesce("_refs", empty)).otherwise(F.array("_first")).alias("evidence_refs"), F.when(there, confidence).otherwise(0.2).alias("confidence"),
        F.when(~there, 1).when(n >= 3, 4).otherwise(2).alias("priority"), F.lit("medium").alias("risk"), F.when(there & F.col("origin_repo").isNotNull() & (local_ > 0), "repo").otherwise("task").alias("scope"),
        reason.alias("scope_reason"), "origin_repo", F.when(there, F.struct(goal.alias("goal"), before.alias("preconditions"), "steps", F.coalesce("warnings", empty).alias("warnings"), "outcome")).alias("structured"),
    )


def refinements(events: DataFrame) -> DataFrame:
    """Fixed candidates that a session's events call for, or one that says that nothing did.

    Evidence is the events that a rule fits, the first eight in order.
    """
    text = F.lower(X.event_text(F.col("payload"), F.col("summary")))
    message, edit = F.col("event_type") == "message", F.col("event_type") == "file_edit"
    changes = F.coalesce(F.from_json(F.get_json_object("payload", "$.changes"), "map<string,struct<type:string>>"), F.create_map().cast("map<string,struct<type:string>>"))
    documented = F.exists(F.map_entries(changes), lambda e: (e["key"].contains("/docs/") | e["key"].contains("/specs/")) & F.coalesce(e["value"]["type"].isin("add", "update"), F.lit(False)))
    rules = {
        "corrected": (F.bool_or((F.col("actor") == "user") & P.any_of(text, CORRECTION_NEEDLES)), (F.col("actor") == "user") & P.any_of(text, CORRECTION_NEEDLES)),
        "documented": (F.bool_or(edit & documented), edit),
        "searched": (F.bool_or(P.web_search(F.col("summary"), F.lit(None), "miner")), P.web_search(F.col("summary"), F.lit(None), "miner")),
        "captured": (
            F.coalesce(F.bool_or(message & text.contains("full rollout")), F.lit(False)) & F.coalesce(F.bool_or(message & P.any_of(text, ("memory", "capture"))), F.lit(False)),
            message & P.any_of(text, ("full rollout", "raw", "capture")),
        ),
    }
    proof = lambda c: F.transform(F.slice(F.array_sort(F.collect_list(F.when(c, F.struct("ord", "event_id")))), 1, 8), lambda x: x["event_id"])
    found = events.groupBy(*SESSION).agg(
        *[F.coalesce(flag, F.lit(False)).alias(name) for name, (flag, _) in rules.items()],
        *[proof(c).alias(f"{name}_refs") for name, (_, c) in rules.items()],
        F.array(F.min_by("event_id", "ord")).alias("nothing_refs"),
    )
    found = found.withColumn("nothing", ~(F.col("corrected") | F.col("documented") | F.col("searched") | F.col("captured")))

    def candidate(name: str) -> Column:
        kind, says, when, confidence, priority, risk, scope, reason = REFINEMENTS[name]
        parts = {"rule": name, "kind": kind, "text": says, "when_to_use": when, "confidence": confidence, "priority": priority, "risk": risk, "scope": scope, "scope_reason": reason}
        return F.when(F.col(name), F.struct(*[F.lit(v).alias(k) for k, v in parts.items()], F.col(f"{name}_refs").alias("evidence_refs")))

    every = F.array_compact(F.array(*[candidate(name) for name in REFINEMENTS]))
    return found.select(*SESSION, F.posexplode(every).alias("_place", "c")).select(*SESSION, "_place", "c.*")


def risk_aware(candidates: DataFrame) -> DataFrame:
    """The candidates that stay of each session and method, by rank: none of high risk or little confidence, none like one before, at most eight."""
    from .memory import near_duplicates

    candidates = durable(candidates)  # read twice, and dear to make again
    keys = [*SESSION, "method"]
    said = F.concat_ws(" ", "text", "when_to_use")
    one = F.struct(*keys)  # a session's methods are filtered apart
    rows = candidates.select(one.alias("session_id"), "id", "kind", said.alias("text"), "risk", "confidence", "priority")
    kept = near_duplicates(rows).select("session_id.*", "rank", "id")
    return candidates.drop("rank").join(kept, [*keys, "id"])


METHODS |= {"refine": refinements, "skills": skills, "procedures": procedures}
FILTERS["risk_aware"] = risk_aware


def model_method(answers: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A method that takes what a model has answered to ``prompts``, for METHODS; sessions of the events only."""
    return lambda events: validated(answers).join(events.select(*SESSION).distinct(), list(SESSION), "left_semi")
