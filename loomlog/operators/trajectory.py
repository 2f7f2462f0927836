"""Steps of sessions, and what their order says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from .prefix import Latest, Total, scan
from .windows import SESSION, in_order, islands, next_match, so_far

#: Fixed values.
CORE = ("explore", "locate", "search", "reproduce", "generate_fix", "run_tests", "refactor", "explain")
CATEGORIES = (*CORE, "permission", "error", "other")
EXPLORING = ("explore", "search", "locate", "explain")
EXPLOITING = ("reproduce", "generate_fix", "run_tests", "refactor")
RECOVERING = ("search", "explore", "locate", "generate_fix", "run_tests")


def judged(steps: DataFrame, names: tuple[str, ...] = ("event_type", "actor", "payload", "doc", "summary", "text")) -> DataFrame:
    """Actions with ``category`` and ``fp``; ``names`` are the columns of their kind, actor, payload, its VARIANT, summary and text.

    What several rules read, the command, the tool's name and the text they
    search, is worked out once a row, in columns of its own.
    """
    kind, actor, text_, doc, summary, text = (F.col(n) for n in names)
    payload, none = P.Payload(text_, doc), F.lit("")
    df = steps.withColumns({"_command": X.command_text(payload, summary), "_name": F.lower(F.coalesce(X.tool_name(payload), none))})
    command, name = F.col("_command"), F.col("_name")
    hay = F.lower(F.concat_ws(" ", kind, actor, F.coalesce(summary, none), F.coalesce(text, none), name, command, F.coalesce(F.get_json_object(text_, "$.input"), none)))
    failed = P.failed_flag(payload) | P.failed_text(F.concat_ws(" ", text_, summary))
    df = df.withColumns({"_hay": hay, "_first": F.lower(F.split(X.strip(command), r"\s+")[0]), "_failed": failed})
    df = df.withColumns({"category": category(kind, actor), "fp": fingerprint(kind, actor, payload, text)})
    return df.drop("_command", "_name", "_hay", "_first", "_failed")


def category(kind: Column, actor: Column) -> Column:
    """The first rule that fits an action: error, permission, edit, tests, reproduce, search, explore, locate, explain, refactor."""
    hay, first, name = F.col("_hay"), F.col("_first"), F.col("_name")
    refactor = P.any_of(hay, P.REFACTOR_NEEDLES)
    return (
        F.when((kind == "error") | F.col("_failed"), "error")
        .when((kind == "permission") | hay.contains("permission") | hay.contains("approval"), "permission")
        .when((kind == "file_edit") | name.isin(*P.PATCH_NAMES), F.when(refactor, "refactor").otherwise("generate_fix"))
        .when(F.col("_command").rlike(P.TEST_PATTERN) | hay.rlike(P.TEST_PATTERN), "run_tests")
        .when(P.any_of(hay, P.REPRODUCE_NEEDLES), "reproduce")
        .when(first.isin(*P.SEARCH_COMMANDS) | P.any_of(hay, P.SEARCH_NEEDLES), "search")
        .when((kind == "file_read") | first.isin(*P.EXPLORE_COMMANDS) | P.any_of(hay, P.EXPLORE_NEEDLES), "explore")
        .when(P.any_of(hay, P.LOCATE_NEEDLES), "locate")
        .when((kind == "message") & (actor == "assistant"), "explain")
        .when(refactor, "refactor")
        .otherwise("other")
    )


def fingerprint(kind: Column, actor: Column, payload: P.Payload, text: Column) -> Column:
    keyed = [F.concat(F.lit(f"{k}="), F.nullif(P.field(payload, k), F.lit(""))) for k in ("file_path", "path", "filepath", "cwd")]
    keyed += [F.concat(F.lit(f"{k}="), F.nullif(P.field(payload, f"input.{k}"), F.lit(""))) for k in ("file_path", "path", "filepath", "cmd", "command")]
    more = F.concat_ws(" ", F.nullif("_name", F.lit("")), F.nullif("_command", F.lit("")), *keyed)
    return X.normal_fingerprint(F.concat_ws(" ", kind, actor, F.coalesce(F.nullif(more, F.lit("")), text)))


def build(events: DataFrame, parts: int | None = None) -> DataFrame:
    """Steps of ordered events (host, session_id, ord, event_id, actor, event_type, summary, payload).

    An action of the assistant opens a step and takes up to three thoughts that
    came since the last one; results go to the step that is open.  A thought
    closes it; user and system events change nothing.  Thoughts that no action
    follows are dropped.  All of it is running sums over one ordering: a
    window a session, or, with ``parts``, ranges of sessions of any length.
    """
    actor, kind = F.col("actor"), F.col("event_type")
    action, thought, result = P.is_action(actor, kind), P.is_thought(actor, kind), P.is_result(actor, kind)
    events = P.with_doc(events)
    text = X.event_text(P.payload(), F.col("summary"))
    role = F.when(action, "A").when(thought, "T").when(result, "R")
    df = events.withColumn("_text", text).withColumn("_role", role).where("_role is not null").drop("doc")
    acts, opens = F.when(F.col("_role") == "A", 1).otherwise(0), F.when(F.col("_role") != "R", F.col("_role"))
    if parts:
        df = scan(df, parts=parts, _n=Total(acts), _open=Latest(opens))
    else:
        df = df.withColumn("_n", F.sum(acts).over(so_far("ord"))).withColumn("_open", F.last(opens, True).over(so_far("ord")))
    step = F.when(F.col("_role") == "T", F.col("_n") + 1).when((F.col("_role") == "A") | (F.col("_open") == "A"), F.col("_n"))
    df = df.withColumn("_step", step).where("_step is not null")
    return gathered(df.drop("_n", "_open"))


def gathered(df: DataFrame) -> DataFrame:
    """The steps of their events: those with ``_step`` (from 1), ``_role`` and ``_text``, all that a step has."""
    late = Window.partitionBy(*SESSION, "_step", "_role").orderBy(F.col("ord").desc())
    df = df.withColumn("_back", F.row_number().over(late)).where("_role <> 'T' or _back <= 3")

    def of(letter: str, value: str | Column) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        rows = F.array_sort(F.collect_list(F.when(F.col("_role") == letter, F.struct(F.col("ord"), value.alias("v")))))
        return F.transform(rows, lambda r: r["v"])

    short = X.truncate(F.col("_text"), 500, flatten=True)
    first = lambda c: F.max(F.when(F.col("_role") == "A", F.col(c)))
    steps = df.groupBy(*SESSION, "_step").agg(
        of("T", "event_id").alias("thought_event_ids"),
        first("event_id").alias("action_event_id"),
        of("R", "event_id").alias("result_event_ids"),
        X.strip(F.array_join(of("T", short), "\n")).alias("thought_text"),
        X.strip(F.array_join(of("R", short), "\n")).alias("result_text"),
        *[first(c).alias(f"_{c}") for c in ("event_type", "actor", "payload", "summary", "_text")],
    )
    steps = steps.where("action_event_id is not null").withColumn("_doc", F.try_parse_json("_payload"))
    steps = judged(steps, ("_event_type", "_actor", "_payload", "_doc", "_summary", "__text"))
    payload, summary, text = P.payload("_payload", "_doc"), F.col("_summary"), F.col("__text")
    own = F.coalesce(F.nullif(F.when(text != F.coalesce(summary, F.lit("")), text), F.lit("")), F.nullif(X.command_text(payload, summary), F.lit("")), summary, text)
    steps = steps.select(
        *SESSION,
        (F.col("_step") - 1).cast("long").alias("idx"),  # every number up to the last has its action
        "thought_event_ids", "action_event_id", "result_event_ids", "thought_text", X.truncate(own, 1000, flatten=True).alias("action_text"), "result_text",
        "category", "fp", X.fingerprint_key(F.col("fp")).alias("fp_key"),
    )
    return steps.withColumn("failed", P.failed_text(F.col("result_text")))


def annotate(steps: DataFrame) -> DataFrame:
    """What each step's neighbours say, by windows over one partitioning (host, session_id, idx, category, fp, failed)."""
    w = in_order()
    cat, fp = F.col("category"), F.col("fp")
    prev_cat, prev_fp = F.lag("category").over(w), F.lag("fp").over(w)
    df = steps.select("*", prev_cat.alias("prev_cat"), prev_fp.alias("prev_fp"), *[F.lead(c, k).over(w).alias(f"{c}_{k}") for c in ("category", "failed", "fp") for k in (1, 2, 3) if c == "category" or (c, k) in (("failed", 1), ("failed", 3), ("fp", 1))])
    changed = F.col("prev_cat").isNull() | ((cat != F.col("prev_cat")) & (fp != F.col("prev_fp")))
    df = df.withColumn("run", islands(changed))
    pair_changed = F.col("prev_cat").isNull() | (cat != F.col("prev_cat")) | (fp != F.col("prev_fp"))
    before = F.collect_list(F.struct("category", "fp")).over(w.rowsBetween(-3, -1))
    return df.select(
        "*",
        next_match(pair_changed, F.col("idx")).alias("next_other"),
        next_match(cat == "run_tests", F.col("idx")).alias("next_test"),
        F.coalesce(F.max(cat == "run_tests").over(w.rowsBetween(1, 4)), F.lit(False)).alias("tested_soon"),
        F.exists(before, lambda x: (x["category"] == cat) & (x["fp"] == fp)).alias("seen_before"),
        F.concat_ws(" -> ", cat, "category_1", "category_2", "category_3").alias("gram"),
    )


def measure(steps: DataFrame) -> DataFrame:
    """One row a session with the trajectory figures; ratios are rounded half-even to four places."""
    df = annotate(steps)
    cat, idx, n = F.col("category"), F.col("idx"), F.count("*")
    ratio = lambda a, b, places=4: F.bround(a / F.nullif(b.cast("double"), F.lit(0.0)), places)
    when = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    fix, test = cat == "generate_fix", cat == "run_tests"
    explore, exploit = F.avg(cat.isin(*EXPLORING).cast("int")), F.avg(cat.isin(*EXPLOITING).cast("int"))
    loop = fix & (F.col("category_1") == "run_tests") & (F.col("category_2") == "generate_fix") & (F.col("category_3") == "run_tests") & (F.col("failed_1") | F.col("failed_3"))
    ignored = F.col("failed") & ((F.col("fp_1") == F.col("fp")) | F.col("category_1").isin("explain", "other"))
    followed = F.col("failed") & F.col("category_1").isNotNull()
    base = df.groupBy(*SESSION).agg(
        n.alias("step_count"),
        ratio(when(cat.isin("other", "error")), n).alias("unknown_action_ratio"),
        (F.count_distinct(F.when(cat.isin(*CORE), cat)) / 8.0).alias("phase_coverage"),
        F.coalesce(F.max(F.when(test, idx)) > F.min(F.when(fix, idx)), F.lit(False)).alias("validation_presence"),
        *[when(cat == c).alias(f"action_count_{c}") for c in CATEGORIES],
        *[ratio(when(cat == c), n).alias(f"action_ratio_{c}") for c in CATEGORIES],
        (n - F.count_distinct("fp")).alias("action_redundancy"),
        when((cat == F.col("prev_cat")) | (F.col("fp") == F.col("prev_fp"))).alias("consecutive_repetition_count"),
        when(cat != F.col("prev_cat")).alias("phase_transition_count"),
        when(F.col("seen_before")).alias("repeated_action_without_progress"),
        when(fix & ~F.col("tested_soon")).alias("fix_without_validation_count"),
        F.median(F.when(fix, F.col("next_test") - idx)).alias("fix_validation_latency_steps"),
        F.coalesce(F.max(F.when(fix, idx)) > F.coalesce(F.max(F.when(test, idx)), F.lit(-1)), F.lit(False)).alias("premature_finish_without_validation"),
        when(loop).alias("test_fix_loop_count"),
        F.median(F.when(F.col("failed"), F.col("next_other") - idx)).alias("failed_result_recovery_steps"),
        when(ignored).alias("failure_ignored_count"),
        ratio(when(followed & F.col("category_1").isin(*RECOVERING)), when(followed)).alias("error_to_search_or_edit_ratio"),
        F.bround(explore, 4).alias("exploration_ratio"),
        F.bround(exploit, 4).alias("exploitation_ratio"),
        F.bround(1 - F.abs(explore - exploit), 4).alias("balance_score"),
    )
    runs = df.groupBy(*SESSION, "run").agg(n.alias("k")).groupBy(*SESSION).agg(F.max("k").alias("max_repetition_run"))
    grams = df.where("category_3 is not null").groupBy(*SESSION, "gram").agg(n.alias("k"), F.min("idx").alias("first"))
    grams = grams.groupBy(*SESSION).agg(
        F.bround(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)) / F.sum("k"), 4).alias("gram4_repetition_ratio"),
        F.max_by("gram", F.struct("k", -F.col("first"))).alias("gram4_top"),
    )
    shares = df.groupBy(*SESSION, "category").agg(n.alias("k"))
    total = F.sum("k").over(Window.partitionBy(*SESSION))
    entropy = shares.withColumn("p", F.col("k") / total).groupBy(*SESSION).agg(F.bround(-F.sum(F.col("p") * F.log2("p")), 4).alias("sequence_entropy"))
    keys = list(SESSION)
    return base.join(runs, keys).join(grams, keys, "left").join(entropy, keys).fillna({"gram4_repetition_ratio": 0.0})


def token_reuse(steps: DataFrame) -> DataFrame:
    """Share of steps whose result's terms come up in the next step's thoughts or action."""
    w = in_order()
    terms = X.salient_terms(F.col("result_text"))
    after_ = F.lower(F.concat_ws(" ", F.lead("thought_text").over(w), F.lead("action_text").over(w)))
    df = steps.select(*SESSION, terms.alias("terms"), F.when(F.lead("idx").over(w).isNotNull(), after_).alias("later")).where("later is not null and size(terms) > 0")
    used = F.exists("terms", lambda t: F.col("later").contains(F.lower(t)))
    return df.groupBy(*SESSION).agg(F.bround(F.avg(used.cast("int")), 4).alias("result_token_reuse_ratio"))


def readings(measured: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row a session and figure: signal, value (double; flags as 0 and 1)."""
    kinds = dict(measured.dtypes)
    names = names or [c for c in measured.columns if c not in SESSION and kinds[c] != "string"]
    value = lambda c: (F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)).cast("double")
    pairs = F.array(*[F.struct(F.lit(f"trajectory_{c}").alias("signal"), value(c).alias("value")) for c in names])
    return measured.select(*SESSION, F.inline(pairs))


def aggregate(readings_: DataFrame) -> DataFrame:
    """Per signal: present and missing readings, range, mean, median, 90th percentile and sum."""
    v = F.col("value")
    return readings_.groupBy("signal").agg(
        F.count("value").alias("present"), F.count_if(v.isNull()).alias("missing"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.bround(F.avg(v), 3).alias("mean"), F.median(v).alias("median"), F.bround(F.percentile(v, 0.9), 3).alias("p90"), F.bround(F.sum(v), 3).alias("total"),
    )


def badges(measured: DataFrame) -> DataFrame:
    """Labels of the risks that a session shows, in this order."""
    fixes, ignored = F.col("fix_without_validation_count"), F.col("failure_ignored_count")
    labels = F.array(
        F.when(F.col("premature_finish_without_validation"), "unvalidated"),
        F.when(F.col("repeated_action_without_progress") > 0, "repeat"),
        F.when(fixes > 0, F.format_string("%d fix/no-test", fixes)),
        F.when(ignored > 0, F.format_string("%d ignored-failure", ignored)),
    )
    return measured.select(*SESSION, F.array_compact(labels).alias("badges"))
