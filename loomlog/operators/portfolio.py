"""Roll-ups over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_day(sessions: DataFrame, hosts: tuple[str, str]) -> DataFrame:
    """Per day: sessions by host, tokens, cost."""
    of = lambda h: F.count_if(F.col("host") == h)
    return sessions.groupBy("day").agg(F.count("*").alias("sessions"), of(hosts[0]).alias("sessions_a"), of(hosts[1]).alias("sessions_b"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))


def totals(sessions: DataFrame) -> DataFrame:
    """One row: counts, sums and averages, days on which something ran."""
    return sessions.agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.count_if(F.col("tokens") > 0).alias("with_tokens"), F.count_if(F.col("cost") > 0).alias("with_cost"), F.count_distinct("day").alias("active_days"),
        F.bround(F.avg("n_events"), 1).alias("mean_events"),
    )


def projects(sessions: DataFrame) -> DataFrame:
    """Per project: sessions, tokens, cost, hosts and its last day; most sessions first."""
    return sessions.groupBy("project").agg(
        F.count("*").alias("sessions"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"),
        F.array_join(F.array_sort(F.collect_set("host")), ",").alias("hosts"), F.max_by("day", F.struct("day", "session_id")).alias("last_day"),
    )


def failure_rates(calls: DataFrame, key: str, k: int = 15) -> DataFrame:
    """By key for each host and for all: calls, failures and their share; the ``k`` most used of each."""
    counted = calls.rollup(key, "host").agg(F.count("*").alias("n"), F.count_if("failed").alias("fails"), F.min("ord").alias("_first")).where(f"{key} is not null")
    from .windows import top_k

    named = counted.withColumn("host", F.coalesce("host", F.lit("total"))).withColumn("rate", F.bround(F.col("fails") / F.col("n"), 4))
    return top_k(named, ["host"], [F.col("n").desc(), F.col("_first"), F.col(key)], k).drop("_first")


def high_cost_cutoff(costs: DataFrame, column: str = "cost") -> DataFrame:
    """The positive cost at rank max(0, floor(0.8 n) - 1), counted from the smallest: a nearest rank, by sorted runs of equal costs.

    Equal costs are summed up first, so the running count is over distinct values.
    """
    from pyspark.sql import Window

    values = costs.where(F.col(column) > 0).groupBy(F.col(column).alias("cutoff")).agg(F.count("*").alias("k")).persist()  # read three times
    n = values.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    want = max(0, int(0.8 * n) - 1)
    # counts by ranges of value first, so that only one range is put in order
    bounds = values.approxQuantile("cutoff", [i / 64 for i in range(1, 64)], 0.001) if n else []
    part = F.size(F.filter(F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]), lambda b: b < F.col("cutoff"))) if bounds else F.lit(0)
    dealt = values.withColumn("part", part)
    at, chosen, before = 0, 0, 0
    for p, size in sorted((r[0], r[1]) for r in dealt.groupBy("part").agg(F.sum("k")).collect()):
        if at + size > want:
            chosen, before = p, at
            break
        at += size
    running = F.sum("k").over(Window.partitionBy("part").orderBy("cutoff"))
    return dealt.where(F.col("part") == chosen).withColumn("upto", running + before).where(F.col("upto") > want).agg(F.min("cutoff").alias("cutoff"))


def grouping_counts(rows: DataFrame, a: str, b: str, distinct: str) -> DataFrame:
    """Counts by a, by b, by both and of all, with distinct values, in one pass."""
    sets = rows.groupingSets([[F.col(a)], [F.col(b)], [F.col(a), F.col(b)], []], F.col(a), F.col(b))
    return sets.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.count_distinct(distinct).alias("n_distinct"))


def filter_sessions(sessions: DataFrame, host: str | None = None, project: str | None = None, text: str | None = None, haystack: tuple[str, ...] = ()) -> DataFrame:
    """Sessions of a host and project whose columns hold the text."""
    if host:
        sessions = sessions.where(F.col("host") == host)
    if project:
        sessions = sessions.where(F.col("project") == project)
    if text:
        sessions = sessions.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in haystack])), F.lit(text.lower())))
    return sessions


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The page with this number, from 0."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def diagnostics(sessions: DataFrame) -> DataFrame:
    """Warnings of sessions with (user_messages, search_commands, results, failures)."""
    rate = F.col("failures") / F.nullif(F.col("results"), F.lit(0))
    labels = F.array(
        F.when(F.col("user_messages") > 35, "long conversation"),
        F.when(F.col("search_commands") > 10, "many searches"),
        F.when((F.col("results") > 5) & (rate > 0.3), "many failures"),
    )
    return sessions.select("*", F.array_compact(labels).alias("warnings"))


#: What a day and the whole sum up, and the price categories.
DAY_SUMS = ("tokens", "cost", "tool_call_events", "file_edit_events", "cost_input", "cost_cache_create", "cost_cache_read", "cost_output", "rate_limit_hits")
TOTAL_SUMS = (
    "event_count", "user_messages", "assistant_messages", "tool_call_events", "tool_result_events", "command_events", "file_read_events", "file_edit_events", "failed_events", "unknown_events",
    "tokens", "rate_limit_hits", "cost", "cost_input", "cost_cache_create", "cost_cache_read", "cost_output",
)
ROLES = {
    "Systems Programmer": ("cargo", "go", "make", "docker", "gcc", "clang", "git_worktree"),
    "Data Scientist / ML Engineer": ("python", "python3", "jupyter", "pandas", "numpy", "conda"),
    "Frontend Engineer": ("npm", "node", "tsc", "vite", "eslint", "prettier", "yarn", "pnpm"),
}
NO_ROLE = "General Software Engineer"
ADVICE = {
    "explore": "High exploration ratio detected. Consider creating an AGENTS.md or .cursorrules file in your repository root to document entry points, which will reduce redundant file scans.",
    "turns": "Your sessions average over 25 turns, which leads to context bloat and higher token costs. Try splitting large feature tickets into smaller tasks in fresh sessions.",
    "failures": "More than 20% of commands run are failing. To save tokens and avoid loops, try aligning on a plan upfront or using verification commands before running edits.",
    "fine": "Your operator hygiene is excellent! Keep maintaining short, focused sessions and writing clear plans.",
}


def _sum(name: str) -> Column:
    total = F.coalesce(F.sum(name), F.lit(0))
    return (F.bround(total.cast("double"), 6) if name.startswith("cost") else total).alias(name)


def days(sessions: DataFrame, hosts: tuple[str, str]) -> DataFrame:
    """Twelve measures of each date: sessions, of each host, and the sums of DAY_SUMS, costs to six places."""
    of = lambda h: F.count_if(F.col("host") == h)
    return sessions.groupBy("date").agg(F.count("*").alias("sessions"), of(hosts[0]).alias("sessions_a"), of(hosts[1]).alias("sessions_b"), *[_sum(c) for c in DAY_SUMS])


def overall(sessions: DataFrame) -> DataFrame:
    """One row of all sessions: the sums of TOTAL_SUMS, counts and averages."""
    n = F.nullif(F.count("*"), F.lit(0))
    return sessions.agg(
        F.count("*").alias("sessions"), *[_sum(c) for c in TOTAL_SUMS],
        F.count_if(F.col("tokens") > 0).alias("sessions_with_tokens"), F.count_if(F.col("cost").isNotNull()).alias("sessions_with_cost"),
        F.count_distinct(F.when(F.col("date") != "unknown", F.col("date"))).alias("active_days"), F.floor(F.avg("duration_seconds")).alias("avg_duration_seconds"),
        F.bround(F.sum("event_count") / n, 1).alias("avg_events"), F.bround(F.sum("tool_call_events") / n, 1).alias("avg_tool_calls"),
        F.count_distinct(F.when(F.col("project_name") != "unknown", F.col("project_name"))).alias("projects"),
    )


def project_list(sessions: DataFrame) -> DataFrame:
    """Projects with sessions, tokens, cost, hosts and the path of their last session (by rank) that has one; most sessions first."""
    some = F.nullif("project_path", F.lit(""))
    rows = sessions.groupBy(F.coalesce(F.nullif("project_name", F.lit("")), F.lit("unknown")).alias("name")).agg(
        F.coalesce(F.max_by(some, F.when(some.isNotNull(), F.col("rank"))), F.lit("")).alias("path"), F.count("*").alias("sessions"), F.sum("tokens").alias("tokens"),
        F.bround(F.sum("cost"), 6).alias("cost"), F.array_sort(F.collect_set("host")).alias("hosts"), F.min("rank").alias("_first"),
    )
    return rows.orderBy(F.desc("sessions"), "_first").drop("_first")


def operator(sessions: DataFrame, tools: DataFrame) -> DataFrame:
    """One row on who runs the sessions: turns, failures, ratios, cost, a role by their tools, and advice.

    ``sessions`` has user_messages, command_events, failed_events, cost and the two
    ratios (null: no reading); ``tools`` has name and count.
    """
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.5))
    s = sessions.agg(
        F.coalesce(F.avg("user_messages"), F.lit(0.0)).alias("turns"), F.when(F.sum("command_events") > 0, F.sum("failed_events") / F.sum("command_events")).otherwise(0.0).alias("fails"),
        mean("exploration_ratio").alias("explore"), mean("exploitation_ratio").alias("exploit"), F.coalesce(F.sum(F.coalesce("cost", F.lit(0.0))) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("cost"), F.count("*").alias("n"),
    )
    scores = tools.agg(*[F.coalesce(F.sum(F.when(F.col("name").isin(*names), F.col("count"))), F.lit(0)).alias(role) for role, names in ROLES.items()])
    role = F.lit(NO_ROLE)
    for name in ROLES:
        others = [F.col(f"`{x}`") for x in ROLES if x != name]
        role = F.when((F.col(f"`{name}`") > others[0]) & (F.col(f"`{name}`") > others[1]), name).otherwise(role)
    advice = F.array_compact(F.array(F.when(F.col("explore") > 0.65, ADVICE["explore"]), F.when(F.col("turns") > 25, ADVICE["turns"]), F.when(F.col("fails") > 0.20, ADVICE["failures"])))
    none = F.array().cast("array<string>")
    return s.join(F.broadcast(scores)).select(  # one row and one row
        F.bround("turns", 1).alias("avg_turns"), F.bround("fails", 3).alias("cmd_failure_rate"), F.bround(F.when(F.col("n") > 0, F.col("explore")).otherwise(0.0), 3).alias("explore_ratio"),
        F.bround(F.when(F.col("n") > 0, F.col("exploit")).otherwise(0.0), 3).alias("exploit_ratio"), F.bround("cost", 4).alias("avg_cost"), role.alias("role"),
        F.when(F.col("n") == 0, none).when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(ADVICE["fine"]))).alias("recommendations"),
    )


def experiments(aggregates: DataFrame) -> DataFrame:
    """One row of the signals' aggregates (signal, mean, true_count, ...): what the experiments' summary picks, and the category with the largest mean ratio."""
    pick = lambda signal, c: F.max(F.when(F.col("signal") == f"trajectory_{signal}", F.col(c)))
    ratio = F.when(F.col("signal").startswith("trajectory_action_ratio_") & ~F.col("signal").rlike("(permission|error|other)$"), F.col("mean"))
    return aggregates.agg(
        F.count("*").alias("signal_count"), pick("step_count", "mean").alias("avg_steps"), F.coalesce(pick("premature_finish_without_validation", "true_count"), F.lit(0)).alias("unvalidated_sessions"),
        F.coalesce(pick("validation_presence", "true_count"), F.lit(0)).alias("validation_sessions"), pick("sequence_entropy", "mean").alias("mean_entropy"), pick("action_redundancy", "mean").alias("mean_redundancy"),
        F.substring(F.max_by("signal", F.struct(ratio, "signal")), 25, 100).alias("top_category"),
    )
