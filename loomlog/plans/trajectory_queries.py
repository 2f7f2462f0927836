"""Queries over steps, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trajectory as T
from ..operators import windows as W
from ..operators.prefix import Latest, Next, Total, lag, longest_run, scan
from ..sources.views import STEPS_SQL, event_steps

KEYS = list(W.SESSION)


def _measured(*columns: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return T.measure(event_steps(spark, sf_dir)).select(*KEYS, *columns)

    return query


COUNTS = ["step_count", "unknown_action_ratio", "phase_coverage", "exploration_ratio", "exploitation_ratio", "balance_score"]
CATEGORY_COUNTS = [f"action_count_{c}" for c in T.CATEGORIES] + [f"action_ratio_{c}" for c in T.CATEGORIES]
REPEATS = ["action_redundancy", "consecutive_repetition_count", "phase_transition_count", "repeated_action_without_progress", "max_repetition_run"]
GRAMS = ["gram4_repetition_ratio", "gram4_top", "sequence_entropy"]
VALIDATION = ["validation_presence", "fix_without_validation_count", "fix_validation_latency_steps", "premature_finish_without_validation", "test_fix_loop_count"]
RECOVERY = ["failed_result_recovery_steps", "failure_ignored_count", "error_to_search_or_edit_ratio"]


def signal_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["step_count", *(f"action_count_{c}" for c in T.CATEGORIES), "phase_transition_count", "sequence_entropy"]
    measured = T.measure(event_steps(spark, sf_dir))
    return T.aggregate(T.readings(measured, names))


def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition counts between neighbouring steps."""
    steps = event_steps(spark, sf_dir).select("host", "session_id", "category", F.lag("category").over(W.in_order()).alias("before"))
    return steps.where("before is not null").groupBy("before", F.col("category").alias("after")).agg(F.count("*").alias("n"))


def risk_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.badges(T.measure(event_steps(spark, sf_dir))).select(*KEYS, F.array_join("badges", ", ").alias("badges"))


def long_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one session, over many tasks: turns, the last and the next search, the category before, runs."""
    e = event_steps(spark, sf_dir).select(F.lit("all").alias("session_id"), "event_id", "category", "value")
    search = F.when(F.col("category") == "search", F.col("event_id"))
    out = scan(
        e, ("session_id",), ("event_id",),
        turn=Total((F.col("category") == "run_tests").cast("int")), last_search=Latest(search, before=True), next_search=Next(search, behind=True), was=lag(F.col("category")),
    )
    begins = F.coalesce(F.col("was")["v"] != F.col("category"), F.lit(True))
    longest = longest_run(out, begins, ("session_id",), ("event_id",))
    return out.join(F.broadcast(longest), "session_id").select("event_id", "turn", "last_search", "next_search", F.col("was")["v"].alias("was"), "longest")


def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last search's value at every step, and how the running total of values grew since the last purchase."""
    steps = event_steps(spark, sf_dir)
    filled = W.forward_fill(F.when(F.col("category") == "search", F.col("value")))
    cumulative = F.when(F.col("category") == "generate_fix", F.col("idx"))
    return steps.select("event_id", filled.alias("last_search_value"), W.deltas(cumulative).alias("growth"))


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length encoding: the first twelve runs of equal categories of each session."""
    steps = event_steps(spark, sf_dir)
    changed = F.coalesce(F.lag("category").over(W.in_order()) != F.col("category"), F.lit(True))
    steps = steps.withColumn("_new", changed).withColumn("run", W.islands(F.col("_new")))
    runs = steps.where("run <= 12").groupBy(*KEYS, "run").agg(F.first("category").alias("category"), F.count("*").alias("length"), F.min("idx").alias("first_idx"))
    return runs.withColumn("run", F.col("run").cast("long"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """35 days with events and a level from 0 to 4, days without events too."""
    steps = event_steps(spark, sf_dir)
    days = steps.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("failed")).alias("errors"))
    last = "2024-02-04"
    filled = W.fill_days(days, last, 35).fillna(0, ["n", "errors"])
    use = F.least(F.lit(1.0), F.col("n") / 400.0)
    return filled.select("day", "n", "errors", F.when(use <= 0, 0).when(use < 0.25, 1).when(use < 0.5, 2).when(use < 1, 3).otherwise(4).alias("level"))


QUERIES = {
    "signal_aggregates": signal_aggregates,
    "trajectory_shares": _measured(*COUNTS),
    "trajectory_action_counts": _measured(*CATEGORY_COUNTS),
    "trajectory_repetition": _measured(*REPEATS),
    "trajectory_ngrams_entropy": _measured(*GRAMS),
    "trajectory_validation": _measured(*VALIDATION),
    "trajectory_recovery": _measured(*RECOVERY),
    "transition_counts": next_actions,
    "risk_badges": risk_badges,
    "forward_fill_deltas": forward_fill,
    "long_session": long_session,
    "phase_runs": phases,
    "calendar_fill": calendar,
}

_W = "OVER (PARTITION BY host, session_id ORDER BY idx)"
_NEXT4 = "OVER (PARTITION BY host, session_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)"
_REST = "OVER (PARTITION BY host, session_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
_NOTES = f"""{STEPS_SQL},
a AS (SELECT *, lag(category) {_W} AS pc, lag(fp) {_W} AS pf, lag(category, 2) {_W} AS pc2, lag(fp, 2) {_W} AS pf2, lag(category, 3) {_W} AS pc3, lag(fp, 3) {_W} AS pf3,
        lead(category) {_W} AS c1, lead(category, 2) {_W} AS c2, lead(category, 3) {_W} AS c3, lead(fp) {_W} AS f1, lead(failed) {_W} AS x1, lead(failed, 3) {_W} AS x3,
        max(CASE WHEN category = 'run_tests' THEN 1 ELSE 0 END) {_NEXT4} AS soon, min(CASE WHEN category = 'run_tests' THEN idx END) {_REST} AS next_test FROM ev),
b AS (SELECT *, min(CASE WHEN pc IS NULL OR pc <> category OR pf <> fp THEN idx END) {_REST} AS next_other,
        sum(CASE WHEN pc IS NULL OR (pc <> category AND pf <> fp) THEN 1 ELSE 0 END) {_W} AS run FROM a)"""
_LIST = lambda cs: ", ".join(f"'{c}'" for c in cs)
_CNT = "SELECT host, session_id, count(*) AS n FROM ev GROUP BY host, session_id"
_ENTROPY = """ent AS (SELECT host, session_id, round_even(-sum(p * log2(p)), 4) AS sequence_entropy FROM (
   SELECT host, session_id, category, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY host, session_id) AS p FROM ev GROUP BY host, session_id, category) GROUP BY host, session_id)"""
_VALID = """SELECT host, session_id, coalesce(max(CASE WHEN category = 'run_tests' THEN idx END) > min(CASE WHEN category = 'generate_fix' THEN idx END), false) AS validation_presence,
  count(*) FILTER (WHERE category = 'generate_fix' AND coalesce(soon, 0) = 0) AS fix_without_validation_count,
  median(next_test - idx) FILTER (WHERE category = 'generate_fix') AS fix_validation_latency_steps,
  coalesce(max(CASE WHEN category = 'generate_fix' THEN idx END) > coalesce(max(CASE WHEN category = 'run_tests' THEN idx END), -1), false) AS premature_finish_without_validation,
  count(*) FILTER (WHERE category = 'generate_fix' AND c1 = 'run_tests' AND c2 = 'generate_fix' AND c3 = 'run_tests' AND (x1 OR x3)) AS test_fix_loop_count
FROM b GROUP BY host, session_id"""
_REPEAT = """SELECT host, session_id, count(*) - count(DISTINCT fp) AS action_redundancy,
  count(*) FILTER (WHERE category = pc OR fp = pf) AS consecutive_repetition_count, count(*) FILTER (WHERE category <> pc) AS phase_transition_count,
  count(*) FILTER (WHERE (category = pc AND fp = pf) OR (category = pc2 AND fp = pf2) OR (category = pc3 AND fp = pf3)) AS repeated_action_without_progress
FROM b GROUP BY host, session_id"""
_RUNS = "SELECT host, session_id, max(k) AS max_repetition_run FROM (SELECT host, session_id, run, count(*) AS k FROM b GROUP BY host, session_id, run) GROUP BY host, session_id"
_IGNORED = "count(*) FILTER (WHERE failed AND (f1 = fp OR c1 IN ('explain', 'other')))"

ORACLE_SQL = {
    "signal_aggregates": f"""WITH {STEPS_SQL}, {_ENTROPY},
m AS (SELECT host, session_id, count(*) AS step_count, {", ".join(f"count(*) FILTER (WHERE category = '{c}') AS action_count_{c}" for c in T.CATEGORIES)},
  count(*) FILTER (WHERE category <> pc) AS phase_transition_count FROM (SELECT *, lag(category) {_W} AS pc FROM ev) GROUP BY host, session_id),
r AS ({" UNION ALL ".join(f"SELECT 'trajectory_{c}' AS signal, CAST({c} AS DOUBLE) AS value FROM m JOIN ent USING (host, session_id)" for c in ["step_count", *(f"action_count_{c}" for c in T.CATEGORIES), "phase_transition_count", "sequence_entropy"])})
SELECT signal, count(value) AS present, count(*) - count(value) AS missing, min(value) AS min, max(value) AS max, round_even(avg(value), 3) AS mean,
  median(value) AS median, round_even(quantile_cont(value, 0.9), 3) AS p90, round_even(sum(value), 3) AS total FROM r GROUP BY signal""",
    "trajectory_shares": f"""WITH {STEPS_SQL} SELECT host, session_id, count(*) AS step_count,
  round_even(count(*) FILTER (WHERE category IN ('other', 'error')) / CAST(count(*) AS DOUBLE), 4) AS unknown_action_ratio,
  count(DISTINCT category) FILTER (WHERE category IN ({_LIST(T.CORE)})) / 8.0 AS phase_coverage,
  round_even(avg(CAST(category IN ({_LIST(T.EXPLORING)}) AS INTEGER)), 4) AS exploration_ratio,
  round_even(avg(CAST(category IN ({_LIST(T.EXPLOITING)}) AS INTEGER)), 4) AS exploitation_ratio,
  round_even(1 - abs(avg(CAST(category IN ({_LIST(T.EXPLORING)}) AS INTEGER)) - avg(CAST(category IN ({_LIST(T.EXPLOITING)}) AS INTEGER))), 4) AS balance_score
FROM ev GROUP BY host, session_id""",
    "trajectory_action_counts": f"""WITH {STEPS_SQL} SELECT host, session_id, {", ".join(f"count(*) FILTER (WHERE category = '{c}') AS action_count_{c}" for c in T.CATEGORIES)},
  {", ".join(f"round_even(count(*) FILTER (WHERE category = '{c}') / CAST(count(*) AS DOUBLE), 4) AS action_ratio_{c}" for c in T.CATEGORIES)} FROM ev GROUP BY host, session_id""",
    "trajectory_repetition": f"WITH {_NOTES} SELECT * FROM ({_REPEAT}) JOIN ({_RUNS}) USING (host, session_id)",
    "trajectory_ngrams_entropy": f"""WITH {_NOTES}, {_ENTROPY},
g AS (SELECT host, session_id, gram, count(*) AS k, min(idx) AS first FROM (SELECT *, category || ' -> ' || c1 || ' -> ' || c2 || ' -> ' || c3 AS gram FROM b WHERE c3 IS NOT NULL) GROUP BY host, session_id, gram),
t AS (SELECT host, session_id, gram AS gram4_top FROM (SELECT *, row_number() OVER (PARTITION BY host, session_id ORDER BY k DESC, first) AS r FROM g) WHERE r = 1),
s AS (SELECT host, session_id, round_even(sum(CASE WHEN k > 1 THEN k ELSE 0 END) / CAST(sum(k) AS DOUBLE), 4) AS gram4_repetition_ratio FROM g GROUP BY host, session_id)
SELECT host, session_id, coalesce(gram4_repetition_ratio, 0.0) AS gram4_repetition_ratio, gram4_top, sequence_entropy
FROM ent LEFT JOIN s USING (host, session_id) LEFT JOIN t USING (host, session_id)""",
    "trajectory_validation": f"WITH {_NOTES} {_VALID}",
    "trajectory_recovery": f"""WITH {_NOTES} SELECT host, session_id, median(next_other - idx) FILTER (WHERE failed) AS failed_result_recovery_steps, {_IGNORED} AS failure_ignored_count,
  round_even(count(*) FILTER (WHERE failed AND c1 IN ({_LIST(T.RECOVERING)})) / nullif(CAST(count(*) FILTER (WHERE failed AND c1 IS NOT NULL) AS DOUBLE), 0), 4) AS error_to_search_or_edit_ratio
FROM b GROUP BY host, session_id""",
    "transition_counts": f"WITH {STEPS_SQL} SELECT before, after, count(*) AS n FROM (SELECT category AS after, lag(category) {_W} AS before FROM ev) WHERE before IS NOT NULL GROUP BY before, after",
    "risk_badges": f"""WITH {_NOTES} SELECT host, session_id, concat_ws(', ', CASE WHEN premature_finish_without_validation THEN 'unvalidated' END,
  CASE WHEN repeated_action_without_progress > 0 THEN 'repeat' END, CASE WHEN fix_without_validation_count > 0 THEN fix_without_validation_count || ' fix/no-test' END,
  CASE WHEN ign > 0 THEN ign || ' ignored-failure' END) AS badges
FROM ({_VALID}) JOIN (SELECT host, session_id, {_IGNORED} AS ign FROM b GROUP BY host, session_id) USING (host, session_id) JOIN ({_REPEAT}) USING (host, session_id)""",
    "long_session": f"""WITH {STEPS_SQL}, w AS (SELECT event_id, category, CAST(sum(CASE WHEN category = 'run_tests' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS turn, lag(category) OVER (ORDER BY event_id) AS was,
  last_value(CASE WHEN category = 'search' THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_search,
  first_value(CASE WHEN category = 'search' THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_search FROM ev),
r AS (SELECT *, sum(CASE WHEN was IS DISTINCT FROM category THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS run FROM w)
SELECT event_id, turn, last_search, next_search, was, (SELECT max(n) FROM (SELECT count(*) AS n FROM r GROUP BY run)) AS longest FROM r""",
    "forward_fill_deltas": f"""WITH {STEPS_SQL}, f AS (SELECT *, CASE WHEN category = 'generate_fix' THEN idx END AS c FROM ev)
SELECT event_id, last_value(CASE WHEN category = 'search' THEN value END IGNORE NULLS) OVER (PARTITION BY host, session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_search_value,
  greatest(0, CASE WHEN c IS NULL THEN 0 ELSE c - coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY host, session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END) AS growth FROM f""",
    "phase_runs": f"""WITH {STEPS_SQL}, r AS (SELECT *, sum(new) {_W} AS run FROM (SELECT *, CASE WHEN lag(category) {_W} IS DISTINCT FROM category THEN 1 ELSE 0 END AS new FROM ev))
SELECT host, session_id, CAST(run AS BIGINT) AS run, min(category) AS category, count(*) AS length, min(idx) AS first_idx FROM r WHERE run <= 12 GROUP BY host, session_id, run""",
    "calendar_fill": f"""WITH {STEPS_SQL}, d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE failed) AS errors FROM ev GROUP BY 1),
c AS (SELECT strftime(CAST('2024-02-04' AS DATE) - CAST(i AS INTEGER), '%Y-%m-%d') AS day FROM range(35) AS t(i))
SELECT day, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors, CASE WHEN coalesce(n, 0) <= 0 THEN 0 WHEN least(1.0, n / 400.0) < 0.25 THEN 1 WHEN least(1.0, n / 400.0) < 0.5 THEN 2 WHEN least(1.0, n / 400.0) < 1 THEN 3 ELSE 4 END AS level
FROM c LEFT JOIN d USING (day)""",
}
