"""Queries over messages, memories and event joins, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..operators import joins as J
from ..operators import memory as M
from ..operators import search as S
from ..operators import windows as W
from ..operators.walks import walk
from ..sources import transcripts
from ..sources.folders import new_folder
from ..sources.memory_store import MemoryStore
from ..sources.views import MEMORIES_SQL, MESSAGES_SQL, STEPS_SQL, event_steps, memories, messages, table


def message_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates of every message."""
    t = F.col("text")
    return messages(spark, sf_dir).select(
        "session_id", "ord", "actor", P.correction(t).alias("correction"), P.satisfaction(t).alias("satisfaction"), P.rate_limited(t).alias("rate_limited"),
        P.failed_text(t).alias("failed"), P.looks_like_path(t).alias("is_path"), X.truncate(t, 80, flatten=True).alias("short"),
    )


def message_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each conversation, and how its last user message sounds."""
    m = messages(spark, sf_dir)
    user = F.col("actor") == "user"
    last = F.max_by(F.when(user, F.col("text")), F.when(user, F.col("ord")))
    return m.groupBy("session_id").agg(
        F.count_if(user).alias("user_messages"), F.count_if(F.col("actor") == "assistant").alias("assistant_messages"),
        F.count_if(user & P.correction(F.col("text"))).alias("corrections"), P.satisfaction(last).alias("satisfaction"),
        F.sum(F.length("text")).alias("chars"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by turn: each user message opens one."""
    m = messages(spark, sf_dir).withColumn("turn", W.turns(F.col("actor") == "user", "ord", ("session_id",)))
    return m.groupBy("session_id", "turn").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.sum(F.length("text")).alias("chars"))


def neighbour_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of the words of each message and the one before."""
    m = messages(spark, sf_dir).withColumn("words", X.word_set(F.col("text")))
    before = F.lag("words").over(W.in_order("ord", ("session_id",)))
    return m.select("session_id", "ord", X.jaccard(F.col("words"), before).alias("jaccard"), before.isNotNull().alias("has")).where("has").select("session_id", "ord", F.round("jaccard", 9).alias("jaccard"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    redacted = P.redact(F.col("text"))
    return d.select("doc_id", P.secret_count(F.col("text")).cast("long").alias("secrets"), F.length(redacted).alias("redacted_chars")).where("secrets > 0")


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.canonical(memories(spark, sf_dir)).select("id", "canonical_id", "content_hash")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _links(m: DataFrame) -> DataFrame:
    return m.select(F.col("id").alias("src"), F.expr("id div 2").alias("dst"))


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best memories for each benchmark text, all its words as terms."""
    m = memories(spark, sf_dir)
    scored = M.bm25(M.query_terms(_queries(spark, sf_dir)), m)
    return W.top_k(scored, ["qid"], [F.round("score", 9).desc(), F.col("id")], 20).select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _phrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as queries: each one's words, the second and third as a phrase, the first twice."""
    words = X.search_tokens(F.col("text"))
    word = lambda i: F.get(words, F.lit(i))
    phrase = F.concat(word(1), F.lit("-"), word(2))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat_ws(" ", word(0), word(0), phrase, F.slice(words, 4, 1000)).alias("query"))


def _index(spark: SparkSession, m: DataFrame) -> DataFrame:
    path = new_folder(spark, "index")
    S.index_memories(m.select("id", "text"), path)
    return S.read_index(spark, path)


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best memories for each query with a phrase, by the stored positional index."""
    found = S.best(S.query_units(_phrased(spark, sf_dir)), _index(spark, memories(spark, sf_dir)), 20)
    return found.select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    ranked = M.retrieve(_phrased(spark, sf_dir), m, _links(m), _index(spark, m), limit=10, cwd="src3")
    return ranked.select("qid", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


def memory_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with their utility, links and evidence after three appends of documents and of rewards."""
    m = memories(spark, sf_dir).where("text is not null")
    id_, ref = (F.col("id") % 1000).cast("string"), F.concat(F.lit("e"), F.col("id") % 7)
    text = F.concat("text", F.lit(" [["), (F.col("id") % 50).cast("string"), F.lit("]]"))
    records = m.select(id_.alias("id"), F.col("id").alias("ord"), "kind", "scope", "status", text.alias("text"), "origin_repo", "q_value", (F.lit(10_000_000) - F.col("id")).alias("created_at"), F.array(ref, F.lit("x")).alias("evidence"))
    paid = F.when(F.col("event_type") == "purchase", "memory_rewarded").otherwise("memory_used")
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 1000).cast("string").alias("memory_id"), F.col("event_id").alias("line"), paid.alias("event"), (F.col("event_id") % 13 / 10.0).alias("reward"))
    store = MemoryStore(spark, new_folder(spark, "store"))
    for batch in range(3):
        store.append(records.where(F.col("ord") % 3 == batch), events.where(F.col("line") % 3 == batch))
    links = store.links().groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("link"), F.count("*").alias("links"))
    proof = store.evidence().groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("refs"))
    words = store.index().where("term <> ''").groupBy("id").agg(F.sum(F.size("positions")).alias("words"))
    out = store.memory().join(links, "id", "left").join(proof, "id", "left").join(words, "id", "left")
    return out.select("id", "content_hash", "created_at", "evidence_count", F.round("q_value", 6).alias("q_value"), "hits", "successes", "failures", "link", "links", "refs", "words")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as events whose payloads are nested, some deeper than is read."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 13).cast("int").alias("k"))
    text = F.col("doc_id").cast("string")
    inner = F.concat(F.lit('{"n":'), text, F.lit(',"f":['), F.when(F.col("k") % 2 == 0, "true").otherwise("null"), F.lit(',"s'), text, F.lit('",1.5,{}]}'))
    return d.select("doc_id", F.when(F.col("k") == 12, "no JSON").otherwise(F.concat(F.repeat(F.lit('{"a":['), F.col("k")), inner, F.repeat(F.lit("]}"), F.col("k")))).alias("payload"))


def payload_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value and key of nested payloads."""
    rows = walk(_nested(spark, sf_dir), ("doc_id",))
    return rows.select("doc_id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "depth", "key", "kind", "value")


def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines, some blank or bad, and read with the numbers of their lines."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    good = F.to_json(F.struct("conv_id", "turn", F.col("text").alias("said")))
    line = F.when(F.col("turn") % 5 == 1, "").when(F.col("turn") % 7 == 2, F.concat(F.lit("{bad "), F.substring(good, 1, 9))).otherwise(F.concat(good, F.when(F.col("turn") % 2 == 0, "\r").otherwise("")))
    folder = new_folder(spark, "lines")
    rows = c.select((F.col("conv_id") % 7).alias("file"), "conv_id", "turn", "role", "text", line.alias("value")).repartition("file").sortWithinPartitions("file", "conv_id", "turn", "role", "text")
    rows.select("file", "value").write.option("lineSep", "\n").partitionBy("file").text(folder)
    found = transcripts.read_lines(spark, folder)
    number = lambda name: F.get_json_object("raw", f"$.{name}").cast("long")
    return found.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("long").alias("file"), "line", number("conv_id").alias("conv_id"), number("turn").alias("turn"), F.length(F.get_json_object("raw", "$.said")).alias("chars"))


def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    links = m.select(F.col("id").alias("src"), (F.col("id") * 2).alias("dst"))
    return M.dangling(links, m).select("src", "dst")


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utility of each user after all events, a purchase being a reward of 1."""
    e = event_steps(spark, sf_dir)
    rows = e.select(F.col("session_id").alias("memory_id"), F.col("idx").alias("line"), (F.col("category") == "generate_fix").cast("double").alias("reward"))
    start = e.select(F.col("session_id").alias("id"), F.lit(0.5).alias("q_value")).distinct()
    return M.fold_rewards(start, rows).withColumn("q_value", F.round("q_value", 9))


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    return m.groupingSets([[F.col("kind")], [F.col("scope")], [F.col("status")]], "kind", "scope", "status").agg(F.count("*").alias("n"), F.max("q_value").alias("best_q"))


def top_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    return m.orderBy(F.col("q_value").desc(), F.col("hits").desc(), F.col("priority").desc(), F.col("id")).limit(10).select("id", "q_value", "hits", "priority")


def kept_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as candidates, after the filter by risk, confidence and likeness."""
    m = messages(spark, sf_dir)
    n = F.length("text")
    c = m.select("session_id", F.col("ord").alias("id"), F.col("actor").alias("kind"), "text", F.when(n % 7 == 0, "high").otherwise("low").alias("risk"), (n % 10 / 10).alias("confidence"), (n % 5 + 1).alias("priority"))
    return M.near_duplicates(c)


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = event_steps(spark, sf_dir).withColumn("k", F.substring_index("fp", ":", -1).cast("long")).withColumnRenamed("idx", "ord")
    call_id = F.when(F.col("k") % 3 == 0, F.col("k"))
    calls = e.where("category in ('search', 'generate_fix')").select("host", "session_id", "ord", "event_id", call_id.alias("call_id"))
    parent = F.when(F.col("k") % 3 == 1, F.col("event_id") - F.col("k"))
    results = e.where("category in ('explore', 'error')").select("host", "session_id", "ord", call_id.alias("call_id"), parent.alias("parent_event_id"))
    return calls, results


def call_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = _calls(spark, sf_dir)
    return J.match_results(calls, results).select("event_id", "result_ord", "tier")


def latest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view with the latest earlier click of the session on the same thing."""
    e = event_steps(spark, sf_dir).where("category in ('search', 'explore')").withColumn("k", F.substring_index("fp", ":", -1)).withColumnRenamed("idx", "ord")
    rows = e.withColumn("is_search", F.col("category") == "search")
    return J.latest_before(rows, "is_search", "k", "event_id").select("event_id", "latest_event_id")


def within_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups of a host that fall into each session's first two hours."""
    e = event_steps(spark, sf_dir)
    spans = e.groupBy("host", "session_id").agg(F.min("ts").alias("start")).withColumn("end", F.col("start") + F.expr("interval 2 hours"))
    points = e.where("category = 'run_tests'").select("host", "ts", "event_id")
    return J.within(points, spans, "host").groupBy("host", "session_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


QUERIES = {
    "message_flags": message_flags,
    "message_signals": message_signals,
    "turn_segments": turns,
    "neighbour_jaccard": neighbour_jaccard,
    "secret_scan": secrets,
    "content_hashes": content_hashes,
    "bm25_recall": bm25,
    "phrase_search": phrase_search,
    "memory_retrieval": retrieval,
    "memory_store": memory_store,
    "payload_walk": payload_walk,
    "line_scan": line_scan,
    "dangling_links": dangling,
    "reward_fold": rewards,
    "memory_index_summary": index_summary,
    "memory_top_utility": top_utility,
    "kept_candidates": kept_candidates,
    "call_result_join": call_results,
    "latest_before_join": latest_search,
    "interval_join": within_session,
}

_q = lambda s: s.replace("'", "''")
_CORRECTION = _q("(?i)" + "|".join(f"(?:{p})" for p in P.CORRECTION_PATTERNS))
_PLAIN = r"regexp_replace(text, '[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]', 'z', 'g')"
_POS, _NEG = (f"regexp_matches(COL, '(?i){_q(p)}')" for p in (P.POSITIVE, P.NEGATIVE))
_SAT = f"CASE WHEN COL IS NULL THEN NULL WHEN {_POS} AND NOT {_NEG} THEN 'positive' WHEN {_NEG} AND NOT {_POS} THEN 'negative' ELSE 'neutral' END"
_ANY = lambda t, needles: "(" + " OR ".join(f"contains({t}, '{_q(n)}')" for n in needles) + ")"
_TRIM = "replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ')"
_TOKENS = lambda c: f"list_filter(regexp_split_to_array(translate(lower({c}), '{X.ACCENTS[0]}', '{X.ACCENTS[1]}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_BM25 = f"""words AS (SELECT id, {_TOKENS("text")} AS ws FROM mem),
terms AS (SELECT DISTINCT item_id AS qid, unnest({_TOKENS("text")}) AS term FROM benchmark),
tf AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), c AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM words),
bm AS (SELECT qid, id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
  FROM terms JOIN tf USING (term) JOIN df USING (term), c GROUP BY qid, id)"""
_PHRASED = f"""words AS (SELECT id, {_TOKENS("text")} AS ws FROM mem), q AS (SELECT item_id AS qid, {_TOKENS("text")} AS w FROM benchmark),
units AS (SELECT qid, u.one, u.two, count(*) AS times FROM (SELECT qid, unnest([{{'one': w[1], 'two': NULL}}, {{'one': w[1], 'two': NULL}}, {{'one': w[2], 'two': w[3]}}] || list_transform(w[4:1003], lambda x: {{'one': x, 'two': NULL}})) AS u FROM q) GROUP BY ALL),
places AS (SELECT id, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM words),
tf AS (SELECT one, NULL AS two, id, count(*) AS tf FROM places JOIN (SELECT DISTINCT one FROM units WHERE two IS NULL) ON one = term GROUP BY one, id
  UNION ALL SELECT one, two, x.id, count(*) FROM places x JOIN (SELECT DISTINCT one, two FROM units WHERE two IS NOT NULL) ON one = x.term JOIN places y ON y.id = x.id AND y.pos = x.pos + 1 AND y.term = two GROUP BY one, two, x.id),
df AS (SELECT one, two, count(*) AS df FROM tf GROUP BY one, two), c AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM words),
bm AS (SELECT qid, tf.id, sum(times * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))) AS score
  FROM units u JOIN tf ON tf.one = u.one AND tf.two IS NOT DISTINCT FROM u.two JOIN df ON df.one = u.one AND df.two IS NOT DISTINCT FROM u.two JOIN words w ON w.id = tf.id, c GROUP BY qid, tf.id)"""
_SECRETS = " + ".join(f"len(regexp_extract_all(text, '{_q(p)}'))" for p in P.SECRET_PATTERNS.values())


def _redacted() -> str:
    sql = "text"
    for p in P.SECRET_PATTERNS.values():
        sql = f"regexp_replace({sql}, '{_q(p)}', '[REDACTED]', 'g')"
    return sql


ORACLE_SQL = {
    "message_flags": f"""WITH {MESSAGES_SQL} SELECT session_id, ord, actor, regexp_matches({_PLAIN}, '{_CORRECTION}') AS correction, {_SAT.replace("COL", "text")} AS satisfaction,
  {_ANY("lower(text)", P.RATE_LIMIT_PHRASES)} AS rate_limited, (contains(lower(text), 'process exited with code ') AND NOT regexp_matches(lower(text), 'process exited with code 0\\b')) OR {_ANY("lower(text)", P.FAILURE_NEEDLES)} AS failed,
  starts_with(text, '/') AND length(text) < 300 AND NOT contains(text, chr(10)) AS is_path, CASE WHEN length({_TRIM}) > 80 THEN substr({_TRIM}, 1, 79) || '…' ELSE {_TRIM} END AS short FROM conv""",
    "message_signals": f"""WITH {MESSAGES_SQL}, g AS (SELECT session_id, count(*) FILTER (WHERE actor = 'user') AS user_messages, count(*) FILTER (WHERE actor = 'assistant') AS assistant_messages,
  count(*) FILTER (WHERE actor = 'user' AND regexp_matches({_PLAIN}, '{_CORRECTION}')) AS corrections, max_by(text, ord) FILTER (WHERE actor = 'user') AS last, CAST(sum(length(text)) AS BIGINT) AS chars FROM conv GROUP BY session_id)
SELECT session_id, user_messages, assistant_messages, corrections, {_SAT.replace("COL", "last")} AS satisfaction, chars FROM g""",
    "turn_segments": f"WITH {MESSAGES_SQL}, t AS (SELECT *, CAST(sum(CASE WHEN actor = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM conv) SELECT session_id, turn, count(*) AS n, min(ord) AS first, CAST(sum(length(text)) AS BIGINT) AS chars FROM t GROUP BY session_id, turn",
    "neighbour_jaccard": f"""WITH {MESSAGES_SQL}, w AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '([a-z][a-z0-9_]+)', 1)) AS a FROM conv), p AS (SELECT *, lag(a) OVER (PARTITION BY session_id ORDER BY ord) AS b FROM w)
SELECT session_id, ord, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) END, 9) AS jaccard FROM p WHERE b IS NOT NULL""",
    "secret_scan": f"SELECT doc_id, CAST({_SECRETS} AS BIGINT) AS secrets, length({_redacted()}) AS redacted_chars FROM documents WHERE {_SECRETS} > 0",
    "content_hashes": f"""WITH {MEMORIES_SQL}, h AS (SELECT id, sha256(scope || chr(0) || kind || chr(0) || CASE WHEN scope = 'repo' THEN coalesce(origin_repo, 'None') ELSE '' END || chr(0) || regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS content_hash FROM mem)
SELECT id, min(id) OVER (PARTITION BY content_hash) AS canonical_id, content_hash FROM h""",
    "bm25_recall": f"WITH {MEMORIES_SQL}, {_BM25} SELECT qid, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM bm) WHERE rank <= 20",
    "phrase_search": f"WITH {MEMORIES_SQL}, {_PHRASED} SELECT qid, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM bm) WHERE rank <= 20",
    "memory_retrieval": f"""WITH {MEMORIES_SQL}, {_PHRASED},
r AS (SELECT qid, id, 1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)) AS fused, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank
  FROM bm JOIN mem USING (id) WHERE scope IN ('global', 'user', 'task') OR (scope = 'repo' AND origin_repo = 'src3')),
f AS (SELECT qid, id, CAST(fused AS DOUBLE) AS fused FROM r WHERE rank <= 40),
l AS (SELECT id AS src, id // 2 AS dst FROM mem),
n AS (SELECT qid, dst AS id FROM f JOIN l ON f.id = l.src UNION SELECT qid, src FROM f JOIN l ON f.id = l.dst),
x AS (SELECT n.qid, n.id FROM n JOIN mem USING (id) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.qid = n.qid AND f.id = n.id)),
a AS (SELECT qid, id, fused FROM f UNION ALL SELECT x.qid, x.id, CAST(1.0 / (60 + c.n0 + row_number() OVER (PARTITION BY x.qid ORDER BY x.id)) AS DOUBLE) FROM x JOIN (SELECT qid, count(*) AS n0 FROM f GROUP BY qid) c ON c.qid = x.qid),
s AS (SELECT qid, id, 0.45 * (fused / max(fused) OVER (PARTITION BY qid)) AS rec FROM a),
t AS (SELECT qid, id, rec + 0.35 * q_value + 0.10 * quality_avg + 0.05 * coalesce(1.0 / (1.0 + age_days), 0.0)
  + 0.05 * CASE WHEN scope IN ('global', 'user') OR (scope = 'repo' AND origin_repo = 'src3') THEN 1.0 WHEN scope = 'task' THEN 0.8 ELSE 0.4 END - CASE risk WHEN 'low' THEN 0.0 WHEN 'high' THEN 0.2 ELSE 0.05 END AS score FROM s JOIN mem USING (id) WHERE status = 'accepted')
SELECT qid, rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM t) WHERE rank <= 10""",
    "memory_store": f"""WITH {MEMORIES_SQL}, r AS (SELECT id % 1000 AS raw, (id % 3) * 1000000000 + id AS seq, q_value, 10000000 - id AS created_at, 'e' || (id % 7) AS ref, CAST(id % 50 AS VARCHAR) AS link, len({_TOKENS("text || ' [[' || (id % 50) || ']]'")}) AS words,
    sha256(scope || chr(0) || kind || chr(0) || CASE WHEN scope = 'repo' THEN coalesce(origin_repo, 'None') ELSE '' END || chr(0) || regexp_replace(regexp_replace(lower(text || ' [[' || (id % 50) || ']]'), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS content_hash FROM mem WHERE text IS NOT NULL),
p AS (SELECT r.*, CAST(o.raw AS VARCHAR) AS id FROM r JOIN (SELECT content_hash, min_by(raw, seq) AS raw FROM r GROUP BY content_hash) o USING (content_hash)),
m AS (SELECT id, max_by(content_hash, seq) AS content_hash, min(created_at) AS created_at, 2 * count(*) AS evidence_count, max_by(q_value, seq) AS q, max_by(link, seq) AS link, max_by(words, seq) AS words, count(DISTINCT ref) + 1 AS refs FROM p GROUP BY id),
w AS (SELECT CAST(user_id % 1000 AS VARCHAR) AS id, list(least(1.0, event_id % 13 / 10.0)::DOUBLE ORDER BY event_id % 3, event_id) AS rewards, count(*) FILTER (WHERE event_id % 13 >= 5) AS good FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT id, content_hash, created_at, evidence_count, round(list_reduce(list_prepend(CAST(q AS DOUBLE), coalesce(rewards, CAST([] AS DOUBLE[]))), lambda a, r: a + 0.2 * (r - a)), 6) AS q_value, coalesce(len(rewards), 0) AS hits, coalesce(good, 0) AS successes, coalesce(len(rewards), 0) - coalesce(good, 0) AS failures,
  link, CAST(1 AS BIGINT) AS links, refs, CAST(words AS BIGINT) AS words FROM m LEFT JOIN w USING (id)""",
    "payload_walk": """WITH RECURSIVE d AS (SELECT doc_id, CAST(doc_id % 13 AS INTEGER) AS k FROM documents),
e AS (SELECT doc_id, CAST(repeat('{"a":[', k) || '{"n":' || doc_id || ',"f":[' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'null' END || ',"s' || doc_id || '",1.5,{}]}' || repeat(']}', k) AS JSON) AS j FROM d WHERE k <> 12),
w AS (SELECT doc_id, '' AS path, 0 AS depth, CAST(NULL AS VARCHAR) AS key, j FROM e
  UNION ALL SELECT w.doc_id, w.path || CASE WHEN w.depth = 0 THEN '' ELSE '.' END || (CASE json_type(w.j) WHEN 'OBJECT' THEN list_position(list_sort(json_keys(w.j)), c.key) - 1 ELSE CAST(c.key AS INTEGER) END), w.depth + 1, CASE json_type(w.j) WHEN 'OBJECT' THEN c.key END, c.value
    FROM w, LATERAL (SELECT t.key, t.value FROM json_each(w.j) t) c WHERE w.depth <= 8 AND json_type(w.j) IN ('OBJECT', 'ARRAY'))
SELECT doc_id, path, depth, key, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
  CASE WHEN depth <= 8 AND json_type(j) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN j ->> '$' END AS value FROM w""",
    "line_scan": """SELECT conv_id % 7 AS file, line, conv_id, turn, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id, turn, role, text) AS line FROM conversations) WHERE turn % 5 <> 1 AND turn % 7 <> 2""",
    "dangling_links": f"WITH {MEMORIES_SQL} SELECT m.id AS src, m.id * 2 AS dst FROM mem m WHERE NOT EXISTS (SELECT 1 FROM mem x WHERE x.id = m.id * 2)",
    "reward_fold": f"""WITH {STEPS_SQL}, r AS (SELECT session_id AS id, list_reduce(list_prepend(CAST(0.5 AS DOUBLE), list(CASE WHEN category = 'generate_fix' THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY idx)), lambda q, r: q + 0.2 * (r - q)) AS q,
  count(*) AS hits, count(*) FILTER (WHERE category = 'generate_fix') AS good FROM ev GROUP BY session_id) SELECT id, round(q, 9) AS q_value, hits, good AS successes, hits - good AS failures FROM r""",
    "memory_index_summary": f"WITH {MEMORIES_SQL} SELECT kind, scope, status, count(*) AS n, max(q_value) AS best_q FROM mem GROUP BY GROUPING SETS ((kind), (scope), (status))",
    "memory_top_utility": f"WITH {MEMORIES_SQL} SELECT id, q_value, hits, priority FROM mem ORDER BY q_value DESC, hits DESC, priority DESC, id LIMIT 10",
    "call_result_join": f"""WITH {STEPS_SQL}, e AS (SELECT *, CAST(split_part(fp, ':', 2) AS BIGINT) AS k FROM ev),
c AS (SELECT host, session_id, idx AS ord, event_id, CASE WHEN k % 3 = 0 THEN k END AS call_id FROM e WHERE category IN ('search', 'generate_fix')),
r AS (SELECT host, session_id, idx AS ord, CASE WHEN k % 3 = 0 THEN k END AS call_id, CASE WHEN k % 3 = 1 THEN event_id - k END AS parent FROM e WHERE category IN ('explore', 'error')),
m AS (SELECT c.*, (SELECT max(ord) FROM r WHERE r.session_id = c.session_id AND r.call_id = c.call_id) AS a, (SELECT max(ord) FROM r WHERE r.session_id = c.session_id AND r.parent = c.event_id) AS b FROM c),
t AS (SELECT *, CASE WHEN coalesce(a, b) IS NULL THEN row_number() OVER (PARTITION BY session_id, coalesce(a, b) IS NULL ORDER BY ord) END AS turn FROM m),
f AS (SELECT session_id, ord AS free, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS turn FROM r WHERE call_id IS NULL AND parent IS NULL)
SELECT event_id, coalesce(a, b, free) AS result_ord, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN free IS NOT NULL THEN 3 END AS tier FROM t LEFT JOIN f USING (session_id, turn)""",
    "latest_before_join": f"""WITH {STEPS_SQL} SELECT event_id, latest_event_id FROM (SELECT event_id, category, last_value(CASE WHEN category = 'search' THEN event_id END IGNORE NULLS) OVER (PARTITION BY host, session_id, split_part(fp, ':', 2) ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest_event_id
FROM ev WHERE category IN ('search', 'explore')) WHERE category = 'explore'""",
    "interval_join": f"WITH {STEPS_SQL}, s AS (SELECT host, session_id, min(ts) AS a, min(ts) + INTERVAL 2 HOURS AS b FROM ev GROUP BY host, session_id) SELECT s.host, s.session_id, count(*) AS n, min(event_id) AS first_event FROM s JOIN ev e ON e.host = s.host AND e.category = 'run_tests' AND e.ts BETWEEN a AND b GROUP BY s.host, s.session_id",
    "kept_candidates": f"""WITH RECURSIVE {MESSAGES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY priority DESC, confidence DESC, kind, id) AS n
  FROM (SELECT session_id, ord AS id, actor AS kind, list_distinct(regexp_extract_all(lower(text), '([a-z][a-z0-9_]+)', 1)) AS words, length(text) % 7 = 0 AS high, length(text) % 10 / 10.0 AS confidence, length(text) % 5 + 1 AS priority FROM conv) WHERE NOT high AND confidence >= 0.4),
k AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(kind VARCHAR, id BIGINT, words VARCHAR[])[]) AS kept FROM o
  UNION ALL SELECT k.session_id, o.n, CASE WHEN len(kept) >= 8 OR len(list_filter(kept, lambda x: x.kind = o.kind AND len(x.words) > 0 AND len(o.words) > 0
      AND len(list_intersect(x.words, o.words)) / CAST(len(x.words) + len(o.words) - len(list_intersect(x.words, o.words)) AS DOUBLE) >= 0.75)) > 0 THEN kept
    ELSE list_append(kept, {{'kind': o.kind, 'id': CAST(o.id AS BIGINT), 'words': o.words}}) END FROM k JOIN o ON o.session_id = k.session_id AND o.n = k.n + 1),
l AS (SELECT session_id, max_by(kept, n) AS kept FROM k GROUP BY session_id)
SELECT session_id, CAST(r AS INTEGER) AS rank, kept[r].id AS id FROM (SELECT session_id, kept, unnest(generate_series(1, len(kept))) AS r FROM l)""",
}
