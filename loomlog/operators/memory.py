"""A table of memories: identity, rewards, full-text recall, link expansion and reranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from .windows import top_k

#: BM25's parameters, the least weight of a term, and the constant of rank fusion.
K1, B, LEAST_IDF, RRF_K = 1.2, 0.75, 1e-6, 60
RISK_PENALTY = {"low": 0.0, "medium": 0.05, "high": 0.2}


def canonical(memories: DataFrame, order: str = "id") -> DataFrame:
    """id and the first id (by ``order``) with the same content."""
    origin = F.col("origin_repo") if "origin_repo" in memories.columns else F.lit(None).cast("string")
    hashed = memories.select("id", F.col(order).alias("_order"), X.content_hash(F.col("text"), F.col("scope"), F.col("kind"), origin).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min_by("id", "_order").alias("canonical_id"))
    return hashed.join(first, "content_hash").select("id", "content_hash", "canonical_id")


def normalise(records: DataFrame) -> DataFrame:
    """Records with the defaults of what is missing, empty or 0, their status checked, an id made of the text."""
    kinds = dict(records.dtypes)
    of = lambda c, t: F.col(c).cast(t) if c in kinds else F.lit(None).cast(t)
    text = F.coalesce(of("text", "string"), F.lit(""))
    word = lambda c, default: F.coalesce(F.nullif(of(c, "string"), F.lit("")), F.lit(default))
    number = lambda c, t, default: F.coalesce(F.nullif(of(c, t), F.lit(0).cast(t)), F.lit(default).cast(t))
    return records.select(
        F.coalesce(F.nullif(of("id", "string"), F.lit("")), X.slug(text)).alias("id"),
        word("kind", "case").alias("kind"), word("scope", "repo").alias("scope"), P.safe_status(word("status", "candidate"), text).alias("status"),
        text.alias("text"), word("when_to_use", "").alias("when_to_use"), F.nullif(of("origin_repo", "string"), F.lit("")).alias("origin_repo"),
        number("confidence", "double", 0.5).alias("confidence"), number("priority", "int", 3).alias("priority"), word("risk", "medium").alias("risk"),
        number("q_value", "double", 0.5).alias("q_value"), number("quality_avg", "double", 0.0).alias("quality_avg"),
        *[number(c, "int", 0).alias(c) for c in ("hits", "successes", "failures")],
    )


def fold_rewards(memories: DataFrame, rewards: DataFrame, rate: float = 0.2) -> DataFrame:
    """id, q_value, hits, successes, failures after the rewards (memory_id, line, reward), taken in order.

    q moves by ``rate`` times its distance to each reward, which is a weighted
    sum: later rewards weigh more.  So it needs each reward's place from the end
    and sums only, and a memory with any number of rewards is no long list.
    """
    place = F.row_number().over(Window.partitionBy("memory_id").orderBy(F.col("line").desc())) - 1
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("reward")))
    placed = rewards.where("reward is not null").withColumn("_r", r).withColumn("_w", F.pow(F.lit(1 - rate), place) * rate)
    sums = placed.groupBy(F.col("memory_id").alias("id")).agg(F.sum(F.col("_r") * F.col("_w")).alias("_gain"), F.count("*").alias("_n"), F.count_if(F.col("_r") >= 0.5).alias("_good"))
    df = memories.join(sums, "id", "left").fillna(0, ["_n", "_good"]).fillna(0.0, ["_gain"])
    q = F.col("q_value") * F.pow(F.lit(1 - rate), F.col("_n")) + F.col("_gain")
    return df.select("id", q.alias("q_value"), F.col("_n").alias("hits"), F.col("_good").alias("successes"), (F.col("_n") - F.col("_good")).alias("failures"))


def postings(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, id, tf) and (id, dl) of the text and the hint when to use it."""
    columns = [c for c in ("text", "when_to_use") if c in memories.columns]
    words = memories.select("id", X.search_tokens(F.concat_ws(" ", *columns)).alias("words"))
    return words.select("id", F.explode("words").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf")), words.select("id", F.size("words").alias("dl"))


#: Terms of all queries that are broadcast to the postings; beyond, both are joined by shuffle.
MAX_TERMS = 200_000
#: Memories that a task scores, about.
MEMORIES = 5_000


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term), distinct, of (qid, query)."""
    return queries.select("qid", F.explode(F.array_distinct(X.search_tokens(F.col("query")))).alias("term"))


def bm25(terms: DataFrame, memories: DataFrame) -> DataFrame:
    """(qid, id, score) of all memories that have a term of the query; more is better.

    Only the postings of terms that some query has are counted; N and the mean
    length cover all memories.  Texts are dealt by id once, and terms, their
    counts and scores stay where their memory is.
    """
    columns = [c for c in ("text", "when_to_use") if c in memories.columns]
    texts = memories.select("id", F.concat_ws(" ", *columns).alias("_text"))
    corpus = texts.agg(F.count("*").alias("_n"), F.avg(F.size(X.search_tokens(F.col("_text")))).alias("_mean"))
    n = max(int(memories.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(memories.count() / MEMORIES))
    words = texts.repartition(n, "id").select("id", X.search_tokens(F.col("_text")).alias("words"))
    few = terms.limit(MAX_TERMS + 1).count() <= MAX_TERMS
    wanted = terms.select("term").distinct()
    if few:  # then no posting is shuffled by its term, however common that is
        wanted = F.broadcast(wanted)
    found = words.select("id", F.size("words").alias("dl"), F.explode("words").alias("term")).join(wanted, "term", "left_semi")
    tf = found.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.crossJoin(F.broadcast(corpus)).select("term", "_mean", F.when(idf > 0, idf).otherwise(LEAST_IDF).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("_mean")))
    asked = terms.join(weights, "term")
    if few:
        asked = F.broadcast(asked)
    return tf.join(asked, "term").groupBy("qid", "id").agg(F.sum(part).alias("score"))


def fuse(*lists: DataFrame) -> DataFrame:
    """(qid, id, fused): reciprocal ranks of several lists, summed."""
    rows = lists[0]
    for more in lists[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("qid", "id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("fused"))


def expand(fused: DataFrame, links: DataFrame, memories: DataFrame) -> DataFrame:
    """Also what links to or from the list, behind it in the order of ids; scope doesn't matter there."""
    ends = links.select(F.col("src").alias("id"), F.col("dst").alias("near")).union(links.select("dst", "src"))
    near = fused.select("qid", "id").join(ends, "id").select("qid", F.col("near").alias("id")).distinct()
    near = near.join(memories.select("id"), "id", "left_semi").join(fused, ["qid", "id"], "left_anti")
    size = fused.groupBy("qid").agg(F.count("*").alias("_n0"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("id"))
    added = near.join(size, "qid").select("qid", "id", (1.0 / (RRF_K + F.col("_n0") + place)).alias("fused"))
    return fused.select("qid", "id", "fused").unionByName(added)


def rerank(fused: DataFrame, memories: DataFrame, limit: int, cwd: str | None = None, include_candidates: bool = False) -> DataFrame:
    """(qid, rank, id, score): recall, utility, quality, recency and scope, less the risk.

    Memories have q_value, quality_avg, risk, scope, origin_repo, status and
    age_days (null if never used).
    """
    best = F.max("fused").over(Window.partitionBy("qid"))
    m = memories if include_candidates else memories.where("status = 'accepted'")
    own = F.coalesce(F.col("origin_repo") == cwd, F.lit(False)) if cwd else F.lit(False)
    scope = F.when(F.col("scope").isin("global", "user") | ((F.col("scope") == "repo") & own), 1.0).when(F.col("scope") == "task", 0.8).otherwise(0.4)
    recency = F.when(F.col("age_days").isNull(), 0.0).otherwise(1.0 / (1.0 + F.greatest(F.lit(0.0), F.col("age_days"))))
    penalty = F.coalesce(F.create_map(*[F.lit(x) for kv in RISK_PENALTY.items() for x in kv])[F.col("risk")], F.lit(0.05))
    score = 0.45 * F.col("_recall") + 0.35 * F.col("q_value") + 0.10 * F.col("quality_avg") + 0.05 * recency + 0.05 * scope - penalty
    df = fused.withColumn("_recall", F.col("fused") / best).join(m, "id").select("qid", "id", score.alias("score"))
    return top_k(df, ["qid"], [F.round("score", 9).desc(), F.col("id")], limit)


def retrieve(queries: DataFrame, memories: DataFrame, links: DataFrame, index: DataFrame, limit: int = 10, cwd: str | None = None, include_candidates: bool = False) -> DataFrame:
    """The memories for each (qid, query), ranked; ``index`` is the positional index of the memories, so phrases count."""
    from .search import recall as found_by

    found = fuse(found_by(queries, index, memories, max(limit * 4, 20), cwd))
    return rerank(expand(found, links, memories), memories, limit, cwd, include_candidates)


def weave(ranked: DataFrame, memories: DataFrame) -> DataFrame:
    """(qid, block): the ranked memories as a list in Markdown."""
    line = F.format_string("- [%s/%s] %s", "kind", "scope", F.regexp_replace("text", r"\s+", " "))
    rows = ranked.join(memories.select("id", "kind", "scope", "text"), "id").select("qid", F.struct("rank", line.alias("line")).alias("r"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("block"))


def dangling(links: DataFrame, memories: DataFrame) -> DataFrame:
    """Links whose target is no memory."""
    return links.join(memories.select(F.col("id").alias("dst")), "dst", "left_anti")


def near_duplicates(candidates: DataFrame, keep: int = 8, least: float = 0.75, confidence: float = 0.40) -> DataFrame:
    """The candidates of each session that stay: no high risk, enough confidence, none like one kept before.

    Goes through each session's candidates (session_id, id, kind, text, risk,
    confidence, priority) by priority, confidence, kind and id, and stops at
    ``keep``.  A session's candidates are few; they are one array.
    """
    ok = candidates.where((F.coalesce("risk", F.lit("")) != "high") & (F.col("confidence") >= confidence))
    item = F.struct((-F.col("priority")).alias("p"), (-F.col("confidence")).alias("c"), "kind", "id", X.word_set(F.col("text")).alias("words"))
    rows = ok.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.slice("items", 1, 0)
    like = lambda kept, x: F.exists(kept, lambda k: (k["kind"] == x["kind"]) & (X.jaccard(k["words"], x["words"]) >= least))
    step = lambda kept, x: F.when((F.size(kept) >= keep) | like(kept, x), kept).otherwise(F.concat(kept, F.array(x)))
    kept = rows.select("session_id", F.aggregate("items", empty, step).alias("kept"))
    return kept.select("session_id", F.posexplode("kept").alias("rank", "item")).select("session_id", (F.col("rank") + 1).alias("rank"), "item.id")


def upsert(rows: DataFrame) -> DataFrame:
    """Memories after all rows (ord, id, content_hash, created_at, evidence, ...) are taken in, in order.

    A row whose content is known goes to the memory that had it first; the last
    row of a memory holds, but it keeps its first created_at.  ``evidence``, an
    array, is gathered without repeats, and evidence_count counts every attempt.
    """
    first = rows.groupBy("content_hash").agg(F.min_by("id", "ord").alias("_own"))
    placed = rows.join(first, "content_hash").withColumn("id", F.col("_own")).drop("_own")
    kept = [c for c in placed.columns if c not in ("id", "created_at", "evidence")]
    last = F.max_by(F.struct(*kept), "ord").alias("_row")
    merged = placed.groupBy("id").agg(last, F.min("created_at").alias("created_at"), F.sum(F.size(F.coalesce("evidence", F.array().cast("array<string>")))).alias("evidence_count"))
    proof = placed.select("id", F.explode("evidence").alias("ref")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("ref")).alias("evidence"))
    return merged.join(proof, "id", "left").select("id", "created_at", *[F.col("_row")[c].alias(c) for c in kept], "evidence_count", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


def clamped(reward: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), reward.cast("double")))


def update_utility(memories: DataFrame, events: DataFrame, memory_id: str, reward: float, ord_: int) -> tuple[DataFrame, DataFrame]:
    """Events with one reward more, and the memory's row after all of its rewards; an unknown id is a KeyError.

    The reward is logged first, clamped to 0 to 1, whether the memory is there or not.
    """
    spark = memories.sparkSession
    new = spark.createDataFrame([(memory_id, ord_, min(1.0, max(0.0, float(reward))))], "memory_id string, line long, reward double")
    events = events.select("memory_id", "line", "reward").unionByName(new)
    own = memories.where(F.col("id") == memory_id)
    if not own.limit(1).count():
        raise KeyError(memory_id)
    return events, fold_rewards(own.select("id", "q_value"), events.where(F.col("memory_id") == memory_id))


def append(rows: DataFrame, path: str) -> None:
    """Add records to the log of memories, from which rebuild() makes the tables again."""
    rows.write.mode("append").json(path)


def rebuild(rows: DataFrame, rewards: DataFrame) -> dict[str, DataFrame]:
    """The memory tables of all records (as for upsert, with text and q_value) and rewards (memory_id, line, reward).

    memory: one row a memory with its utility; link: its wiki links; counts: how
    many of each there are.
    """
    memory = upsert(rows)
    folded = fold_rewards(memory.select("id", "q_value"), rewards.withColumn("reward", clamped(F.col("reward"))).join(memory.select(F.col("id").alias("memory_id")), "memory_id", "left_semi"))
    memory = memory.drop("q_value").join(folded, "id", "left")
    link = memory.select(F.col("id").alias("src"), F.explode(X.wiki_links(F.col("text"))).alias("dst"))
    counts = memory.agg(F.count("*").alias("n")).select(F.lit("memory").alias("table"), "n").unionByName(link.agg(F.count("*").alias("n")).select(F.lit("link").alias("table"), "n"))
    return {"memory": memory, "link": link, "counts": counts}


def query_units(queries: DataFrame) -> DataFrame:
    """(qid, unit, words) of (qid, query): its terms, distinct; one with punctuation is a phrase of several words."""
    terms = F.array_distinct(F.regexp_extract_all("query", F.lit(r"([\p{L}\p{N}_./:-]+)"), 1))
    rows = queries.select("qid", F.explode(terms).alias("unit")).withColumn("words", X.search_tokens(F.col("unit")))
    return rows.where(F.size("words") > 0)


def unit_counts(units: DataFrame, memories: DataFrame) -> DataFrame:
    """(qid, unit, id, tf): how often a memory's text has each term, or the words of a phrase one after another."""
    distinct = units.select("unit", "words").distinct()
    wanted = distinct.select("unit", "words", F.size("words").alias("_n"), F.posexplode("words").alias("_at", "term"))
    beside = lambda by: F.when((F.col("_at") + by >= 0) & (F.col("_at") + by < F.col("_n")), F.get(F.col("words"), F.col("_at") + by))
    wanted = wanted.select("unit", "_n", "_at", "term", beside(-1).alias("_lead"), beside(1).alias("_follow"))
    texts = memories.select("id", X.search_tokens(F.col("text")).alias("w"))
    near = F.transform("w", lambda t, i: F.struct(t.alias("term"), F.get(F.col("w"), i - 1).alias("_before"), F.get(F.col("w"), i + 1).alias("_next")))
    found = texts.select("id", F.posexplode(near).alias("_pos", "p")).select("id", "_pos", "p.*")
    small = lambda df: F.broadcast(df) if df.limit(MAX_TERMS + 1).count() <= MAX_TERMS else df
    # a word of a phrase counts beside the phrase's own words only; of common words hardly any row is left
    beside_own = (F.col("_lead").isNull() | (F.col("_lead") == F.col("_before"))) & (F.col("_follow").isNull() | (F.col("_follow") == F.col("_next")))
    met = found.join(small(wanted), "term").where(beside_own).select("unit", "id", "_n", (F.col("_pos") - F.col("_at")).alias("_start"))
    groups = met.groupBy("unit", "id", "_n", F.when(F.col("_n") > 1, F.col("_start")).alias("_start")).agg(F.count("*").alias("_k")).where("_n = 1 OR _k = _n")
    counts = groups.groupBy("unit", "id").agg(F.sum(F.when(F.col("_n") == 1, F.col("_k")).otherwise(1)).alias("tf"))
    return counts.join(small(units.select("qid", "unit").distinct()), "unit").select("qid", "unit", "id", "tf")
