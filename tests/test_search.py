"""The positional index and the memory store against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomlog.operators import search as S
from loomlog.sources.memory_store import EVENT, RECORD, MemoryStore

WORD = re.compile(r"[^\W_]+")
UNIT = re.compile(r"[\w./:-]+")


def places(text, hint):
    return WORD.findall(text.lower()), WORD.findall(hint.lower())


def tf(unit, fields):
    return sum(all(f[i + j] == w for j, w in enumerate(unit)) for f in fields for i in range(len(f) - len(unit) + 1))


def scores(query, docs):
    """BM25 of each document, phrases with their own frequency."""
    lengths = {i: sum(map(len, f)) for i, f in docs.items()}
    mean, n, out = sum(lengths.values()) / len(docs), len(docs), {}
    for term in UNIT.findall(query):
        unit = WORD.findall(term.lower().replace("_", " "))
        if unit:
            counts = {i: c for i, f in docs.items() if (c := tf(unit, f))}
            idf = math.log((n - len(counts) + 0.5) / (len(counts) + 0.5))
            idf = idf if idf > 0 else 1e-6
            for i, c in counts.items():
                out[i] = out.get(i, 0) + idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * lengths[i] / mean))
    return out


def corpus(n, seed):
    rnd = random.Random(seed)
    words = ["the"] * 30 + ["a"] * 12 + [f"w{i}" for i in range(25)]
    return [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 25))), " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 6)))) for i in range(n)]


@pytest.fixture(scope="module")
def made(spark):
    rows = corpus(150, 1) + [(1000, "w1-w2. W1/w2", ""), (1001, "", ""), (1002, "w1", "w2"), (1003, "the the the w1 w2 w1 w2", "w1_w2")]
    df = spark.createDataFrame(rows, "id long, text string, when_to_use string")
    return {i: places(t, h) for i, t, h in rows}, S.postings(df).cache()


QUERIES = ["the a", "w1-w2 the", "w1_w2 w1_w2 w3", "the:the a/the", "nothing-here", "w1/w2/w1", "--- ...", "the the the", "w7 w8 w9 the a w10", "w1 w2"]


def test_postings(made):
    docs, index = made
    for r in index.collect():
        first, second = docs[r.id]
        both = [*first, None, *second]
        assert r.length == len(first) + len(second)
        assert r.positions == ([] if r.term == "" else [i for i, w in enumerate(both) if w == r.term])
    assert index.where("term = ''").count() == len(docs)


@pytest.mark.parametrize("k", [1, 40])
def test_search_against_brute_force(spark, made, k):
    docs, index = made
    units = S.query_units(spark.createDataFrame(list(enumerate(QUERIES)), "qid long, query string"))
    want = {(q, i): s for q, query in enumerate(QUERIES) for i, s in scores(query, docs).items()}
    got = {(r.qid, r.id): r.score for r in S.score(units, index).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    for only in (None, [i for i in docs if i % 3]):
        inside = None if only is None else spark.createDataFrame([(i,) for i in only], "id long")
        ranked = {}
        for (q, i), s in want.items():
            if only is None or i in only:
                ranked.setdefault(q, []).append((-round(s, 9), i))
        best = sorted((q, n + 1, i) for q, rows in ranked.items() for n, (_, i) in enumerate(sorted(rows)[:k]))
        assert sorted((r.qid, r.rank, r.id) for r in S.best(units, index, k, inside).collect()) == best


def test_stored_index_prunes_and_equals(spark, made, tmp_path):
    docs, index = made
    path = str(tmp_path / "index")
    S.write_index(index, path)
    assert sorted(map(str, S.read_index(spark, path).drop("shard").collect())) == sorted(map(str, index.collect()))
    units = S.query_units(spark.createDataFrame([(1, "w1-w2 w3")], "qid long, query string"))
    plan = S.hits(units, S.read_index(spark, path))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan and "Cartesian" not in plan
    changed = index.where("id = 1000").withColumn("length", F.lit(99))
    shard = [r[0] for r in changed.select(S.shard_of(F.col("id"))).distinct().collect()]
    S.write_index(changed, path)
    left = S.read_index(spark, path)
    assert {r.length for r in left.where(F.col("shard").isin(shard)).collect()} == {99}
    assert left.where(~F.col("shard").isin(shard)).count() == index.where(~S.shard_of(F.col("id")).isin(shard)).count()


def batches(seed, n=4, size=30):
    """Records that repeat ids and contents within and over batches, and events, some before their memory."""
    rnd = random.Random(seed)
    out = []
    for b in range(n):
        records = [(f"m{rnd.randrange(25)}", i, rnd.choice(["fact", "rule"]), rnd.choice(["repo", "user"]), "accepted", f"text {rnd.randrange(20)} [[m{rnd.randrange(30)}]]", rnd.choice(["", "if [[m3|x]]", None]), rnd.choice(["r1", None]), 0.5, 3, "low", rnd.random(), 0.0, 100 * b + i, rnd.choice([None, [], ["a", f"e{rnd.randrange(6)}"]])) for i in range(size)]
        events = [(f"m{rnd.randrange(40)}", i, rnd.choice(["memory_rewarded", "memory_rewarded", "memory_used"]), "s", rnd.choice([None, 0.0, 0.4, 0.5, 1.0, 3.0]), None, 10 * b + i) for i in range(size)]
        out.append((records, events))
    return out


def plain(all_):
    """The memories, links, evidence and utilities after all batches, in order."""
    owner, memory, proof = {}, {}, set()
    for records, _ in all_:
        for r in records:
            content = (r[5], r[3], r[2], r[7] if r[3] == "repo" else "")
            i = owner.setdefault(content, r[0])
            old = memory.get(i)
            memory[i] = dict(text=r[5], q=r[11], created=min(r[13], old["created"]) if old else r[13], count=(old["count"] if old else 0) + len(r[14] or []), links=list(dict.fromkeys(re.findall(r"\[\[([^\]|#]+)", f"{r[5]}\n{r[6] or ''}"))))
            proof |= {(i, e) for e in r[14] or []}
    used = {}
    for _, events in all_:
        for e in events:
            if e[2] == "memory_rewarded" and e[4] is not None:
                used.setdefault(e[0], []).append(min(1.0, max(0.0, e[4])))
    for i, m in memory.items():
        for r in used.get(i, []):
            m["q"] += 0.2 * (r - m["q"])
        m["hits"], m["good"] = len(used.get(i, [])), sum(r >= 0.5 for r in used.get(i, []))
    return memory, proof


def state(store):
    memory = sorted((r.id, r.text, round(r.q_value, 9), r.created_at, r.evidence_count, r.hits, r.successes, r.failures) for r in store.memory().collect())
    return memory, sorted(map(tuple, store.links().collect())), sorted(map(tuple, store.evidence().collect())), sorted((r.id, r.term, tuple(r.positions), r.length) for r in store.index().collect()), sorted((r.memory_id, r.line, r.batch) for r in store.events().collect())


def test_appends_equal_a_rebuild_and_plain_python(spark, tmp_path):
    all_ = batches(3)
    store = MemoryStore(spark, str(tmp_path / "store"), shards=4)
    for records, events in all_:
        store.append(spark.createDataFrame(records, RECORD).repartition(3), spark.createDataFrame(events, EVENT).repartition(2))
    memory, proof = plain(all_)
    got = state(store)
    assert got[0] == sorted((i, m["text"], round(m["q"], 9), m["created"], m["count"], m["hits"], m["good"], m["hits"] - m["good"]) for i, m in memory.items())
    assert got[1] == sorted((i, d) for i, m in memory.items() for d in m["links"]) and got[2] == sorted(proof)
    want = S.postings(store.memory()).collect()
    assert got[3] == sorted((r.id, r.term, tuple(r.positions), r.length) for r in want) and len(got[4]) == 4 * 30
    counts = {r.table: r.n for r in store.counts().collect()}
    assert counts["memory"] == len(memory) and counts["dangling"] == sum(d not in memory for m in memory.values() for d in m["links"])
    store.rebuild()
    assert state(store) == got


def test_an_append_that_broke_off_is_made_good(spark, tmp_path, monkeypatch):
    all_ = batches(5, n=3, size=12)
    whole, broken = (MemoryStore(spark, str(tmp_path / x), shards=3) for x in ("whole", "broken"))
    frames = [(spark.createDataFrame(r, RECORD), spark.createDataFrame(e, EVENT)) for r, e in all_]
    for r, e in frames:
        whole.append(r, e)
    broken.append(*frames[0])
    with monkeypatch.context() as m:
        m.setattr(MemoryStore, "_utility", lambda self, events: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            broken.append(*frames[1])
    broken.append(*frames[2])
    assert state(broken) == state(whole)


def test_only_touched_shards_are_written(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "s"), shards=8)
    rows = [(f"m{i}", i, "fact", "user", "accepted", f"t{i}", "", None, 0.5, 3, "low", 0.5, 0.0, i, None) for i in range(40)]
    store.append(spark.createDataFrame(rows, RECORD))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "s/memory").rglob("*.parquet")}
    store.append(spark.createDataFrame([("m1", 1, "fact", "user", "accepted", "new", "", None, 0.5, 3, "low", 0.5, 0.0, 1, None)], RECORD))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "s/memory").rglob("*.parquet")}
    kept = before.items() & after.items()
    assert len({p.parent for p, _ in before.items() - kept}) == 1 and store.memory().where("text = 'new'").count() == 1


def test_empty_and_odd_batches(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "s"))
    assert store.memory().count() == 0 and store.index().count() == 0
    store.append()
    store.append(spark.createDataFrame([(None, "x"), ("a", None), ("b", "")], "id string, text string"), spark.createDataFrame([(None, 1.0)], "memory_id string, reward double"))
    assert [r.id for r in store.memory().collect()] == ["b"] and store.events().count() == 0
    store.rebuild()
    assert [r.id for r in store.memory().collect()] == ["b"]


def test_unit_counts_keep_only_words_beside_their_phrase(spark):
    from loomlog.operators import memory as M

    texts = ["the cat the dog the cat cat", "cat the", "a the cat"] + ["the the the"] * 20
    m = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    units = M.query_units(spark.createDataFrame([(1, "the-cat dog"), (2, "the-cat the-the"), (3, "cat")], "qid long, query string"))
    got = M.unit_counts(units, m)
    expected = {(q, "the-cat", i, n) for q in (1, 2) for i, n in ((0, 2), (2, 1))} | {(1, "dog", 0, 1), (3, "cat", 0, 3), (3, "cat", 1, 1), (3, "cat", 2, 1)}
    expected |= {(2, "the-the", i, 2) for i in range(3, 23)}
    assert {tuple(r) for r in got.select("qid", "unit", "id", "tf").collect()} == expected
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [qid" in line and "_start" in line]  # a unit is counted once, whoever asks


def test_scores_stay_where_their_memory_is(spark):
    """No row is shuffled for a query and memory, and for none of its terms."""
    from loomlog.operators import memory as M

    memories = spark.createDataFrame([(i, "alpha beta " * (i % 3) + "gamma") for i in range(30)], "id long, text string")
    terms = spark.createDataFrame([(1, "alpha"), (1, "gamma"), (2, "beta")], "qid long, term string")
    scored = M.bm25(terms, memories)
    assert scored.count() == 30 + 20
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" not in plan and ", id#" not in "".join(x.split(")")[0] for x in plan.split("hashpartitioning(")[1:])


def test_a_new_index_has_what_postings_have_and_memories_stay_whole(spark, made, tmp_path):
    """Texts are dealt before they are made postings: all of a memory's are in one file."""
    m = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(12))) for i in range(200)], "id long, text string")
    S.index_memories(m, str(tmp_path / "index"))
    got = S.read_index(spark, str(tmp_path / "index"))
    assert sorted(map(str, got.select("id", "term", "positions", "length").collect())) == sorted(map(str, S.postings(m).collect()))
    files = got.select("id", F.input_file_name().alias("file")).distinct()
    assert files.count() == 200 and files.select("file").distinct().count() > 1


def test_scores_of_the_index_stay_where_their_memory_is(spark):
    """Scores are summed up without a shuffle by query and memory."""
    hits = spark.createDataFrame([(1, i, 1 + i % 3, 9) for i in range(50)] + [(2, i, 1, 9) for i in range(0, 50, 2)], "_number int, id long, tf int, length int")
    asked = spark.createDataFrame([(q, u, 1, 5.0, 1.5) for q in range(3) for u in (1, 2)], "qid long, unit int, times long, mean double, idf double")
    scores = S._score(S._unpacked(S._packed(hits, 4).repartition(4, "id")), asked)
    assert "hashpartitioning(qid" not in scores._jdf.queryExecution().executedPlan().toString()
    plain = S._score(hits.withColumnRenamed("_number", "unit"), asked)
    key = lambda df: sorted((r["qid"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert key(scores) == key(plain) and len(key(scores)) == 150
