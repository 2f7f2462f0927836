"""The rules against plain patterns, the tagger against brute force, finite differences and rewritten spans."""

import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlog.llm import personal as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


PIECES = ["a", "b.c", "@", ".", "-", "x@y.z", "1", "22", "255", "256", "007", "4539578763621486", "4111 1111 1111 1111", "+1 (234) 567-8901", "+", " ", "(", ")", "é", "\n", "%", "1.2.3.4"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_rules_are_the_plain_patterns(text):
    assert P.rules(text) == plain(text)


def test_rules_on_real_texts(spark):
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert sum(len(plain(t)) for t in texts) > 30
    for t in texts:
        assert P.rules(t) == plain(t)
        assert all(any(a <= s and e <= b for a, b in P.stretches(t)) for _, s, e in P.rules(t))


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 (" * 80_000, "a@" * 150_000, "1 " * 150_000, "a." * 150_000 + "@", "@" + "a." * 150_000 + "@b.c", "[at]" * 75_000])
def test_rules_take_linear_time(text):
    began = time.time()
    P.rules(text)
    P.stretches(text)
    assert time.time() - began < 3


def small(seed, n=3, length=6):
    rnd = np.random.default_rng(seed)
    p = {k: v.astype(np.float64) + np.where(np.abs(v) < 20, rnd.normal(0, 0.3, v.shape), 0) for k, v in P.initial(3, seed).items()}
    sizes = [length, length - 2, 1][:n]
    ids, there = P.padded([rnd.integers(0, 5, s) for s in sizes], length)
    truth = np.zeros((n, length), dtype=np.int64)
    for i, s in enumerate(sizes):
        truth[i, :s] = P.tags(s, [x for x in [("ip", 0, min(2, s)), ("phone", 3, min(5, s))] if x[1] < x[2] and i < 2])
    return p, ids, there.astype(np.float64), truth, sizes


def paths(p, scores):
    """Every path with its score."""
    for way in itertools.product(range(P.TAGS), repeat=len(scores)):
        yield way, p["begin"][way[0]] + scores[0][way[0]] + sum(p["step"][a, b] + scores[t + 1][b] for t, (a, b) in enumerate(zip(way, way[1:])))


def test_loss_and_paths_against_all_paths():
    p, ids, there, truth, _ = small(1, length=4)
    sizes = [4, 2, 1]
    scores = P.emissions(p, ids, there)[0]
    want, best = [], []
    for i, size in enumerate(sizes):
        all_ = list(paths(p, scores[:size, i]))
        total = np.logaddexp.reduce([s for _, s in all_])
        want.append(total - next(s for w, s in all_ if w == tuple(truth[i, :size])))
        best.append(max(all_, key=lambda x: x[1])[0])
    assert abs(P.loss(p, ids, there, truth) - np.mean(want)) < 1e-6
    assert [tuple(x) for x in P.decode_many(p, scores, np.array(sizes), 0.0)] == best
    blocks = [[scores[:1, i], scores[1:s, i]] if s > 1 else [scores[:1, i]] for i, s in enumerate(sizes)]
    assert [tuple(P.decode(p, iter(b), 0.0)) for b in blocks] == best


def test_gradients_against_differences():
    p, ids, there, truth, _ = small(2)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    P.loss(p, ids, there, truth, grads)
    rnd = random.Random(3)
    for name in p:
        for _ in range(12):
            at = tuple(rnd.randrange(n) for n in p[name].shape) if not name.startswith("in_") else (rnd.randrange(5), rnd.randrange(12))
            if name in ("step", "begin") and p[name][at] < -20:
                continue
            kept, ends = p[name][at], []
            for d in (1e-5, -1e-5):
                p[name][at] = kept + d
                ends.append(P.loss(p, ids, there, truth))
            p[name][at] = kept
            assert abs((ends[0] - ends[1]) / 2e-5 - grads[name][at]) < 1e-5, (name, at)


def test_windows_of_a_long_stretch_are_merged_into_one_path():
    p = P.initial()
    for size in (1, 95, 96, 97, 143, 144, 145, 1000, 60_000):
        blocks = list(P.merged(p, np.random.default_rng(size).integers(40, 100, size)))
        assert sum(map(len, blocks)) == size
        path = P.decode(p, iter(blocks), 0.0)
        assert len(path) == size
        assert all(before in (tag, tag - 1) for before, tag in zip(path, path[1:]) if tag and tag % 2 == 0)


SAMPLE = ["mail {e} now", "see {i} there", "paid with {c} today", "ring {p} please", "in 1999 we had 12 of 30", "version 2.0 of it, id 99887766"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rnd.randrange(2, 9)))
    rows = []
    for i in range(900):
        digits = "4" + "".join(str(rnd.randrange(10)) for _ in range(14))
        digits += next(d for d in "0123456789" if P.luhn(digits + d))
        fill = dict(e=f"{word().encode('ascii', 'ignore').decode() or 'x'}.{rnd.randrange(99)}@mail{rnd.randrange(9)}.example.com", i=".".join(str(rnd.randrange(256)) for _ in range(4)), c=digits, p=f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}")
        rows.append((i, " ".join(word() for _ in range(rnd.randrange(3, 20))) + " " + SAMPLE[i // 3 % 6].format(**fill) + " " + " ".join(word() for _ in range(rnd.randrange(3, 20)))))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.fixture(scope="module")
def model(docs):
    return P.fit(docs.where("doc_id % 3 <> 0"))


def test_rewritten_spans_are_found_and_ordinary_digits_are_not(docs, model):
    rnd = random.Random(8)
    cases, want = [], []
    for r in docs.where("doc_id % 3 = 0").collect():
        text, spans = P.variant(r.text, P.rules(r.text), rnd)
        cases.append((text, P.stretches(text), P.rules(text)))
        want.append([s for s in spans if s not in cases[-1][2]])
    got = P.added(model, cases)
    asked, hit = sum(map(len, want)), sum(len(set(w) & set(g)) for w, g in zip(want, got))
    wrong = sum(len([s for s in g if not any(s[1] < e and b < s[2] for _, b, e in w)]) for w, g in zip(want, got))
    assert asked > 100 and hit >= 0.8 * asked and wrong <= 0.02 * len(cases)


def test_find_on_odd_rows(spark, model):
    long = "word " * 300_000 + "a.b@c.de " + "77 " * 20_000 + "1.2.3.4"
    rows = [(1, None, "x"), (2, "", None), (None, "p@q.rs", "x"), (3, long, "x"), (4, "é😀 p@q.rs 1.2.3.4", "x"), (4, "é😀 p@q.rs 1.2.3.4", "x"), (5, "no digits", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ruled string")
    out = P.find(df.withColumnRenamed("ruled", "_text2"), model).collect()
    got = sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.ruled]) for r in out)
    want = sorted((str(i), P.rules(t or "")) for i, t, _ in rows)
    assert got == want
    for r in out:
        base, all_ = [tuple(s) for s in r.ruled], [tuple(s) for s in r.found]
        assert set(base) <= set(all_) and all_ == sorted(all_, key=lambda s: (s[1], P.KINDS.index(s[0])))
    assert [s for r in out if r.doc_id == 4 for s in r.ruled][0].start == 3


def test_empty_table_and_texts_without_spans(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.find(none, P.fit(none)).collect() == []
    bare = spark.createDataFrame([(1, "no digits"), (2, "some 12 digits"), (3, None)], "doc_id long, text string")
    assert all(r.found == [] for r in P.find(bare, P.fit(bare)).collect())


def test_masked(spark):
    text = "mail p@q.rs or +1 (234) 567-8901 now 😀"
    df = spark.createDataFrame([(text, P.rules(text)), ("none", []), (None, [])], f"t string, s {P.SPANS}")
    assert [r[0] for r in df.select(P.masked(df.t, df.s)).collect()] == ["mail [email] or [phone] now 😀", "none", None]


def test_query_gives_the_digests(spark):
    import hashlib

    from loomlog.llm.queries import op12_personal_data

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    rows = op12_personal_data(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs) and zlib.crc32(b"") == 0
    for r in rows:
        base = P.rules(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in P.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(",")) | ({""} if not base else set())


def test_spans_side_by_side_that_the_rules_drop(docs, model):
    rnd = random.Random(4)
    cases, want = [], []
    for r in docs.where("doc_id % 3 = 0").limit(60).collect():
        number = "".join(str(rnd.randrange(10)) for _ in range(7))
        text = f"{r.text[:20]} +1 ({number[:3]}) 555-{number[3:]} 4539578763621486 and more"
        cases.append((text, P.stretches(text), P.rules(text)))
        want.append([(k, s, e) for k, s, e in (("phone", 21, 38), ("card", 39, 55)) if (k, s, e) not in cases[-1][2]])
    got = P.added(model, cases)
    assert sum(map(len, want)) >= 100 and sum(len(set(w) & set(g)) for w, g in zip(want, got)) >= 0.8 * sum(map(len, want))
    assert P.unsure(cases[0][0]) and not P.unsure("+1 (208) 555-1177 and 4539578763621486")


@pytest.mark.parametrize("piece", ["jane.roe at example.com", "jane.roe AT example.com", "jane at example dot com", "jane[at]example.com", "jane at example (dot) org", "jane\u00a0at\u2003example.com"])
def test_every_place_that_can_hold_a_span_is_read(piece):
    text = f"write to {piece} today"
    assert P.plausible("email", piece)
    assert any(s <= 9 and 9 + len(piece) <= e for s, e in P.stretches(text))
    assert P._hinted(pa.array(["look at me", text, None]))[0].tolist() == [1]
    assert not P.stretches("nothing to look at here. Then they met at the dotted line")
