"""Training-data operators against brute force, with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomlog.llm import components, fingerprints, jaccard_join, language_id, line_rules, nbest, packing, passages, toxicity, urls, wrappers
from loomlog.llm.common import shingle_hashes, word_hashes

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = split((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 160))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(12):  # copies, near copies, and a shared passage
        rows.append((100 + i, base[3]))
        words = base[5].split() + base[7].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((200 + i, " ".join(words)))
        rows.append((300 + i, base[10 + i] + "\n" + passage + " " + base[30 + i]))
    return rows + [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "One"), (905, "\U0001f600 é ü 日本 語"), (100, base[3])]


# ---- hashes


def test_word_hashes_tell_words_apart():
    a = word_hashes("The cat sat  on\nthe mat", fold=True)
    assert len(a) == 6 and a[0] == a[4] and len(set(a.tolist())) == 5
    assert (word_hashes("xx The", True)[1:] == word_hashes("tHE", True)).all()
    assert len(word_hashes(None, True)) == len(word_hashes(" \t", True)) == 0
    assert len(shingle_hashes(a, 5)) == 2 and len(shingle_hashes(a[:3], 5)) == 1


# ---- 10


def components_of(rows):
    """(row, size of its set, smallest linked doc_id) by brute force."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def test_jaccard_join_is_exact(spark):
    rows = corpus() + [(3, "another text under an id that is there"), (7, None)]
    assert sorted(map(tuple, jaccard_join.join(spark.createDataFrame(rows, DOCS)).collect())) == components_of(rows)


def just_apart(n):
    """Texts that share a passage and are a little less alike than linked ones, with some copies of each."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(n):
        own = [f"o{i}x{j}" for j in range(rng.randint(8, 30))]
        rows.append((i, " ".join([*passage, *own])))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join([*passage, *own[:-1], "end"])))
    return rows


@pytest.mark.parametrize("leaf, pairs, salt", [(1_500, 1, 10_000), (1_500, 100_000, 7)])
def test_jaccard_join_splits_regions(spark, monkeypatch, leaf, pairs, salt):
    """A very common passage: one region with all documents, split again and again, or in tiles."""
    monkeypatch.setattr(jaccard_join, "LEAF_SHINGLES", leaf)
    monkeypatch.setattr(jaccard_join, "PAIRS", pairs)
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", salt)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    clusters = []
    for c in range(6):  # groups of near copies that share a start
        base = ["same"] * 3 + [f"s{i}" for i in range(60)] + [rng.choice(words) for _ in range(60)]
        for i in range(12):
            mine = list(base)
            for _ in range(rng.randint(1, 6)):
                mine[rng.randrange(len(mine))] = f"x{c}y{i}"
            clusters.append((5000 + 100 * c + i, " ".join(mine)))
    rows = just_apart(40) + clusters
    got = jaccard_join.join(spark.createDataFrame(rows, DOCS))
    assert sorted(map(tuple, got.collect())) == components_of(rows)


def test_jaccard_join_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g", 1, "x"), (2, "a b c d e f g", 2, "y"), (None, None, 3, "z")], "doc_id long, text string, key long, part string")
    got = sorted(map(tuple, jaccard_join.join(docs).collect()), key=str)
    assert got == [(2, 3, 2), (None, 0, None), (None, 3, 2)]


def test_jaccard_join_when_pivots_do_not_reach(spark):
    """A chain of links: each document is near the next one only."""
    words = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 100])) for i in range(30)]
    got = {r[0]: r[2] for r in jaccard_join.join(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(got.values()) == {0}
    assert jaccard_join.join(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 60), (7, 7)], "a long, b long")
    got = {r[0]: r[1] for r in components.connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[50] == got[60] == got[40] == 40


# ---- 5


def test_compact_windows_cover_each_subsequence_once():
    values = np.random.default_rng(1).permutation(60).astype(np.uint64)
    windows = passages.compact_windows(values, 10)
    for i in range(60):
        for j in range(i + 10, 61):
            at = i + int(values[i:j].argmin())
            assert sum(left <= i and at == c and j <= right for left, c, right in windows) == 1


def test_passages_against_brute_force(spark):
    rows = corpus()
    found = passages.find(spark.createDataFrame(rows, DOCS)).collect()
    words = {i: split((t or "").translate(LOWER)) for i, t in rows}
    where = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add(i)
    have = {}
    for r in found:
        have.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        assert r["end_word"] - r["start_word"] >= 50 and r["later"] == (r["first_doc"] < r["doc_id"]) or not r["later"]
    for i, w in words.items():
        need = {p for k in range(len(w) - 49) if len(where[tuple(w[k : k + 50])]) > 1 for p in range(k, k + 50)}
        assert need <= have.get(i, set())
    assert not have.keys() & {900, 901, 902, 903}


def test_passages_are_removed_once(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(7))
    passage = " ".join(word() for _ in range(60))
    own = [" ".join(word() for _ in range(30)) for _ in range(4)]
    edited = passage.split()
    edited[30] = "other"
    rows = [(1, own[0] + "\n" + passage), (2, passage + " " + own[1]), (3, own[2] + " " + " ".join(edited) + " " + own[3]), (4, passage), (5, None), (6, own[0])]
    docs = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows], "doc_id long, text string, n_chars long, first_doc string")
    got = {r["doc_id"]: r for r in passages.remove(docs, passages.find(docs)).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"].strip() == own[1] and 4 not in got
    assert got[3]["text"] == own[2] + " " + own[3] and got[3]["n_chars"] == len(got[3]["text"])
    assert got[5]["text"] is None and got[6]["text"] == own[0] and got[6]["first_doc"] == "x"
    assert passages.find(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_with_longer_edits(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(7))
    rows = []
    for k in range(40):  # 90 words of which 4 in the middle are replaced, or before which 4 are inserted
        passage = [word() for _ in range(90)]
        other = passage[:43] + [word() for _ in range(4)] + passage[47 if k % 2 else 43 :]
        rows += [(2 * k, " ".join([word() for _ in range(30)] + passage)), (2 * k + 1, " ".join(other + [word() for _ in range(30)]))]
    found = {r["doc_id"]: r for r in passages.find(spark.createDataFrame(rows, DOCS)).collect()}
    missed = [k for k in range(40) if 2 * k + 1 not in found or 2 * k not in found]
    assert len(missed) <= 1
    for k in set(range(40)) - set(missed):
        r = found[2 * k + 1]
        assert r["later"] and r["first_doc"] == 2 * k and r["end_word"] - r["start_word"] >= 85
        assert not found[2 * k]["later"]


def test_compact_windows_of_equal_tokens():
    for values in (np.zeros(200_000), np.tile(np.arange(7), 20_000)):
        found = passages.compact_windows(values, 46)
        assert all(values[a] == values[i:j].min() and i <= a < j and j - i >= 46 for i, a, j in found[:2000])
    few = np.array([3, 1, 1, 2, 1, 5])
    assert sorted(passages.compact_windows(few, 2)) == sorted([(0, 1, 6), (2, 2, 6), (3, 4, 6)])


def test_passages_recall_with_spread_edits(spark):
    """Passages of 55 to 200 words with an edit every 30 to 45 words: at least 0.9 of those of similarity 0.75 are found."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    rows, wanted = [], set()
    for k in range(150):
        n = rng.choice([55, 60, 80, 100, 200])
        one = [word() for _ in range(n)]
        two, step = list(one), rng.randint(30, 45)
        for at in range(step, n - 4, step):
            two[at] = word()
        a, b = ({tuple(x[i : i + 5]) for i in range(n - 4)} for x in (one, two))
        if len(a & b) >= 0.75 * len(a | b):
            wanted.add(2 * k + 1)
        rows += [(2 * k, " ".join([word() for _ in range(40)] + one)), (2 * k + 1, " ".join(two + [word() for _ in range(40)]))]
    found = {r["doc_id"] for r in passages.find(spark.createDataFrame(rows, DOCS)).where("later").collect()}
    assert len(wanted) > 30 and len(wanted & found) >= 0.9 * len(wanted)


def test_passages_of_several_documents_are_none(spark):
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(7))
    line = [" ".join(word() for _ in range(20)) for _ in range(3)]
    own = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = [(k, own[k] + "\n" + line[k] + "\n" + " ".join(word() for _ in range(40))) for k in range(3)] + [(3, "\n".join(line)), (4, own[3] + " " + " ".join(line))]
    docs = spark.createDataFrame(rows, DOCS)
    found = passages.find(docs).collect()
    assert {(r["doc_id"], r["first_doc"], r["later"]) for r in found} == {(4, 3, True), (3, 3, False)}
    assert passages.remove(docs, passages.find(docs)).where("doc_id = 3").count() == 1


def test_passages_are_compared_with_all_holders(spark):
    """Copies of a passage with other documents before and between them that have its halves the other way round."""
    rng = random.Random(41)
    rows = []
    for k in range(20):
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))  # noqa: B023, E731
        own = lambda: [word() for _ in range(60)]  # noqa: B023, E731
        passage = [word() for _ in range(70)]
        turned = lambda: own() + passage[35:] + own() + passage[:35] + own()  # noqa: B023, E731
        rows += [(10 * k + at, " ".join(words)) for at, words in enumerate((turned(), own() + passage + own(), turned(), own() + passage))]
    found = passages.find(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r["doc_id"], r["first_doc"]) for r in found if r["later"]} == {(10 * k + 3, 10 * k + 1) for k in range(20)}


def test_passages_of_many_holders(spark, monkeypatch):
    """A key's blocks of holders give each pair once."""
    monkeypatch.setattr(passages, "FEW", 4)
    monkeypatch.setattr(passages, "BLOCK", 5)
    rows = pd.DataFrame([(0, np.arange(23).tobytes(), np.ones(23, np.int32).tobytes(), np.full(23, 7, np.uint64).tobytes()), (0, np.arange(3).tobytes(), np.ones(3, np.int32).tobytes(), np.full(3, 8, np.uint64).tobytes())], columns=["bucket", "docs", "counts", "keys"])
    blocks = pa.RecordBatch.from_pandas(passages._blocks(rows))
    pairs = [p for b in passages._crossed(iter([blocks])) for p in zip(*[c.to_pylist() for c in b.columns])]
    assert sorted(pairs) == sorted([(i, j) for j in range(23) for i in range(j)] + [(0, 1), (0, 2), (1, 2)])


def _kinds(regions, docs):
    rows = [(0, 0, 0, k, min(d), max(d), r.astype(np.uint32).tobytes(), passages._region_anchors(r, k).astype(np.int32).tobytes()) for k, (r, d) in enumerate(zip(regions, docs))]
    types = [pa.int32()] * 3 + [pa.int64()] * 3 + [pa.binary()] * 2
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=["a", "b", "tile", "kind", "lo", "hi", "tokens", "at"])


def test_passages_of_families_are_those_of_all_pairs(spark, monkeypatch):
    """What is left out because a longer passage is known changes nothing; a pair with one minimum in common is compared."""
    rng = np.random.default_rng(5)
    token = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    families, regions = [token(300) for _ in range(4)], []
    for k in range(60):
        base = families[k % 4].copy()
        for at in rng.integers(0, 300, 3):
            base[at : at + 5] = 0
        start = int(rng.integers(0, 100))
        regions.append(np.concatenate((families[(k + 1) % 4][200 : 200 + 60 * (k % 3 == 0)], base[start : start + 150])))
    docs = [[k] if k % 7 else [k, k + 500] for k in range(60)]
    spans = {}
    for r in passages._match(_kinds(regions, docs)).to_pylist():
        for c in docs[r["kind"]]:
            later, others = spans.setdefault(c, (set(), set()))
            if r["lo"] < c:
                later.add((r["start"], r["end"], r["lo"]))
            if r["hi"] > c:
                others.add((r["start"], r["end"], c))
    filled = lambda x, k: np.where(x == 0, (1 << 63) + 1000 * k + np.arange(len(x), dtype=np.uint64), x)
    key = [set(r[passages._region_anchors(r, k)].tolist()) for k, r in enumerate(regions)]
    whole = {}
    for c in range(60):
        for d in range(60):
            if not key[c] & key[d]:
                continue
            first, second = max((c, d), key=lambda k: (min(docs[k]), k)), min((c, d), key=lambda k: (min(docs[k]), k))
            for i, j, k, m in passages.alike(filled(regions[first], first), filled(regions[second], 100 + second), passages.LEAST):
                i, j = (i, j) if c == first else (k, m)
                for doc in docs[c]:
                    for other in docs[d]:
                        if doc != other:
                            whole.setdefault(doc, (set(), set()))[other > doc].add((i, j, min(doc, other)))
    for doc, (later, others) in whole.items():
        got_later, got_others = (passages._widest(sorted(x)) for x in spans.get(doc, ((), ())))
        want_later, want_others = passages._widest(sorted(later)), passages._widest(sorted(others))
        assert got_later == want_later
        free = lambda x: [s for s in x if not any(a <= s[0] and s[1] <= b for a, b, _ in want_later)]  # noqa: B023, E731
        assert free(got_others) == free(want_others)


def test_regions_with_the_same_passage_are_one_kind():
    """Of texts that have a passage and own words around it, only the passage is compared, once for all."""
    rng = np.random.default_rng(6)
    passage = rng.integers(1, 1 << 62, 80).astype(np.uint64)
    kinds = set()
    for k in range(50):
        own = rng.integers(1, 1 << 62, 200 + k).astype(np.uint64)
        common = np.concatenate((np.zeros(100, bool), np.ones(80, bool), np.zeros(100 + k, bool)))
        ((place, region),) = passages.stretches(np.concatenate((own[:100], passage, own[100:])), common)
        assert place == 100
        kinds.add(passages._kind(region))
    assert len(kinds) == 1


def test_passages_that_overlap_are_removed(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(200)))], DOCS)
    key = docs.select(F.xxhash64("text")).first()[0]
    spans = spark.createDataFrame([(1, 10, 70, 0, True, key), (1, 68, 150, 0, True, key), (1, 150, 200, 0, True, key), (1, 0, 9, 0, True, key + 1)], passages.SPANS)
    assert passages.remove(docs, spans).collect()[0]["text"].split() == [f"w{i}" for i in range(10)]


# ---- 4


def test_packing(spark):
    rows = corpus() + [(700, "long " * 5000), (701, "<|endoftext|> a\n\n  b \n c"), (702, "a <|endoftext|><|endoftext|>  b"), *((710 + i, f"a{c}b {c}{c} c{c}") for i, c in enumerate(map(chr, [9, 11, 28, 31, 133, 160, 0x1680, 0x2003, 0x2028, 0x200B, 0x3000, 0xFEFF])))]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), BYTE_BPE).collect()
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: bpe.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    counts = [len(ids[i]) for i, _ in rows]
    assert sum(r["length"] for r in got) == sum(counts)
    assert len(sequences) <= -(-sum(counts) // 1024) + 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS), BYTE_BPE).count() == 0


def test_sum_of_squares_takes_the_cheapest_gap():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 30, 300)
    bins, offsets = packing.sum_of_squares(lengths, 32)
    left: list[int] = []
    for s, b, offset in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        counts = np.bincount([g for g in left if g], minlength=33)
        fits = sorted({g for g in left if g >= s})
        if not fits:
            assert b == len(left) and offset == 0
            left.append(32 - s)
            continue

        def cost(g):
            after = counts.copy()
            after[g] -= 1
            after[g - s] += g > s
            return (after**2).sum()

        assert left[b] == min(fits, key=lambda g: (cost(g), g)) and offset == 32 - left[b]
        left[b] -= s


# ---- 3


def test_fingerprints(spark):
    rows = [r for r in corpus() if r[0] != 100]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, DOCS)).collect()}
    order = sorted(rows, reverse=True)
    off = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        case = lambda t: {tuple(split(t)[j : j + 5]) for j in range(max(1, len(split(t)) - 4))} if split(t) else set()
        for other, name in ((edited, "near_edited"), (after, "near_next")):
            a, b = case(text), case(other)
            off.append(got[i][name] - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(off)) < 0.02 and np.abs(off).max() < 0.2
    assert got[200 + 1]["fingerprint"] and got[900]["fingerprint"] == got[901]["fingerprint"] == ""
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t or "", got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert fingerprints.fingerprint_documents(spark.createDataFrame([], DOCS)).count() == 0
    twice = fingerprints.fingerprint_documents(spark.createDataFrame([(None, "a b c"), (1, "a"), (1, "b")], DOCS))
    assert twice.count() == 3


# ---- 7


def test_line_rules(spark):
    good = "This is a plain sentence of several words that says something. " * 8
    menu = "\n".join("Home | News | About | Contact" for _ in range(30))
    rows = [(1, good), (2, menu), (3, None), (4, ""), (5, "a b c " * 40), (6, good + "\n" + good + "\nx y\n\n"), (7, " ".join(f"u{i}" for i in range(60)))]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], DOCS + ", kept int")
    got = {r["doc_id"]: r for r in line_rules.judge(docs).collect()}
    for i, t in rows:
        w = split(t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {p for k, x in enumerate(windows) if windows.count(x) > 1 for p in range(k, k + 3)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        assert got[i]["n_words"] == len(w) and got[i]["word_chars"] == sum(map(len, w))
        assert got[i]["n_repeat_words"] == len(again) and got[i]["n_dup_lines"] == len(lines) - len(set(lines))
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    assert [got[i]["kept"] for i in (2, 3, 4, 5, 7)] == [False, False, False, False, True]
    assert line_rules.judge(spark.createDataFrame([], DOCS)).count() == 0


# ---- 2


def test_url_rules(spark):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    given = [
        ("https://a.COM/x?y", "a.com", "/x", "com/", "allow"),
        ("http://m.example.com/en/5#t", "m.example.com", "/en/5", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("ftp://b.net/es/1?q=http://c.com/", "b.net", "/es/1", "net/es/", "block"),
        ("https://a.com", "a.com", "", None, None),
        ("no scheme.com/en", "", "", None, None),
        (None, "", "", None, None),
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, (u, *_) in enumerate(given)] * 2, "page_id long, url string, host string")
    got = urls.judge(pages, rules).collect()
    assert len(got) == 2 * len(given)
    for r in got:
        _, host, path, rule, verdict = given[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_url_trees_learn(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        bad = i % 2
        url = f"http://{'x-' * (3 * bad)}site{i}.org/{'/'.join(str(rng.randint(0, 99999)) for _ in range(1 + 4 * bad))}"
        rows.append((url, bad))
    df = spark.createDataFrame(rows, "_url string, label int").select("_url", *[c.alias(n) for c, n in zip(urls.split_url(__import__("pyspark").sql.functions.col("_url")), ("host", "path"))], "label")
    scored = urls.score(df.where("_url like '%0.org%'"), urls.fit(df.where("_url not like '%0.org%'"))).collect()
    assert np.mean([(r["block_score"] >= 0.5) == bool(r["label"]) for r in scored]) > 0.95


# ---- 1, 6


def test_toxicity_finds_misspellings(spark):
    rng = random.Random(4)
    plain, toxic = [f"{rng.choice('abcdefg')}{rng.choice('lmnop')}{rng.choice('aeiou')}{i}" for i in range(150)], ["horridword", "nastyterm", "vileslur"]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(8, 60))]
        if i % 3 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(toxic)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i, _, _ in rows if i % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(rows[i][2]) for i in held]) > 0.95
    odd = spark.createDataFrame([(1, None, 1.5), (2, "", 1.5), (3, " ".join(plain[:20]) + " horidword", 1.5), (4, " ".join(plain[:20]), 1.5)], DOCS + ", score double")
    out = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert out[3] > out[4] and 0 <= out[1] == out[2] <= 1
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs.limit(2), nothing).count() == 2


def test_language_id(spark):
    rng = random.Random(6)
    sound = {"aa": ["ba", "lo", "mi"], "bb": ["schra", "ung", "keit"], "cc": ["élo", "ñi", "ção"]}
    rows = [(i, " ".join("".join(rng.choice(sound[lang]) for _ in range(3)) for _ in range(rng.randint(3, 60))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    docs = spark.createDataFrame(rows + [(900, "xyz", None)], DOCS + ", lang string")
    model = language_id.fit(docs.where("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    odd = spark.createDataFrame([(1, None, "u"), (2, "12 - 3", "u"), (3, "q", "u"), (4, "", "u")], DOCS + ", score string")
    out = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 4)] == ["und"] * 3 and out[3]["lang_pred"] in sound
    empty = language_id.fit(spark.createDataFrame([], DOCS + ", lang string"))
    assert {r["lang_pred"] for r in language_id.predict(odd, empty).collect()} == {"und"}


def test_kneser_ney_against_the_definition(spark):
    texts = ["ab ab abc", "abc bca", "b a"]
    model = language_id.kneser_ney(language_id.count_grams(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"), 2), 2)
    from collections import Counter

    pairs = Counter()
    for t in texts:
        codes = [int(c) for c in language_id.fold(t)]
        pairs.update(zip(codes, codes[1:]))
    one, two = (sum(n == k for n in pairs.values()) for k in (1, 2))
    d2 = one / (one + 2 * two) if one * two else 0.5
    ends = Counter(b for _, b in pairs)
    one, two = (sum(n == k for n in ends.values()) for k in (1, 2))
    d1 = one / (one + 2 * two) if one * two else 0.5
    letters = len(ends)
    p1 = lambda b: max(ends[b] - d1, 0) / sum(ends.values()) + d1 * letters / sum(ends.values()) / (letters + 1)
    table, values = model.probability[2]
    for (a, b), n in pairs.items():
        total = sum(k for (x, _), k in pairs.items() if x == a)
        kinds = sum(x == a for x, _ in pairs)
        want = max(n - d2, 0) / total + d2 * kinds / total * p1(b)
        slot = language_id.hash_key(np.array([a << 16 | b], dtype=np.uint64), 2)[0]
        assert values[np.searchsorted(table, slot), 0] == pytest.approx(np.log(want), rel=1e-5)


def test_language_limits_are_measured_on_every_row(spark):
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(40)]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(8, 15))), "aa") for _ in range(5000)]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("fold", (F.length("text") % 2).cast("int"))
    counts = language_id.count_grams(docs)
    models = [language_id.kneser_ney(counts)] * 2
    pieces = language_id._pieces(docs, models).where("band = 2048").count(), language_id._pieces(docs, models).groupBy().agg(F.sum("n")).first()[0]
    wholes = language_id._pieces(docs.select(F.substring("text", 1, 2).alias("text"), "lang", "fold"), models).groupBy().agg(F.sum("n")).first()[0]
    assert pieces[0] == 0 and pieces[1] > 10 * len(rows) and wholes == len(rows)
    seen: list[int] = []
    limits = language_id._limits
    try:
        language_id._limits = lambda p: seen.append(p.groupBy().agg(F.sum("n")).first()[0]) or limits(p)
        assert language_id.fit(docs.drop("fold")).usual["aa"]
    finally:
        language_id._limits = limits
    assert seen[0] > 10 * len(rows)  # a sample of 3,000 rows gave at most a fifth of that


def test_language_rejection_by_length(spark):
    rng = random.Random(14)
    sound = {"aa": ["ba", "lo", "mi", "tan", "re", "su"], "bb": ["schra", "ung", "keit", "ver", "ich", "ten"]}
    text = lambda kind, n: " ".join("".join(rng.choice(kind) for _ in range(rng.randint(1, 3))) for _ in range(n))
    docs = spark.createDataFrame([(i, text(sound[lang], rng.randint(20, 200)), lang) for i, lang in enumerate(["aa", "bb"] * 400)], DOCS + ", lang string")
    model = language_id.fit(docs)
    clean = [(i, text(sound["aa" if i % 2 else "bb"], 1 + i % 12)) for i in range(400)]
    letters = [chr(c) for c in range(0x3B1, 0x3C9)]
    odd = [(1000 + i, text(letters, 4 * (3 + i % 40))) for i in range(100)]
    odd += [(1100 + i, text("qwxzjkvpyfgd", 4 * (3 + i % 40))) for i in range(100)]
    odd += [(1200 + i, text(["zyk", "owo", "prz", "dzj", "wsk"], 4 + i % 40)) for i in range(100)]
    got = language_id.predict(spark.createDataFrame(clean + odd, DOCS), model).select("doc_id", language_id.rejected().alias("gone"))
    gone = {r["doc_id"] for r in got.collect() if r["gone"]}
    assert len([i for i in gone if i < 1000]) <= 8
    assert not {i for i, _ in odd} - gone


def test_language_models_keep_every_ngram_apart(spark):
    rng = random.Random(12)
    texts = ["".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(500)) for _ in range(80)]
    model = language_id.kneser_ney(language_id.count_grams(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")))
    for order in (4, 3):
        seen = set(np.concatenate([language_id.grams(language_id.fold(t), order) for t in texts]).tolist())
        table, values = model.probability[order]
        assert len(table) == len(values) == len(seen) > 39_000
        other = np.array([(0x41 << 48 | k) & ((1 << (16 * order)) - 1) for k in range(1 << 20, 2 << 20)], dtype=np.uint64)
        assert not np.isin(language_id.hash_key(other[~np.isin(other, np.array(sorted(seen), np.uint64))], order), table).any()


# ---- 8


def test_nbest_against_all_segmentations():
    lattice = nbest.Lattice(PIECES, 4)

    def every(chunk):
        out = []

        def go(at, score, ids, starts):
            if at == len(chunk):
                out.append((score, starts[::-1], ids))
                return
            for end in range(at + 1, len(chunk) + 1):
                piece = chunk[at:end]
                if piece in lattice.ids:
                    go(end, score + lattice.scores[piece], [*ids, lattice.ids[piece]], [*starts, at])
                elif end == at + 1:
                    go(end, score + lattice.unknown_score, [*ids, *lattice.unknown(piece)], [*starts, at])

        go(0, 0.0, [], [])
        return [(x[0], x[2]) for x in sorted(out, key=lambda x: (-x[0], x[1]))]

    for chunk in ["▁hello", "▁thing日x,", "▁▁a", "▁", "▁ñoeza", "▁aaaa", "xxxxxxxxxx", "ababababab", "--------", "▁The--==--"]:
        best = every(chunk)
        assert [(best[0][0] - lost, ids.tolist()) for lost, ids in lattice.search(chunk)] == best[:4]
        score, ids, lost = lattice[chunk]
        assert (score, np.frombuffer(ids, np.int32).tolist()) == best[0] and (len(best) < 2 or score - lost == best[1][0])
    text = "the cat, saté"
    best = every("▁" + text.replace(" ", "▁"))
    _, score, others = lattice.nbest(text)
    assert [score, *(s for s, _ in others)] == [s for s, _ in best[:4]]
    # of equal changes in two chunks, the one in the first chunk comes first
    _, _, others = nbest.Lattice(PIECES, 3).nbest("saté b saté")
    assert [[e[0] for e in edits] for _, edits in others][0][0] == 0 and others[0][0] == others[1][0]


def test_nbest_of_long_chunks_is_linear():
    for text in ("x" * 100_000, "日本語" * 30_000, "".join(random.Random(1).choices("abcdef0123456789", k=100_000))):
        lattice = nbest.Lattice(PIECES, 3)
        ids, score, others = lattice.nbest(text)
        assert lattice.restore(np.frombuffer(ids, np.int32).tolist()) == text
        assert len(others) == (0 if "日" in text else 2) and all(s <= score for s, _ in others)


def test_nbest_keeps_what_comes_again(monkeypatch):
    """Few chunks are kept, those that come again among them, and the results are those of any cache."""
    assert 2 * nbest._CACHE_CHUNKS <= 150_000
    text = " ".join(f"saté w{i}x" for i in range(400))
    want = nbest.Lattice(PIECES, 3).nbest(text)
    monkeypatch.setattr(nbest, "_CACHE_CHUNKS", 20)
    lattice, read = nbest.Lattice(PIECES, 3), []
    forward = lattice.forward
    monkeypatch.setattr(lattice, "forward", lambda chunk: read.append(chunk) or forward(chunk))
    assert lattice.nbest(text) == want
    assert read.count(nbest.SPACE + "saté") <= 3 and len(lattice) + len(lattice.before) <= 40


def test_nbest_round_trip(spark):
    rows = corpus() + [(800, "  two  spaces\n\nand ▁ sign"), (801, "x" * 3000)]
    docs = spark.createDataFrame(rows, DOCS)
    found = nbest.encode(docs, PIECES, 3)
    back = {r[0]: r[1] for r in nbest.decode(found, PIECES).collect()}
    for i, t in rows:
        assert back[i] == (t or "").replace("▁", " ")
    for i, ok in {r[0]: r[1] for r in found.select("doc_id", "restored").collect()}.items():
        assert ok == (i != 800)
    for r in found.where("doc_id < 20").collect():
        scores = [r["score"], *(o["score"] for o in r["others"])]
        assert scores == sorted(scores, reverse=True)
        for o in r["others"]:
            ids = list(r["ids"])
            for e in sorted(o["edits"], key=lambda e: -e["at"]):
                ids[e["at"] : e["at"] + e["drop"]] = e["put"]
            model = nbest.Lattice(PIECES, 1).model
            assert ids != list(r["ids"]) and model.decode(ids) == model.decode(list(r["ids"]))
            assert sum(model.get_score(k) for k in ids) == pytest.approx(o["score"])
    assert nbest.encode(spark.createDataFrame([], DOCS), PIECES).count() == 0


# ---- 9


def page(body, tail="</body></html>"):
    return f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body>{body}{tail}'


def test_html_extraction(spark):
    article = lambda k: f"<article><h1>Title {k}</h1><p>One &amp; <b>tw</b>o<br>  {k}\n x</p><aside>see also</aside><ul><li>a</li><li>b</li></ul><div class='share-buttons'>Share</div></article>"
    rows = [(k, f"https://h.org/{k}", page(f"<header>Site</header><nav><ul><li>m</li></ul></nav><div class=\"ad\">Buy</div>{article(k)}<section id=comments><p>me too</p></section><form>f</form><footer>&copy;</footer>")) for k in range(5)]
    rows += [(10, None, page("<div class='sidebar'>s</div><div id=content><p>Only <i>div</i>s<p>here</div>", "")), (11, "https://x.org/", None), (12, "https://x.org/", ""), (13, "bad", "plain text")]
    rows += [(20 + k, f"https://c.org/{k}", page(f"<div class=wrap><p>Always the same</p><div class=content><p>Text {k}</p></div></div>")) for k in range(4)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, root string")).collect()}
    for k in range(5):
        assert got[k] == f"Title {k}\nOne & two {k} x\na\nb"
    assert got[10] == "Only divs\nhere" and got[11] == got[12] == "" and got[13] == "plain text"
    assert [got[20 + k] for k in range(4)] == [f"Text {k}" for k in range(4)]
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_of_a_large_host(spark, monkeypatch):
    """Many streams of one host, aligned as a tree; constants of the template are told by their slot, whatever its class."""
    monkeypatch.setattr(wrappers, "FAN_IN", 4)
    rng = random.Random(3)
    rows = []
    for k in range(60):
        body = "".join(f"<{t}>{t} {k} {i}</{t}>" for i in range(rng.randint(1, 6)) for t in [rng.choice(["p", "h2", "blockquote"])])
        rows.append((k, f"https://big.org/{k}", page(f'<div class=x><p>Same on all</p></div><div class=y id="post-{k}">{body}</div><div class=z><p>The end</p></div>')))
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, _, html in rows:
        want = re.findall(r"<(?:p|h2|blockquote)>((?:p|h2|blockquote) \d+ \d+)<", html)
        assert got[k] == "\n".join(want)
    assert wrappers.wrappers_of(spark.createDataFrame([("h", r[2]) for r in rows], "host string, html string")).count() == 1


def test_wrapper_slots_match_pages():
    m = wrappers.Matcher(["h", "(a b)+", "p+", "x?", "f"])
    assert [path for path, _ in m.slots] == ["h", "a", "b", "p", "x", "f"]
    assert m.match([(t, "") for t in ["h", "a", "b", "a", "b", "p", "p", "f"]]) == [0, 1, 2, 1, 2, 3, 3, 5]
    assert m.match([(t, "") for t in ["q", "p", "x", "f", "h"]]) == [-1, 3, 4, 5, 0]
    twice = wrappers.Matcher(["p", "d", "p"])
    assert twice.match([(t, "") for t in ["p", "d", "p"]]) == [0, 1, 2] and twice.match([("p", ""), ("p", "")]) == [0, 2]


def test_wrappers_align():
    assert wrappers.fold(["a", "b", "b", "b", "c", "d", "c", "d"]) == ["a", "b+", "(c d)+"]
    assert wrappers.align(["h", "p", "f"], ["h", "p+", "x", "f"]) == ["h", "p+", "x?", "f"]
