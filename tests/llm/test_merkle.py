"""The manifest against a plain recursion, over several storeys and odd tables."""

import hashlib
import zlib

import duckdb
import pytest

from loomlog.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
FIELD = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, more=0):
    n = None if row["n_chars"] is None else row["n_chars"] + more
    return H(*[FIELD(v) for v in (row["doc_id"], row["source"], row["lang"], n, row["text"])])


def tree(nodes):
    """The root, and for each node its siblings as (is to the left, digest or nothing)."""
    paths, at, place = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(at) > 1:
        for i, p in enumerate(place):
            paths[i].append((p % 2 == 1, at[p ^ 1] if p ^ 1 < len(at) else ""))
        at, place = [H(*at[i : i + 2]) for i in range(0, len(at), 2)], [p // 2 for p in place]
    return at[0], paths


def brute(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {g: sorted((r for r in rows if r["lang"] == g), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for g in langs}
    trees = {g: tree([leaf(r) for r in of[g]]) for g in langs}
    root, tops = tree([trees[g][0] for g in langs])
    out = []
    for i, g in enumerate(langs):
        for r, path in zip(of[g], trees[g][1]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            h = leaf(r, 1 if hit else 0)
            for left, other in path + tops[i]:
                h = H(other, h) if left else H(h, other)
            out.append((r["doc_id"], leaf(r), trees[g][0], root, H(*[o for _, o in path + tops[i]]), h, h == root))
    return out


KEY = lambda row: tuple(str(v) for v in row)


def made(n):
    """Odd group sizes, a group of one, nulls in every column, an empty and a long text, repeated ids and rows."""
    langs = ["en"] * 5 + ["fr", "de", None, "Ω", "-"]
    rows = [dict(doc_id=i * 3, text=f"text {i}", lang=langs[i % 10], source=f"s{i % 3}", n_chars=6) for i in range(n)]
    rows += [dict(doc_id=10**9, text="alone", lang="one", source=None, n_chars=None), dict(doc_id=None, text=None, lang=None, source=None, n_chars=None)]
    rows += [dict(doc_id=3, text="", lang="en", source="", n_chars=0), dict(doc_id=3, text="é" * 200_000, lang="en", source="s", n_chars=200_000)]
    rows += [dict(doc_id=None, text="again", lang="fr", source="s", n_chars=5)] * 3 + [rows[0]] * 2
    return rows


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_against_a_plain_recursion(spark, bits):
    rows = made(67)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for clash in ("idx", "n", "grp", "node", "root", "proof"):
        df = df.withColumn(clash, df["text"])
    got = [tuple(r) for r in merkle.audit(df, bits).collect()]
    assert sorted(got, key=KEY) == sorted(brute(rows), key=KEY)
    assert any(not g[-1] for g in got) and any(g[-1] for g in got)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_tables(spark, n):
    rows = [dict(doc_id=i, text="x", lang="en", source="s", n_chars=1) for i in range(n)]
    got = [tuple(r) for r in merkle.audit(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == (sorted(brute(rows)) if rows else [])


def test_sql_gives_the_same_rows(spark):
    import pandas as pd

    rows = [r for r in made(40) if r["doc_id"] is not None]
    documents = pd.DataFrame(rows).astype({"n_chars": "Int64"})  # noqa: F841
    want = duckdb.sql(merkle.SQL).fetchall()
    assert sorted(want, key=KEY) == sorted(brute(rows), key=KEY)


def test_proofs_are_whole_and_hold_against_other_rows(spark):
    rows = [dict(doc_id=i, text=f"t{i}", lang="en" if i % 3 else "fr", source="s", n_chars=2) for i in range(20)]
    df = merkle.manifest(merkle.leaves(spark.createDataFrame(rows, SCHEMA)), "lang", "doc_id", "leaf", bits=2)
    out = df.withColumn("own", merkle.folded(df["leaf"], df["proof"])).withColumn("other", merkle.folded(merkle.digest(df["doc_id"]), df["proof"])).collect()
    assert len(out) == 20 and {r["own"] for r in out} == {out[0]["root"]} and all(r["other"] != r["root"] for r in out)
    assert sorted(r["idx"] for r in out if r["lang"] == "fr") == list(range(7))
