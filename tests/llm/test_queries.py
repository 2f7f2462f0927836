"""The registered queries on small tables: columns, types, held-out rows."""

import zlib

import pytest

from loomlog.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op3_document_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op4_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op5_substring_dedup": "doc_id bigint",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_sentencepiece_nbest": "doc_id bigint, restored boolean",
    "op9_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op10_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op11_merkle_dataset_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op12_personal_data": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op13_hard_negative_mining": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    for column in COLUMNS[name].split(", "):
        column, kind = column.split()
        assert types[column] == kind, column
    rows = df.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    if name in ("op2_url_filters", "op9_html_extraction"):
        assert sorted(r["page_id"] for r in rows) == sorted(r[0] for r in pages.select("page_id").collect())
    elif name == "op4_best_fit_packing":
        assert {r["doc_id"] for r in rows} == {r[0] for r in docs.select("doc_id").collect()}
    elif name not in ("op5_substring_dedup", "op13_hard_negative_mining"):
        assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in docs.select("doc_id").collect())
    if name in ("op1_toxicity", "op6_language_id"):
        divisor, rest = (3, 1) if name == "op1_toxicity" else (4, 2)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor == rest) and 0 <= r["score"] <= 1 for r in rows)
    if name == "op1_toxicity":
        assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    if name == "op6_language_id":
        known = {r[0] for r in docs.where("lang is not null").select("lang").distinct().collect()}
        texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        assert all(r["lang_pred"] in known or not any(c.isalpha() for c in texts[r["doc_id"]] or "") for r in rows)
        truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
        judged = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
        assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in judged) >= 0.9 * len(judged)
    if name == "op8_sentencepiece_nbest":
        assert all(r["restored"] for r in rows)
