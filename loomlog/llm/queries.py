"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, jaccard_join, language_id, line_rules, merkle, nbest, negatives, packing, passages, personal, toxicity, urls, wrappers
from .common import crc_mod, table

#: Overridable by callers; the vocabulary files are never copied into the repository.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


#: The rules of the contract.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 3) != 1)
    model = toxicity.fit(docs.where(~F.col("held_out")).select("doc_id", "text"), labels)
    return toxicity.score(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = language_id.fit(docs.where(~F.col("held_out")).select("text", "lang"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return line_rules.judge(table(spark, sf_dir, "documents")).select(*columns)


def op8_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nbest.encode(table(spark, sf_dir, "documents"), PIECES, n=3)
    ids = F.array_join("ids", " ")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.crc32(ids.cast("binary")).alias("ids_crc32"),
        "score",
        F.col("others.score").alias("other_scores"),
        F.transform("others", lambda o: F.size(o["edits"])).alias("other_edits"),
        "restored",
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(table(spark, sf_dir, "documents"))


def op11_merkle_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a leaf; null fields, empty texts, repeated ids and rows, and an empty table as ``merkle.manifest`` and ``merkle.leaves`` state."""
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base_sha256 are of the rules' spans, ``spans`` has the tagger's too; nulls, empty and repeated rows as ``personal.find`` states."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal.find(docs, personal.fit(docs))
    counts = [personal.count(F.col("ruled"), kind).alias(f"n_{kind}") for kind in personal.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal.listed(F.col("ruled")).cast("binary"), 256).alias("base_sha256"), personal.listed(F.col("found")).alias("spans"))


def op13_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with nulls, vectors of several lengths, repeated ids, ties and an empty table as ``negatives.prepared`` and ``negatives.mine`` state."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(negatives.prepared(rows, label), F.col("id") % 100 == 0)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filters": op2_url_filters,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_sentencepiece_nbest": op8_sentencepiece_nbest,
    "op9_html_extraction": op9_html_extraction,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_merkle_dataset_manifest": op11_merkle_dataset_manifest,
    "op12_personal_data": op12_personal_data,
    "op13_hard_negative_mining": op13_hard_negative_mining,
}
ORACLE_SQL: dict[str, str] = {
    "op7_quality_rules": line_rules.SQL,
    "op11_merkle_dataset_manifest": merkle.SQL,
    "op13_hard_negative_mining": negatives.SQL,
}
