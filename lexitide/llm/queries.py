"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.llm.common import shared_path, table

BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexitide.llm.embed_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexitide.llm.token_store import read_tokens, stored_keys, write_tokens

    folder = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE))
    read = read_tokens(spark, folder, stored_keys(spark, folder), payload=False)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexitide.llm.suffix_lm import score

    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexitide.llm.word_bpe import encode_and_decode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_and_decode(docs, public_tokenizers.path(WORD_BPE), payload=())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexitide.llm.common import stored
    from lexitide.llm.quality import judge_measured, measure

    measured = measure(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    out = judge_measured(stored(measured, "measured"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexitide.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexitide.llm.secret_scan import BASE, RULES, find_secrets, listing

    kinds = tuple(r.kind for r in RULES)
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    counts = [(F.size("found") - F.size(F.array_remove(F.transform("found", lambda s: s["kind"]), k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listing(base, kinds), 256).alias("base_sha256"), listing(F.col("found"), kinds).alias("spans"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexitide.llm.mixing import calibrate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return calibrate(docs).select("doc_id", "source", "lang", "topic", F.col("tokens").alias("n_tokens"), "weight", "probability", "sampled")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexitide.llm.pii import BASE, find_personal_data

    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexitide.llm.substring import remove_duplicate_passages

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_duplicate_passages(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexitide.llm.license_scan import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexitide.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexitide.llm.token_alignment import cross_align

    found = cross_align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_token_store, op3_suffix_lm, op4_word_bpe, op5_quality_rules, op6_simhash, op7_secret_scan, op8_source_mixing,
        op9_substring_dedup, op10_pii, op11_license_scan, op12_filter_audit, op13_cross_tokenizer,
    )
}
