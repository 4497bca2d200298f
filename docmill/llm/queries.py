"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation, decontamination, embedding_dedup, line_dedup, lm, merkle, minhash, mixing, phrase_dedup, quality, quality_rules, suffix_dedup, toxicity
from .common import table
from .oracles import ORACLES


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_length=1)
    return d.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", "line_dedup.kept_sha256")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lm.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "lm.held_out", "lm.n_tokens", "lm.n_known", "lm.train_tokens", "lm.base_score", "lm.score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), weights=(5, 2, 1), share=1.0, most=3)
    return d.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = phrase_dedup.remove_phrases(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35, keep_text=False)
    return d.select("doc_id", F.col("phrase_dedup.n_units").alias("n_words"), "phrase_dedup.n_removed", "phrase_dedup.kept_sha256")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontamination.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    c = "contamination"
    return d.select("doc_id", f"{c}.n_words", f"{c}.n_hit", f"{c}.n_items", f"{c}.items_sha256", f"{c}.contaminated")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2, threshold_percent=80)
    return d.select("doc_id", "near_dup.n_shingles", "near_dup.component_id", "near_dup.kept")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)
    return d.select("vec_id", "near_vec.n_links", "near_vec.component_id", "near_vec.kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep_text=False)
    return d.select("doc_id", "toxicity.held_out", "toxicity.score", "toxicity.predicted")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=200, keep_text=False)
    return d.select("doc_id", F.col("suffix_dedup.n_units").alias("n_bytes"), "suffix_dedup.n_removed", "suffix_dedup.n_spans", "suffix_dedup.kept_sha256")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", "quality.held_out", "quality.score", "quality.predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tampering of the contract: every row with 7 | crc32(doc_id) claims one character more."""
    docs = table(spark, sf_dir, "documents")
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claims = {"n_chars": F.when(seventh, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))}
    d = merkle.build_manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), group_col="lang", id_col="doc_id", claims=claims, arity=2)
    return d.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_digests(F.col("path")).cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least_words=50, most_repeat_percent=50, most_lost_percent=30, keep_text=False)
    r = [f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost")]
    return d.select("doc_id", *r)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damage of the contract, then its repair; conversations that lost all rows stay in the result."""
    rows, present = conversation.damaged(table(spark, sf_dir, "conversations"))
    return conversation.repair(rows, present=present)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_lm_scoring, op3_mixing, op4_substring_dedup, op5_decontamination, op6_minhash_near_dedup, op7_embedding_near_dedup, op8_toxicity, op9_suffix_array_dedup, op10_quality_classifier, op11_merkle_manifest, op12_quality_rules, op13_conversation_repair)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
