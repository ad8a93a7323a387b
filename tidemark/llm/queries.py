"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, code_compression, decontaminate, jaccard, language_id, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, token_counts, warc, whitening
from . import oracles as oracle
from .common import table

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept host host_docs host_refused".split()
    rules = [x for r in quality_rules.RULES for x in (F.col(f"host_{r}"), F.round(f"{r}_rate", 6).alias(f"{r}_rate"))]
    return rated.select(*columns, *rules)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"), *tokenizer())


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_components(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(table(spark, sf_dir, "documents"), piece_model())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(table(spark, sf_dir, "embeddings"))


def op13_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.digest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_quality_rules,
        op3_warc,
        op4_language_id,
        op5_quality_classifier,
        op6_byte_bpe,
        op7_ngram_jaccard,
        op8_sharding,
        op9_suffix_dedup,
        op10_substring_dedup,
        op11_token_counts,
        op12_whitening,
        op13_code_compression,
    )
}


def oracles() -> dict[str, str]:
    """SQL twins; tokenising, whitening and the two networks have none and are tested against brute force and held-out rows."""
    return {
        "op1_decontaminate": oracle.DECONTAMINATE,
        "op2_quality_rules": quality_rules.ORACLE,
        "op3_warc": oracle.WARC,
        "op7_ngram_jaccard": oracle.JACCARD,
        "op8_sharding": sharding.oracle(SHARDS),
        "op9_suffix_dedup": oracle.BYTES,
        "op10_substring_dedup": oracle.SUBSTRINGS,
        "op13_code_compression": code_compression.oracle(),
    }
