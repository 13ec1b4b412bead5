"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logvigil.llm import bpe, chunks, dialogue, divergence, embeddings, fingerprints, mixing, oddsketch, packing, pii, sharding, suffixes, toxicity
from logvigil.llm.common import read


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_duplicates(read(spark, sf_dir, "documents"), width=2)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file())


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.remove_passages(read(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.digests(dialogue.repair(read(spark, sf_dir, "conversations")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file()
    return bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1,
    "op2_int8_embedding_neardup": op2,
    "op3_feistel_sharding": op3,
    "op4_scaled_fingerprints": op4,
    "op5_checked_pii": op5,
    "op6_odd_sketch_neardup": op6,
    "op7_pivotal_mixing": op7,
    "op8_bin_completion_packing": op8,
    "op9_gear_chunk_dedup": op9,
    "op10_cnn_toxicity": op10,
    "op11_conversation_repair": op11,
    "op12_speculative_bpe": op12,
    "op13_iceberg_source_audit": op13,
}
