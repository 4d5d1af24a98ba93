"""The queries of the language-data operators, with SQL twins where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, divergence, jaccard, langid, merkle, oracles, pii, quality, secrets, sharding, suffixes, tokens, topk
from .util import leave, read, shared_folder


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(read(spark, sf_dir, "documents"), width=4, percent=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"), length=50)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read(spark, sf_dir, "documents")).drop("span_list")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/zetasky-map-{uuid.uuid4().hex}"
    leave(spark, path)
    start = sharding.initial_map(16)
    sharding.write_map(spark, start, path, 1)
    sharding.write_map(spark, sharding.grow(sharding.read_map(spark, path, 1)), path, 2)
    first, grown = (sharding.read_map(spark, path, version) for version in (1, 2))
    return sharding.assign_shards(read(spark, sf_dir, "documents"), first, grown, version=1)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_jaccard_join, op3_decontamination, op4_suffix_dedup, op5_personal_data, op6_exact_top_k, op7_secret_scan, op8_byte_bpe, op9_language_id, op10_sharding, op11_source_divergence, op12_merkle_manifest, op13_quality_classifier)}
ORACLES: dict[str, str] = {"op2_jaccard_join": oracles.JACCARD, "op4_suffix_dedup": oracles.SUFFIXES, "op6_exact_top_k": topk.ORACLE, "op10_sharding": oracles.SHARDS, "op11_source_divergence": divergence.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
