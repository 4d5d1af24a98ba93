"""A corpus pipeline: language, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last return the
columns of ``documents``. No stage drops a row but by its own decision.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zetasky.llm import bpe, decontam, jaccard, langid, pii
from zetasky.llm.util import read, stash, unstash

#: SQL cannot express the language, personal-data and token stages.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows; texts without a letter go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle similarity 0.8 or more: that with the smallest id."""
    return jaccard.keep_one_of_each(docs, width=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; n_chars follows the new text."""
    found = pii.find_personal_data(docs, keep=tuple(docs.columns))
    text = pii.masked(F.col("kept.text"), F.col("span_list"))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(changed.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of their decoding."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", mask_personal_data),
    ("byte_bpe", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again, and deleted
    when the next one is there."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = stash(stage(spark, docs, sf_dir))
        if before:
            unstash(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
