"""A corpus pipeline: documents of a known language, without exact and near copies, mixed to target shares, as token ids.

Each stage works on all that its predecessor kept. Stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import bpe, chosen_path, exact_dedup, lang_id, mixing
from tickloom.llm.common import shared_dir, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models know; those they reject go."""
    return lang_id.accepted(docs, lang_id.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest doc_id."""
    return exact_dedup.distinct_rows(docs, exact_dedup.DigestIndex(spark, shared_dir(spark, "digest-index")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more; rows with a null id stay."""
    return chosen_path.distinct_rows(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate says."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and a digest of the text that the ids decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("bpe", encode_tokens),
]

#: SQL can express neither the language models nor the fitted rates; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
