"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing, each stage over all the one before kept.

All stages but the last return the columns of ``documents``; the last returns the packed pieces. Mixing repeats a document
whose rate is above one, so later rows may share a doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import exact_dedup, language_id, mixing, near_dedup, packing
from quillspark.llm.common import discard, materialize, table, written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Fewer words are remembered than by packing alone: executors still hold what the stages before have left.
    return packing.pack(docs, packing.default_tokenizer(), cache_words=150_000)


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: Near-dedup, mixing and tokenization have no SQL; tests/llm runs every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = set(written())
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(spark, *(p for p in written() if p not in before and p != docs._scratch))
    return STAGES[-1][1](spark, docs, sf_dir)
