"""The corpus pipeline: documents are judged, deduplicated, mixed and encoded, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import bpe_index, exact_dedup, mixing, ngram_join, quality_crf
from leadloom.sources.tables import materialize


def accept_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field accepts; it learns from the labels of the folder."""
    return quality_crf.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar shingles connect."""
    return ngram_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and what they decode to."""
    return bpe_index.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", accept_good), ("exact dedup", drop_exact_copies), ("n-gram Jaccard join", drop_near_copies),
    ("source mix", mix_sources), ("BPE encoding and decoding", encode),
]

#: A learned field, similarity classes and token merges are not for SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
