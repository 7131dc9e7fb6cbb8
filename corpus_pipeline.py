"""From raw documents to token ids: quality, toxicity, near duplicates, mixture, tokens."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from treeloom.llm import bpe, jaccard, mixing, quality, toxicity
from treeloom.llm.common import free_heaps, fresh_path
from treeloom.session import ship


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/labels.parquet")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return jaccard.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet the target weights, each once at most."""
    return mixing.mix(docs, epochs=1).select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and its text as decoded from them."""
    ship(spark)
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded="decoded")
    return encoded.select("doc_id", "lang", "source", "token_ids", "decoded")


def _roomy(stage: Callable) -> Callable:
    """stage, begun with what the heaps kept from the stage before given back to the system."""

    @functools.wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free_heaps(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [("quality", good), ("toxicity", clean), ("near duplicates", distinct), ("mixture", mixed), ("tokens", tokenized)]
STAGES = [(name, _roomy(stage)) for name, stage in STAGES]

#: Model fitting and set similarity aren't expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
