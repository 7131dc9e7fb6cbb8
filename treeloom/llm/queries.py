"""The queries of this subpackage, for the driver: name to function (spark, sf_dir), and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import bpe, html, jaccard, licenses, mixing, neighbours, quality, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken to meet the weights, once an epoch."""
    return mixing.with_leaf(mixing.mix(table(spark, sf_dir, "documents"))).select("doc_id", "_leaf.domain", "_leaf.lang", "_leaf.source", "epoch", "n_tokens")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source/language/document."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.licensed(files).select("doc_id", "path", "own_license", "cosine", "is_license_file", "license", "license_from")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, threshold and decision for each document."""
    judged = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "perplexity", "quality_score", "threshold", "keep")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


QUERIES = [op1_html, op2_mixing, op3_bpe, op4_neighbours, op5_licenses, op6_quality, op7_toxicity, op8_warc, op9_topk, op10_jaccard]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.oracle(), "op8_warc": warc.ORACLE, "op9_topk": topk.ORACLE, "op10_jaccard": jaccard.ORACLE}
