"""Queries of the operators, by name, over the whole tables, and SQL for the oracle where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slateworks.llm import bpe, embed_dedup, html_text, mixing, pii, quality, simhash, suffix_dedup, toxicity, url_filter


def op1_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_cross_polytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("runs")


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.filter_urls(url_filter.demonstration_captures(pages), url_filter.demonstration_events(pages))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_cube_mixing, op2_cross_polytope_dedup, op3_line_blocks, op4_byte_bpe, op5_suffix_array_dedup, op6_quality_cascade, op7_feistel_pii, op8_counterfactual_toxicity, op9_temporal_url_filter, op10_simhash_near_dedup)}
ORACLES: dict[str, str] = {"op6_quality_cascade": quality.ORACLE, "op9_temporal_url_filter": url_filter.ORACLE}
