"""A corpus from raw documents: toxic ones go, near-duplicates go, personal data become pseudonyms, sources are mixed, texts encoded.

Each stage works on all rows that the one before it kept. In all of them rows with a null in any column, empty and very long
texts, repeated rows and further columns are taken as they are; an empty table goes through as an empty table.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slateworks.functions.scratch import delete, shared_root
from slateworks.llm import bpe, mixing, pii, simhash, toxicity


#: The session's setting that holds the secret of the pseudonyms; without it they are those of a published demonstration key.
KEY_SETTING = "spark.slateworks.pii.key"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null and empty texts stay, and all rows where labels teach nothing."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; null and empty texts are one group."""
    return simhash.keep_one(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in their texts, under the key in KEY_SETTING; null texts stay null."""
    key = spark.conf.get(KEY_SETTING, None)
    return pii.with_pseudonyms(docs, key.encode() if key else pii.DEFAULT_KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them, 0 to 2; a null source is a source."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and checksums of each row; a null text is encoded as an empty one."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can express neither the classifier's fit nor the cube method; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read by the next.

    A stage's result goes once the next one's is written, the last one's when the driver ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_root(spark)}/corpus-pipeline-{uuid.uuid4().hex}"

    def remove(path: str) -> None:
        with contextlib.suppress(Exception):
            delete(spark, path)

    atexit.register(remove, root)
    before = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(before)
        before = path
    return docs
