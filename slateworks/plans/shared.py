"""Relations that many plans start from, built once for a session and folder and written to the shared scratch folder."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateworks.functions.scratch import released, written
from slateworks.operators import filters, scorers, splits, tasks
from slateworks.sources import bindings

_KEPT: dict = {}
CONFIG = tasks.TaskConfig()


def remembered(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """For what consists of written tables already."""

    @functools.wraps(make)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = make.__name__, spark.sparkContext.applicationId, sf_dir
        if key not in _KEPT:
            _KEPT[key] = make(spark, sf_dir)
        return _KEPT[key]

    return get


def shared(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Written once; the shuffle files of its making go before the next table is made."""

    @functools.wraps(make)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = written(make(spark, sf_dir), make.__name__)
        released(spark)
        return out

    return remembered(get)


@shared
def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions of users with ten or more."""
    return filters.min_interactions(bindings.interactions(spark, sf_dir), CONFIG.min_rows)


@shared
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_fractions(kept(spark, sf_dir), CONFIG.train, CONFIG.val, CONFIG.test, CONFIG.seed)


@shared
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment task's held-out candidates with popularity: split, user_id, item_id, grp, y, score."""
    rows = split(spark, sf_dir)
    held = tasks.alignment_candidates(rows, kept(spark, sf_dir), bindings.items(spark, sf_dir), CONFIG)
    group = F.concat_ws(":", "user_id", "split", F.col("chunk").cast("string"))
    return scorers.score_popularity(rows.where("split = 'train'"), held.withColumn("grp", group)).select("split", "user_id", "item_id", "grp", F.col("y").cast("int").alias("y"), "score")
