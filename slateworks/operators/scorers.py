"""Scorers: how a user would respond, from training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slateworks.operators.joins import strict
from slateworks.operators.neighbour_lists import neighbours


def popularity(train: DataFrame, target: str = "y") -> DataFrame:
    """(item_id, score): the sum of the target over training rows."""
    return train.groupBy("item_id").agg(F.sum(F.col(target).cast("double")).alias("score"))


def score_popularity(train: DataFrame, rows: DataFrame, target: str = "y") -> DataFrame:
    """rows with score; unseen items have 0."""
    return rows.join(popularity(train, target), "item_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def mode(df: DataFrame, value: str, *group: str) -> DataFrame:
    """score: the most frequent value of each group, the smallest of several; n: rows of the group with a value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    best = counts.groupBy(*group).agg(F.min_by("_v", F.struct(-F.col("_c"), F.col("_v"))).cast("double").alias("score"), F.sum("_c").alias("n"))
    return best


def mean(df: DataFrame, value: str, *group: str) -> DataFrame:
    return df.groupBy(*group).agg(F.avg(value).alias("score"), F.count(value).alias("n"))


def score_global(train: DataFrame, rows: DataFrame, value: str, how) -> DataFrame:
    """rows with the mean or mode of all training rows."""
    return rows.crossJoin(F.broadcast(how(train, value).select("score")))


def score_items(train: DataFrame, rows: DataFrame, value: str, how) -> DataFrame:
    """rows with their item's mean or mode, else that of all training rows; known tells which."""
    default = how(train, value).select(F.col("score").alias("_default"))
    joined = rows.join(how(train, value, "item_id").select("item_id", "score"), "item_id", "left").crossJoin(F.broadcast(default))
    return joined.withColumn("known", F.col("score").isNotNull()).withColumn("score", F.coalesce("score", "_default")).drop("_default")


def history(train: DataFrame, last: int | None, position: str = "position") -> DataFrame:
    """Of each user the last rows by position: all with None, none with 0."""
    if last is None:
        return train
    if last < 0:
        raise ValueError("a history cannot be shorter than nothing")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(position)))
    return train.withColumn("_at", at).where(F.col("_at") <= last).drop("_at")


def score_users(train: DataFrame, rows: DataFrame, value: str, how, last: int | None = 20, position: str = "position") -> DataFrame:
    """rows with the mean or mode of their user's last training rows; ValueError for a user without any."""
    return strict(rows, how(history(train, last, position), value, "user_id").select("user_id", "score"), "user_id")


def score_cold_item_knn(warm: DataFrame, profiles: DataFrame, rows: DataFrame, n: int = 20, total: bool = False) -> DataFrame:
    """rows(user_id, item_id) of cold users with the mean (or sum) over the known items of their profile of its similarity.

    Items that training does not know add nothing; the mean is over known profile items only.
    """
    near = neighbours(warm, n)
    known = profiles.select("user_id", "item_id").distinct().join(warm.select("item_id").distinct(), "item_id", "left_semi")
    sizes = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    hits = known.join(near.withColumnRenamed("item_id", "_seed").withColumnRenamed("other", "_other"), F.col("item_id") == F.col("_seed")).groupBy("user_id", F.col("_other").alias("item_id")).agg(F.sum("similarity").alias("_sum"))
    out = rows.join(hits, ["user_id", "item_id"], "left").join(sizes, "user_id", "left")
    return out.withColumn("score", F.coalesce(F.col("_sum"), F.lit(0.0)) if total else F.coalesce(F.col("_sum") / F.col("_n"), F.lit(0.0))).drop("_sum", "_n")
