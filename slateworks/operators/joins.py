"""Joins with the rules that evaluation needs: whole enrichment, checked keys, fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateworks.operators.filters import prefixed


def enrich(rows: DataFrame, users: DataFrame, items: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """rows with the features of their user and item, prefixed; rows without a match keep nulls."""
    return rows.join(prefixed(users, user, "user_"), user, "left").join(prefixed(items, item, "item_"), item, "left")


def with_fallback(rows: DataFrame, stats: DataFrame, key: str, value: str, default) -> DataFrame:
    """rows with the value of their key, or the default where the key is unknown."""
    return rows.join(stats.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), default if not isinstance(default, (int, float)) else F.lit(default)))


def strict(rows: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Inner join; ValueError if a key of rows is unknown."""
    unknown = rows.join(stats.select(key), key, "left_anti").select(key).first()
    if unknown is not None:
        raise ValueError(f"unknown {key}: {unknown[0]}")
    return rows.join(stats, key)


def anomalies(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """kind and number of what breaks a 1:1 join: missing, extra and repeated keys, blank values, blank keys."""
    r = right.select(F.trim(key).alias(key), value)
    counts = r.where(F.col(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = left.select(F.col(key), F.lit(1).alias("l")).distinct().join(counts, key, "full_outer")
    keys = both.agg(
        F.count_if(F.col("n").isNull()).alias("missing"),
        F.count_if(F.col("l").isNull()).alias("extra"),
        F.count_if(F.col("n") > 1).alias("repeated"),
    )
    blank = right.agg(F.count_if(F.coalesce(F.trim(value), F.lit("")) == "").alias("blank_value"), F.count_if(F.coalesce(F.trim(key), F.lit("")) == "").alias("blank_key"))
    return keys.crossJoin(blank).unpivot([], ["missing", "extra", "repeated", "blank_value", "blank_key"], "kind", "n")


def validated(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Inner join of two tables whose keys agree one to one; ValueError naming the anomalies otherwise."""
    bad = anomalies(left, right, key, value).where("n > 0").orderBy("kind").collect()
    if bad:
        raise ValueError("; ".join(f"{r['kind']}: {r['n']}" for r in bad))
    return left.join(right.select(F.trim(key).alias(key), F.trim(value).alias(value)), key)
