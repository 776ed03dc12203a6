"""Filters over users and interactions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slateworks.functions.hashing import hash_key


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, if it has all the columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def prefixed(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """All columns but the key renamed with the prefix."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c != key})


def min_interactions(interactions: DataFrame, least: int, user: str = "user_id") -> DataFrame:
    """Interactions of users that have at least that many. The count is pre-aggregated, so no user's rows meet in one task."""
    if least < 1:
        raise ValueError("the least number of interactions must be positive")
    enough = interactions.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(user)
    return interactions.join(enough, user, "left_semi")


def sample_users(users: DataFrame, n: int, seed: int, user: str = "user_id") -> DataFrame:
    """n users, the same ones in any row order: those with the smallest hashes."""
    if n < 1:
        raise ValueError("the number of users must be positive")
    return users.select(user).distinct().orderBy(hash_key("users", seed, user), user).limit(n)


def members(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose keys are in keys."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def pipeline(steps: Sequence[Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame], DataFrame]:
    """The filters one after the other."""
    if not steps:
        raise ValueError("a pipeline needs a filter")

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is not null."""
    return df.where(F.col(target).isNotNull())


def first_groups(df: DataFrame, n: int, order: str, *group: str) -> DataFrame:
    """Rows of the n groups that come first by their smallest order."""
    first = df.groupBy(*group).agg(F.min(order).alias("_first")).orderBy("_first", *group).limit(n)
    return df.join(first.select(*group), list(group), "left_semi")


def groups_per_policy(df: DataFrame, total: int, n_policies: int, policy: str, *group: str) -> DataFrame:
    """Rows of max(1, total // n_policies) groups of each policy, in the order of the group's columns."""
    ranked = df.select(policy, *group).distinct().withColumn("_at", F.row_number().over(Window.partitionBy(policy).orderBy(*group)))
    return df.join(ranked.where(F.col("_at") <= max(1, total // n_policies)).drop("_at"), [policy, *group], "left_semi")


def head_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order: a smoke run's cap."""
    return df.orderBy(*order).limit(n)


def nullable_prediction(df: DataFrame, threshold: float | None, score: str = "score") -> DataFrame:
    """df with prediction: score >= threshold, null where there is no score; a null threshold predicts nothing."""
    yes = F.lit(False) if threshold is None else F.col(score) >= threshold
    return df.withColumn("prediction", F.when(F.col(score).isNotNull(), yes.cast("int")))
