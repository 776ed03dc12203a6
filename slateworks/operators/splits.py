"""Splits without leakage. A split is a column, not three tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slateworks.functions.hashing import hash_key


def _check(train: float, val: float, test: float) -> None:
    if min(train, val, test) < 0 or abs(train + val + test - 1) > 1e-9:
        raise ValueError("fractions must not be negative and must sum to 1")


def random_fractions(rows: DataFrame, train: float, val: float, test: float, seed: int, group: tuple[str, ...] = ("user_id",), keys: tuple[str, ...] = ("user_id", "item_id"), stratify: tuple[str, ...] = ()) -> DataFrame:
    """rows with split: of each group's n rows, ceil(test n) are test, then ceil(val / (train + val) * rest) are val.

    Within a group the order is by hash of the keys. stratify cuts groups further. The fractions stay doubles, with their
    rounding: n = 10 at 0.7, 0.1, 0.2 gives 2 for val.
    """
    _check(train, val, test)
    parts = Window.partitionBy(*group, *stratify)
    n = F.count(F.lit(1)).over(parts)
    at = F.row_number().over(parts.orderBy(hash_key("split", seed, *keys), *keys))
    n_test = F.ceil(F.lit(float(test)) * n) if test else F.lit(0)
    share = val / (train + val) if train + val else 0.0
    n_val = F.ceil(F.lit(float(share)) * (n - n_test)) if val else F.lit(0)
    return rows.withColumn("_at", at).withColumn("_test", n_test).withColumn("_val", n_val).withColumn("split", F.when(F.col("_at") <= F.col("_test"), "test").when(F.col("_at") <= F.col("_test") + F.col("_val"), "val").otherwise("train")).drop("_at", "_test", "_val")


def temporal_position(rows: DataFrame, time: str = "ts", user: str = "user_id", item: str = "item_id") -> DataFrame:
    """rows with position from 0 in their user's order by time, then by item as text."""
    return rows.withColumn("position", (F.row_number().over(Window.partitionBy(user).orderBy(time, F.col(item).cast("string"))) - 1).cast("long"))


def cold_users(rows: DataFrame, k: int, val: float, test: float, seed: int, time: str = "ts", user: str = "user_id", item: str = "item_id") -> DataFrame:
    """rows with split: train of warm users; of cold users the first k rows are history, the rest val or test.

    round((val + test) n) users are cold, round(val / (val + test) cold) of them for val, halves to even. Cold users without a
    row after the first k are left out. Users are drawn by hash.
    """
    if time not in rows.columns:
        raise ValueError(f"missing columns: {time}")
    if k < 1:
        raise ValueError("k must be positive")
    users = rows.select(user).distinct()
    n = users.count()
    n_cold = round((val + test) * n)
    n_val = round(val / (val + test) * n_cold) if n_cold else 0
    cold = users.orderBy(hash_key("cold", seed, user), user).limit(n_cold)
    chosen = cold.orderBy(hash_key("cold-val", seed + 1, user), user).limit(n_val).withColumn("_role", F.lit("val"))
    roles = cold.join(chosen, user, "left").select(user, F.coalesce("_role", F.lit("test")).alias("_role"))
    placed = temporal_position(rows.join(roles, user), time, user, item)
    placed = placed.withColumn("_last", F.max("position").over(Window.partitionBy(user))).where(F.col("_last") >= k)
    cold_rows = placed.withColumn("split", F.when(F.col("position") < k, "history").otherwise(F.col("_role"))).drop("_role", "_last")
    warm = rows.join(roles, user, "left_anti").withColumn("position", F.lit(None).cast("long")).withColumn("split", F.lit("train"))
    return warm.unionByName(cold_rows)
