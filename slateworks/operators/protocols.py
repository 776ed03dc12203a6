"""What a part must offer to be used in place of one of ours: functions of DataFrames, or objects with these methods."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession


@runtime_checkable
class Filter(Protocol):
    def __call__(self, rows: DataFrame) -> DataFrame:
        """The rows that stay, with all their columns."""


@runtime_checkable
class Splitter(Protocol):
    def __call__(self, rows: DataFrame) -> DataFrame:
        """rows with split: train, val, test or history."""


@runtime_checkable
class CandidateSampler(Protocol):
    def __call__(self, positives: DataFrame, catalog: DataFrame, observed: DataFrame) -> DataFrame:
        """(user_id, chunk, item_id, y)."""


@runtime_checkable
class FeatureBuilder(Protocol):
    def __call__(self, items: DataFrame, train: DataFrame) -> DataFrame:
        """items with columns made from training rows only."""


@runtime_checkable
class TaskBuilder(Protocol):
    def __call__(self, users: DataFrame, items: DataFrame, interactions: DataFrame, config: object) -> object:
        """A task: its rows by split, target, features and manifest."""


@runtime_checkable
class Policy(Protocol):
    def __call__(self, train: DataFrame, users: DataFrame, items: DataFrame, k: int) -> DataFrame:
        """(user_id, item_id, policy, rank)."""


@runtime_checkable
class Scorer(Protocol):
    def __call__(self, train: DataFrame, rows: DataFrame) -> DataFrame:
        """rows with score."""


@runtime_checkable
class GroupMetric(Protocol):
    def __call__(self, rows: DataFrame) -> Column:
        """An aggregate over the rows of a group."""


@runtime_checkable
class Vote(Protocol):
    def __call__(self, votes: DataFrame, score: str, *key: str) -> DataFrame:
        """(key, score): one score for all runs of a key."""


@runtime_checkable
class Adapter(Protocol):
    name: str

    def tables(self, spark: SparkSession, source: str) -> dict[str, DataFrame]:
        """users, items and interactions of a raw source."""
