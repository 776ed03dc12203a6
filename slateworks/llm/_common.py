"""Shared by the operators: tables written to the cluster's checkpoint folder, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateworks.functions.scratch import delete as _delete
from slateworks.functions.scratch import shared_root

#: White space that separates words; everything else is part of a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Tables of a known number of small rows have a file for so many rows, but so many files at least.
ROWS_PER_FILE, FEWEST_FILES = 100_000, 8


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python by at most 2 MB at once, so that a worker's memory does not depend on the lengths of texts around.

    The setting is the session's and stays, as results are computed later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


class Scratch:
    """Tables under the shared checkpoint folder: they cut lineage, and a lost executor only costs a re-read.

    drop() deletes a table no longer needed, the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.written = spark, {}, 0
        bounded_batches(spark)
        self.root = f"{shared_root(spark)}/slateworks-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def _close(self) -> None:
        with contextlib.suppress(Exception):
            _delete(self.spark, self.root)

    def cut(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Writes the table and returns a DataFrame that reads it; rows: about how many of a few numbers each, where known.

        Files then follow the rows, not the shuffle partitions: each file written starts processes for its permissions.
        """
        self.written += 1
        if rows is not None:
            df = df.coalesce(max(FEWEST_FILES, rows // ROWS_PER_FILE))
        path = self.tables[name] = f"{self.root}/{name}-{self.written}"
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        if path := self.tables.pop(name, None):
            _delete(self.spark, path)
        self.collect_shuffles()

    def collect_shuffles(self) -> None:
        """Lets Spark's cleaner remove shuffle files of finished steps, which it does when the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def _signature(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b), two long columns; component is the smallest node reachable.

    Alternates large-star and small-star steps, each a pre-aggregated minimum per node and a join, until the edges no
    longer change. The number of rounds grows with the logarithm of the longest chain, and nothing is sent to the driver
    but one checksum a round. Empty edges give an empty result; loops and repeated edges have no effect.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = scratch.cut(pairs.distinct(), "cc-start")
    before, name = _signature(current), "cc-start"
    for step in range(rounds if before[0] else 0):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down)
        fresh = scratch.cut(small.distinct(), f"cc-{step}", before[0])
        scratch.drop(name)
        after, name, current = _signature(fresh), f"cc-{step}", fresh
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("connected components did not settle")
    stars = current.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").union(stars.select("component", "component").distinct())
