"""The driver's tables in the roles of users, items and interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer and part: rating 1 to 5, playtime, liked, and ts, the first order's day in seconds.

    (order, line number) repeats in the source, so rows are aggregated; partial sums go into the shuffle.
    """
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    rows = joined.groupBy(F.col("o_custkey").cast("string").alias("user_id"), F.col("l_partkey").cast("string").alias("item_id")).agg(
        F.ceil(F.max("l_quantity") / 10).cast("long").alias("rating"),
        F.sum("l_quantity").cast("double").alias("playtime"),
        (F.datediff(F.min(F.to_date("o_orderdate")), F.lit("1970-01-01").cast("date")).cast("long") * 86400).alias("ts"),
    )
    return rows.withColumn("liked", (F.col("rating") >= 4).cast("int")).withColumn("y", F.lit(1))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("nation"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as rows of a user's library: item from the JSON text, value as intensity; pairs repeat."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("item_id"), "event_type", "value", "ts")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with their documents: y = quality, score = length, user = source, group = language."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels", "doc_id", "quality").join(docs, "doc_id").select("doc_id", F.col("source").alias("user_id"), F.col("lang").alias("grp"), F.col("quality").cast("int").alias("y"), F.col("n_chars").cast("double").alias("score"))
