"""Raw sources to canonical tables: double-colon text files, literal lines with nested libraries, summaries in CSV."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateworks.operators.joins import validated


def _double_colon(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "::").option("encoding", "ISO-8859-1").option("mode", "FAILFAST").csv(path)


def rating_files(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """users.dat, movies.dat and ratings.dat, Latin-1, parts between double colons."""
    users = _double_colon(spark, f"{folder}/users.dat", "user_id string, gender string, age int, occupation int, zip string")
    items = _double_colon(spark, f"{folder}/movies.dat", "item_id string, title string, genres string")
    ratings = _double_colon(spark, f"{folder}/ratings.dat", "user_id string, item_id string, rating long, timestamp long")
    # A pair of user and item has one rating, so it is the key; no order of lines is needed for it.
    key = F.concat_ws(":", F.lit("rating"), "user_id", "item_id")
    interactions = ratings.select(key.alias("interaction_id"), "user_id", "item_id", F.lit("rating").alias("event_type"), "rating", "timestamp", F.lit(1).cast("tinyint").alias("target_interact"), (F.col("rating") >= 4).cast("tinyint").alias("target_like_ge4"), F.col("rating").alias("target_rating"))
    return {"users": users, "items": items.withColumn("genres", F.split("genres", r"\|")), "interactions": interactions}


def with_summaries(spark: SparkSession, items: DataFrame, path: str) -> DataFrame:
    """items with the summary of each, from a CSV with item_id and summary among its columns; keys must agree one to one."""
    table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select("item_id", "summary")
    return validated(items, table, "item_id", "summary")


def _literals(keep: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for line, text in zip(batch["line"], batch["value"]):
                value = ast.literal_eval(text)
                rows.append((line, *(str(v) if k == "price" and (v := value.get(k)) is not None else value.get(k) for k in keep)))
            yield pd.DataFrame(rows, columns=["line", *keep])

    return run


def literal_lines(spark: SparkSession, path: str, schema: str, keep: tuple[str, ...]) -> DataFrame:
    """Lines that are Python literals (gzip or plain) as columns, and line, which grows with the place in the file."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("line", F.monotonically_increasing_id())
    return lines.mapInPandas(_literals(keep), f"line long, {schema}")


def libraries(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Accounts with nested libraries: of an account's snapshots the one with the most playtime, then the first, stays."""
    schema = "user_id string, items_count int, items array<struct<item_id:string,item_name:string,playtime_forever:bigint,playtime_2weeks:bigint>>"
    rows = literal_lines(spark, path, schema, ("user_id", "items_count", "items"))
    total = F.aggregate(F.coalesce("items", F.array().cast("array<struct<item_id:string,item_name:string,playtime_forever:bigint,playtime_2weeks:bigint>>")), F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["playtime_forever"], F.lit(0).cast("bigint")))
    best = rows.withColumn("total", total).groupBy("user_id").agg(F.min_by(F.struct("items", "items_count", "total", "line"), F.struct(-F.col("total"), F.col("line"))).alias("b"))
    owned = best.select("user_id", "b.line", F.explode("b.items").alias("i"))
    interactions = owned.select(F.concat_ws(":", F.lit("library"), "user_id", F.col("i.item_id")).alias("interaction_id"), "user_id", F.col("i.item_id").alias("item_id"), F.col("i.playtime_forever").alias("playtime"), F.lit(1).cast("tinyint").alias("target_interact"), (F.col("i.playtime_forever") >= 120).cast("tinyint").alias("target_played_ge120"))
    names = owned.where(F.coalesce(F.trim("i.item_name"), F.lit("")) != "").groupBy(F.col("i.item_id").alias("item_id")).agg(F.min_by("i.item_name", "line").alias("title"))
    return {"users": best.select("user_id", "b.items_count", F.col("b.total").alias("playtime")), "items": names, "interactions": interactions}


def item_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, title, genres_json, price): rows without id go, the first line of an id counts; lists are JSON text."""
    rows = literal_lines(spark, path, "id string, title string, app_name string, genres array<string>, price string", ("id", "title", "app_name", "genres", "price"))
    first = rows.where(F.coalesce("id", F.lit("")) != "").groupBy("id").agg(F.min_by(F.struct("title", "app_name", "genres", "price"), "line").alias("m"))
    price = F.regexp_extract(F.coalesce("m.price", F.lit("")), r"(\d+(?:\.\d+)?)", 1)
    return first.select(F.col("id").alias("item_id"), F.coalesce("m.title", "m.app_name").alias("title"), F.to_json("m.genres").alias("genres_json"), F.when(price != "", price.cast("double")).alias("price"))
