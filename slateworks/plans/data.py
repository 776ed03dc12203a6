"""Queries over raw tables: interactions, filters, statistics, duplicates, checked joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateworks.functions.text import format_number, intensity_bucket, split_list
from slateworks.operators import filters, joins, tasks
from slateworks.plans import shared, sql
from slateworks.plans.registry import query
from slateworks.sources import bindings


@query(f"WITH {sql.INTER} SELECT user_id, item_id, rating, playtime, ts, liked, 'R:' || lpad(user_id, 8, '0') || ':' || lpad(item_id, 8, '0') AS interaction_id FROM inter")
def canonical_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.format_string("R:%08d:%08d", F.col("user_id").cast("long"), F.col("item_id").cast("long"))
    return bindings.interactions(spark, sf_dir).select("user_id", "item_id", "rating", "playtime", "ts", "liked", key.alias("interaction_id"))


@query(f"WITH {sql.INTER} SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM inter GROUP BY 1 HAVING count(*) >= 30")
def min_interactions_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.min_interactions(bindings.interactions(spark, sf_dir), 30)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer ORDER BY md5(concat_ws(':', 'users', '7', CAST(c_custkey AS VARCHAR))), 1 LIMIT 100")
def sample_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.sample_users(bindings.users(spark, sf_dir), 100, 7)


@query(f"WITH {sql.INTER}, k AS (SELECT * FROM inter WHERE user_id IN (SELECT user_id FROM inter GROUP BY 1 HAVING count(*) >= 20)), u AS (SELECT DISTINCT user_id FROM k ORDER BY md5(concat_ws(':', 'users', '3', user_id)), user_id LIMIT 50) SELECT user_id, item_id FROM k WHERE user_id IN (SELECT user_id FROM u)")
def filter_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = lambda df: filters.members(df, filters.sample_users(df, 50, 3), "user_id")
    return filters.pipeline([lambda df: filters.min_interactions(df, 20), chosen])(bindings.interactions(spark, sf_dir)).select("user_id", "item_id")


@query(f"WITH {sql.KEPT}, {sql.split(0.7, 0.1, 0.2)} SELECT CAST(p_partkey AS VARCHAR) AS item_id, round(s.mean_rating, 9) AS mean_rating, CAST(coalesce(s.n, 0) AS BIGINT) AS rating_count FROM part LEFT JOIN (SELECT item_id, avg(rating) AS mean_rating, count(rating) AS n FROM split WHERE split = 'train' GROUP BY 1) s ON s.item_id = CAST(p_partkey AS VARCHAR)")
def item_rating_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = shared.split(spark, sf_dir).where("split = 'train'")
    return tasks.with_item_statistics(bindings.items(spark, sf_dir).select("item_id"), train).select("item_id", F.round("mean_rating", 9).alias("mean_rating"), "rating_count")


@query("SELECT user_id, item_id, event_id, value FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item_id, event_id, value, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY value DESC, event_id) AS rk FROM events) WHERE rk = 1")
def snapshot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bindings.snapshots(spark, sf_dir)
    best = rows.groupBy("user_id", "item_id").agg(F.min_by(F.struct("event_id", "value"), F.struct(-F.col("value"), F.col("event_id"))).alias("b"))
    return best.select("user_id", "item_id", "b.event_id", "b.value")


@query("WITH p AS (SELECT user_id, json_extract_string(props, '$.k') AS item_id, count(*) AS n FROM events GROUP BY 1, 2) SELECT CAST(n AS BIGINT) AS copies, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(n) AS BIGINT) AS rows FROM p GROUP BY 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = bindings.snapshots(spark, sf_dir).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("copies"))
    return pairs.groupBy("copies").agg(F.count(F.lit(1)).alias("pairs"), F.sum("copies").alias("rows"))


@query("WITH d AS (SELECT user_id, md5(string_agg(DISTINCT json_extract_string(props, '$.k'), '|' ORDER BY json_extract_string(props, '$.k'))) AS digest FROM events GROUP BY 1), c AS (SELECT digest, count(*) AS n FROM d GROUP BY 1) SELECT CASE WHEN n = 1 THEN 'single' ELSE 'shared' END AS kind, CAST(count(*) AS BIGINT) AS digests, CAST(sum(n) AS BIGINT) AS users FROM c GROUP BY 1")
def snapshot_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.md5(F.concat_ws("|", F.sort_array(F.collect_set("item_id"))))
    counts = bindings.snapshots(spark, sf_dir).groupBy("user_id").agg(digest.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(F.when(F.col("n") == 1, "single").otherwise("shared").alias("kind")).agg(F.count(F.lit(1)).alias("digests"), F.sum("n").alias("users"))


_NAMES = "(SELECT CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE p_name END AS summary FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_partkey % 13 = 0 UNION ALL SELECT 'x' || CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_partkey % 17 = 0)"


@query(f"WITH s AS {_NAMES}, i AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id FROM part), c AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1) SELECT kind, CAST(n AS BIGINT) AS n FROM (SELECT 'missing' AS kind, count(*) AS n FROM i WHERE item_id NOT IN (SELECT item_id FROM c) UNION ALL SELECT 'extra', count(*) FROM c WHERE item_id NOT IN (SELECT item_id FROM i) UNION ALL SELECT 'repeated', count(*) FROM c WHERE n > 1 UNION ALL SELECT 'blank_value', count(*) FROM s WHERE trim(summary) = '' UNION ALL SELECT 'blank_key', count(*) FROM s WHERE trim(item_id) = '')")
def validated_join_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = bindings.table(spark, sf_dir, "part", "p_partkey", "p_name")
    key, k = F.col("p_partkey").cast("string"), F.col("p_partkey")
    s = part.where(k % 11 != 0).select(key.alias("item_id"), F.when(k % 50 == 0, " ").otherwise(F.col("p_name")).alias("summary"))
    s = s.union(part.where(k % 13 == 0).select(key, "p_name")).union(part.where(k % 17 == 0).select(F.concat(F.lit("x"), key), "p_name"))
    return joins.anomalies(bindings.items(spark, sf_dir).select("item_id"), s, "item_id", "summary")


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_brand AS brand, trim(p_name) AS summary FROM part")
def validated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = bindings.items(spark, sf_dir)
    return joins.validated(items.select("item_id", "brand"), items.select("item_id", F.concat(F.lit(" "), "title", F.lit(" ")).alias("summary")), "item_id", "summary")


@query(f"WITH {sql.INTER} SELECT i.user_id, i.item_id, i.rating, c_mktsegment AS user_segment, CAST(c_nationkey AS BIGINT) AS user_nation, p_name AS item_title, p_brand AS item_brand, p_type AS item_type FROM inter i LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = i.user_id LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = i.item_id")
def enriched_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.enrich(bindings.interactions(spark, sf_dir).select("user_id", "item_id", "rating"), bindings.users(spark, sf_dir), bindings.items(spark, sf_dir))


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, round(sum(value), 6) AS total, CAST(count(DISTINCT json_extract_string(props, '$.k')) AS BIGINT) AS items, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def library_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over a nested library: each user's array of structs, folded without exploding it."""
    library = bindings.snapshots(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.struct("item_id", "value")).alias("items"))
    total = F.aggregate("items", F.lit(0.0), lambda s, x: s + x["value"])
    return library.select("user_id", F.round(total, 6).alias("total"), F.size(F.array_distinct(F.transform("items", lambda x: x["item_id"]))).cast("long").alias("items"), F.size("items").cast("long").alias("n"))


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, arg_min(event_type, event_id) AS first_type FROM events GROUP BY 1")
def first_value_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.snapshots(spark, sf_dir).groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"))


@query("SELECT user_id, string_agg(item_id, ',' ORDER BY first) AS items FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item_id, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = bindings.snapshots(spark, sf_dir).groupBy("user_id", "item_id").agg(F.min("event_id").alias("first"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "item_id"))), lambda x: x["item_id"]), ",").alias("items"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE printf('%.2f', p_retailprice) END AS price, CAST(len(list_filter(string_split(p_name, ' '), lambda x: trim(x) <> '')) AS BIGINT) AS words, CASE WHEN p_size <= 0 THEN 'zero' WHEN p_size * 20 < 120 THEN 'low' WHEN p_size * 20 < 600 THEN 'medium' ELSE 'high' END AS bucket FROM part")
def formatted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = bindings.table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").cast("string").alias("item_id"), format_number(F.col("p_retailprice")).alias("price"), F.size(split_list(F.regexp_replace("p_name", " ", ","))).cast("long").alias("words"), intensity_bucket(F.col("p_size") * 20).alias("bucket"))


@query("SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS item_id FROM part EXCEPT SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_quantity >= 49")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = bindings.table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").where("l_quantity >= 49").select(F.col("l_partkey").cast("string").alias("item_id"))
    return bindings.items(spark, sf_dir).select("item_id").distinct().join(bought, "item_id", "left_anti")


@query(f"WITH {sql.INTER} SELECT item_id, CAST(count(*) AS BIGINT) AS n FROM inter GROUP BY 1 ORDER BY n DESC, item_id LIMIT 25")
def top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.interactions(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item_id").limit(25)


@query(f"WITH {sql.INTER}, g AS (SELECT user_id, min(ts) AS first FROM inter GROUP BY 1 ORDER BY 2, 1 LIMIT 20) SELECT user_id, item_id FROM inter WHERE user_id IN (SELECT user_id FROM g)")
def first_candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.first_groups(bindings.interactions(spark, sf_dir), 20, "ts", "user_id").select("user_id", "item_id")

