"""Queries that split interactions and make candidate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateworks.functions.scratch import written
from slateworks.operators import candidates, policies, splits, tasks
from slateworks.plans import shared, sql
from slateworks.plans.registry import query
from slateworks.sources import bindings

_SPLIT = f"WITH {sql.KEPT}, {sql.split(0.7, 0.1, 0.2)}"


@query(f"{_SPLIT} SELECT user_id, item_id, split FROM split")
def random_fraction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.split(spark, sf_dir).select("user_id", "item_id", "split")


@query(f"WITH {sql.KEPT}, {sql.split(0.8, 0.0, 0.2, 5, group='user_id, liked')} SELECT user_id, liked, split, CAST(count(*) AS BIGINT) AS n FROM split GROUP BY 1, 2, 3")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.random_fractions(shared.kept(spark, sf_dir), 0.8, 0.0, 0.2, 5, stratify=("liked",))
    return rows.groupBy("user_id", "liked", "split").agg(F.count(F.lit(1)).alias("n"))


_COLD = f"""WITH {sql.KEPT},
u AS (SELECT DISTINCT user_id FROM kept), nc AS (SELECT CAST(round_even(CAST(0.3 AS DOUBLE) * count(*), 0) AS BIGINT) AS n FROM u),
cold AS (SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY md5(concat_ws(':', 'cold', '0', user_id)), user_id) AS rk FROM u) WHERE rk <= (SELECT n FROM nc)),
role AS (SELECT user_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', 'cold-val', '1', user_id)), user_id) <= (SELECT CAST(round_even(CAST({0.1 / (0.1 + 0.2)!r} AS DOUBLE) * n, 0) AS BIGINT) FROM nc) THEN 'val' ELSE 'test' END AS role FROM cold),
placed AS (SELECT kept.*, role, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) - 1 AS position FROM kept JOIN role USING (user_id)),
cs AS (SELECT user_id, item_id, ts, CASE WHEN position < 5 THEN 'history' ELSE role END AS split, CAST(position AS BIGINT) AS position FROM placed WHERE user_id IN (SELECT user_id FROM placed WHERE position >= 5)
  UNION ALL SELECT user_id, item_id, ts, 'train', NULL FROM kept WHERE user_id NOT IN (SELECT user_id FROM cold))"""


@query(f"{_COLD} SELECT user_id, item_id, split, position FROM cs")
def cold_user_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.cold_users(shared.kept(spark, sf_dir), 5, 0.1, 0.2, 0).select("user_id", "item_id", "split", "position")


def _test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.split(spark, sf_dir).where("split = 'test'")


@query(f"{_SPLIT}, {sql.CATALOG}, {sql.chunked('p', '(SELECT user_id, item_id FROM split WHERE split = ' + chr(39) + 'test' + chr(39) + ')', 1, 2)}, {sql.negatives('n', 'p', 'kept', 2, 2, 'single')} SELECT user_id, chunk, item_id, 1 AS y FROM p UNION ALL SELECT user_id, chunk, item_id, 0 FROM n")
def noninteraction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group for each positive, with two items its user never touched."""
    return candidates.non_interactions(_test(spark, sf_dir), bindings.items(spark, sf_dir), shared.kept(spark, sf_dir), 2, 3, 2, "single")


@query(f"WITH {sql.alignment()} SELECT split, user_id, chunk, item_id, y FROM held")
def capped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = shared.scored(spark, sf_dir)
    return scored.select("split", "user_id", F.element_at(F.split("grp", ":"), 3).cast("long").alias("chunk"), "item_id", "y")


@query(f"WITH {sql.alignment()} SELECT CAST(count(*) AS BIGINT) AS shared FROM (SELECT user_id, item_id FROM held WHERE split = 'val' AND y = 0 INTERSECT SELECT user_id, item_id FROM held WHERE split = 'test' AND y = 0)")
def test_excludes_val_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    negative = shared.scored(spark, sf_dir).where("y = 0")
    pairs = lambda name: negative.where(F.col("split") == name).select("user_id", "item_id")
    return pairs("val").intersect(pairs("test")).agg(F.count(F.lit(1)).alias("shared"))


@query(f"{_COLD}, {sql.CATALOG}, {sql.chunked('p', '(SELECT user_id, item_id, position FROM cs WHERE split = ' + chr(39) + 'test' + chr(39) + ')', 5, None, 'position', 2, 1)}, {sql.negatives('n', 'p', '(SELECT * FROM cs WHERE split <> ' + chr(39) + 'train' + chr(39) + ')', 3, 4, 'temporal')} SELECT user_id, chunk, item_id, 1 AS y FROM p UNION ALL SELECT user_id, chunk, item_id, 0 FROM n")
def temporal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cold users' groups in order of time, the first skipped, two kept."""
    rows = written(splits.cold_users(shared.kept(spark, sf_dir), 5, 0.1, 0.2, 0), "cold")
    cold = rows.where("split <> 'train'")
    return candidates.non_interactions(rows.where("split = 'test'"), bindings.items(spark, sf_dir), cold, 3, 20, 4, "temporal", temporal=("position",), max_groups=2, offset=1)


_PREFERENCE = f"""{_SPLIT},
{sql.chunked('p', "(SELECT user_id, item_id FROM split WHERE split = 'test' AND liked = 1)", 2, 6)},
g AS (SELECT user_id, chunk, count(*) * 1 AS need FROM p GROUP BY 1, 2),
o AS (SELECT g.user_id, g.chunk, g.need, s.item_id, row_number() OVER (PARTITION BY g.user_id, g.chunk ORDER BY md5(concat_ws(':', 'preference', '6', g.user_id, CAST(g.chunk AS VARCHAR), s.item_id)), s.item_id) AS rk FROM g JOIN split s ON s.user_id = g.user_id AND s.split = 'test' AND s.liked = 0),
n AS (SELECT * FROM o WHERE rk <= need), f AS (SELECT user_id, chunk FROM n GROUP BY 1, 2, need HAVING count(*) = need),
a AS (SELECT user_id, chunk, item_id, 1 AS y FROM p UNION ALL SELECT user_id, chunk, item_id, 0 FROM n)"""


@query(f"{_PREFERENCE} SELECT a.* FROM a JOIN f USING (user_id, chunk)")
def preference_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.observed_preferences(_test(spark, sf_dir), "liked", 1, 4, 6).select("user_id", "chunk", "item_id", "y")


@query(f"{_SPLIT}, u AS (SELECT DISTINCT user_id FROM split WHERE split <> 'train'), e AS (SELECT user_id FROM u ORDER BY md5(concat_ws(':', 'eval-users', '8', user_id)), user_id LIMIT 40), r AS (SELECT *, row_number() OVER (PARTITION BY split, user_id ORDER BY md5(concat_ws(':', 'eval-rows', '8', user_id, item_id)), item_id) AS rk FROM split WHERE split <> 'train' AND user_id IN (SELECT user_id FROM e)) SELECT split, user_id, item_id FROM r WHERE rk <= 3 UNION ALL SELECT split, user_id, item_id FROM split WHERE split = 'train'")
def post_split_user_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.sample_after_split(shared.split(spark, sf_dir), 40, 3, 8).select("split", "user_id", "item_id")


@query(f"WITH {sql.alignment()} SELECT grp, item_id, CAST(row_number() OVER (PARTITION BY grp ORDER BY md5(concat_ws(':', 'order', '9', grp, item_id)), item_id) AS BIGINT) AS position FROM scored")
def shuffled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.shuffled(shared.scored(spark, sf_dir).select("grp", "item_id"), 9, "grp")


_TASK = f"""WITH {sql.alignment()},
st AS (SELECT item_id, avg(rating) AS mr, count(rating) AS rc FROM split WHERE split = 'train' GROUP BY 1),
b AS (SELECT split, user_id, item_id, CAST(NULL AS VARCHAR) AS candidate_group, 1 AS y, false AS sampled, rating, playtime FROM split WHERE split = 'train'
      UNION ALL SELECT split, user_id, item_id, user_id || ':' || split || ':' || chunk, y, y = 0, NULL, NULL FROM held)
SELECT b.*, c_mktsegment AS user_segment, p_brand AS item_brand, round(st.mr, 9) AS item_mean_rating, CAST(coalesce(st.rc, 0) AS BIGINT) AS item_rating_count
FROM b LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = user_id LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = b.item_id LEFT JOIN st ON st.item_id = b.item_id"""


def _rows(task: tasks.Task, *columns: str) -> DataFrame:
    mean = {"item_mean_rating": F.round("item_mean_rating", 9)} if "item_mean_rating" in task.rows.columns else {}
    return task.rows.withColumns(mean).select(*columns)


@query(_TASK)
def task_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = tasks.alignment(bindings.users(spark, sf_dir), bindings.items(spark, sf_dir), bindings.interactions(spark, sf_dir), shared.CONFIG)
    return _rows(task, "split", "user_id", "item_id", "candidate_group", "y", "sampled", "rating", "playtime", "user_segment", "item_brand", "item_mean_rating", "item_rating_count")


@query(f"{_SPLIT} SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(rating) AS BIGINT) AS total, round(avg(coalesce(mr, 0)), 9) AS mean_stat FROM split LEFT JOIN (SELECT item_id, avg(rating) AS mr FROM split WHERE split = 'train' GROUP BY 1) USING (item_id) GROUP BY 1")
def task_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = tasks.regression(bindings.users(spark, sf_dir), bindings.items(spark, sf_dir), bindings.interactions(spark, sf_dir), shared.CONFIG)
    return task.rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.round(F.avg(F.coalesce("item_mean_rating", F.lit(0.0))), 9).alias("mean_stat"))


@query(
    f"{_SPLIT}"
    + "".join(
        f""",
{sql.chunked('p' + s, f"(SELECT user_id, item_id FROM split WHERE split = '{s}' AND liked = 1)", 5, 0, max_groups=5)},
g{s} AS MATERIALIZED (SELECT user_id, chunk, count(*) * 3 AS need FROM p{s} GROUP BY 1, 2),
n{s} AS MATERIALIZED (SELECT user_id, chunk, item_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id, chunk) AS offered FROM (SELECT g.user_id, g.chunk, g.need, s.item_id, row_number() OVER (PARTITION BY g.user_id, g.chunk ORDER BY md5(concat_ws(':', 'preference', '0', g.user_id, CAST(g.chunk AS VARCHAR), s.item_id)), s.item_id) AS rk FROM g{s} g JOIN split s ON s.user_id = g.user_id AND s.split = '{s}' AND s.liked = 0)) WHERE rk <= need AND offered >= need),
a{s} AS (SELECT '{s}' AS split, user_id, item_id, user_id || ':{s}:' || chunk AS candidate_group, y FROM (SELECT user_id, chunk, item_id, 1 AS y FROM p{s} WHERE (user_id, chunk) IN (SELECT user_id, chunk FROM n{s}) UNION ALL SELECT user_id, chunk, item_id, 0 FROM n{s}))"""
        for s in ("val", "test")
    )
    + " SELECT * FROM aval UNION ALL SELECT * FROM atest UNION ALL SELECT split, user_id, item_id, NULL, 1 FROM split WHERE split = 'train'"
)
def task_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = tasks.preference(bindings.users(spark, sf_dir), bindings.items(spark, sf_dir), bindings.interactions(spark, sf_dir), shared.CONFIG)
    return _rows(task, "split", "user_id", "item_id", "candidate_group", "y")


@query(
    f"{_COLD}, {sql.CATALOG}"
    + "".join(f""", {sql.chunked('p' + s, f"(SELECT user_id, item_id, position FROM cs WHERE split = '{s}')", 5, None, 'position', 5)}, {sql.negatives('n' + s, 'p' + s, "(SELECT * FROM cs WHERE split <> 'train')", 3, 0, 'cold-' + s)}""" for s in ("val", "test"))
    + " SELECT split, user_id, item_id, NULL AS candidate_group, 1 AS y FROM cs WHERE split IN ('train', 'history')"
    + "".join(f" UNION ALL SELECT '{s}', user_id, item_id, user_id || ':{s}:' || chunk, 1 FROM p{s} UNION ALL SELECT '{s}', user_id, item_id, user_id || ':{s}:' || chunk, 0 FROM n{s}" for s in ("val", "test"))
)
def task_cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = tasks.cold_start(bindings.users(spark, sf_dir), bindings.items(spark, sf_dir), bindings.interactions(spark, sf_dir), shared.CONFIG)
    return _rows(task, "split", "user_id", "item_id", "candidate_group", "y")


_DENSE = f"""WITH de AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 30 AS VARCHAR) AS item_id FROM events),
cat AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx, count(*) OVER () AS size FROM (SELECT DISTINCT item_id FROM de)),
op AS (SELECT user_id, CAST(0 AS BIGINT) AS chunk FROM de GROUP BY 1 HAVING count(*) + 2 <= (SELECT count(*) FROM cat))"""


def _dense(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users and the 30 items they meet again and again, so that most have seen nearly all; and the items."""
    rows = bindings.snapshots(spark, sf_dir).select("user_id", (F.col("item_id").cast("long") % 30).cast("string").alias("item_id")).distinct()
    return rows, rows.select("item_id").distinct()


@query(f"{_DENSE}, {sql.negatives('n', 'op', 'de', 1, 5, 'dense', need='2')} SELECT user_id, item_id FROM n")
def dense_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two unseen items of each user who has two, where draws alone rarely find them."""
    rows, items = _dense(spark, sf_dir)
    open_ = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 2 <= items.count())
    groups = open_.select("user_id", F.lit(0).cast("long").alias("chunk"), F.lit(2).alias("need"))
    return candidates.draw_negatives(groups, items, rows, 5, "dense").select("user_id", "item_id")


@query(f"{_DENSE}, us AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS chunk FROM de), {sql.negatives('n', 'us', 'de', 1, 5, 'random-policy', need='4')} SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws(':', 'random-rank', '5', user_id, item_id)), item_id) AS BIGINT) AS rank FROM n")
def policy_random_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four unseen items of each user, or all there are."""
    rows, items = _dense(spark, sf_dir)
    return policies.recommend_random(rows, rows.select("user_id"), items, 4, 5).select("user_id", "item_id", "rank")
