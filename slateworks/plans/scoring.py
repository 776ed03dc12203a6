"""Queries of the scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateworks.operators import metrics, scorers, splits
from slateworks.plans import shared, sql
from slateworks.plans.registry import query
from slateworks.sources import bindings

_SPLIT = f"WITH {sql.KEPT}, {sql.split(0.7, 0.1, 0.2)}, tr AS (SELECT * FROM split WHERE split = 'train'), te AS (SELECT user_id, item_id, rating FROM split WHERE split = 'test')"
_ROWS = "SELECT te.user_id, te.item_id, round(CAST({score} AS DOUBLE), 9) AS score FROM te"


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = shared.split(spark, sf_dir)
    return rows.where("split = 'train'"), rows.where("split = 'test'").select("user_id", "item_id", "rating")


def _out(df: DataFrame) -> DataFrame:
    return df.select("user_id", "item_id", F.round("score", 9).alias("score"))


@query(f"{_SPLIT}, m AS (SELECT avg(rating) AS s FROM tr) {_ROWS.format(score='m.s')}, m")
def mean_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(scorers.score_global(*_parts(spark, sf_dir), "rating", scorers.mean))


@query(f"{_SPLIT}, m AS (SELECT rating AS s FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) {_ROWS.format(score='m.s')}, m")
def mode_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(scorers.score_global(*_parts(spark, sf_dir), "rating", scorers.mode))


@query(f"{_SPLIT}, m AS (SELECT avg(rating) AS s FROM tr), i AS (SELECT item_id, avg(rating) AS s FROM tr GROUP BY 1) SELECT te.user_id, te.item_id, round(coalesce(i.s, m.s), 9) AS score, i.s IS NOT NULL AS known FROM te LEFT JOIN i USING (item_id), m")
def item_mean_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scorers.score_items(*_parts(spark, sf_dir), "rating", scorers.mean)
    return out.select("user_id", "item_id", F.round("score", 9).alias("score"), "known")


@query(f"{_SPLIT}, m AS (SELECT rating AS s FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), i AS (SELECT item_id, rating AS s FROM (SELECT item_id, rating, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, rating) AS rk FROM tr GROUP BY 1, 2) WHERE rk = 1) SELECT te.user_id, te.item_id, CAST(coalesce(i.s, m.s) AS DOUBLE) AS score FROM te LEFT JOIN i USING (item_id), m")
def item_mode_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(scorers.score_items(*_parts(spark, sf_dir), "rating", scorers.mode))


_HISTORY = "h AS MATERIALIZED (SELECT * FROM (SELECT user_id, item_id, rating, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS rk FROM tr) WHERE rk <= 20)"


def _histories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    train, test = _parts(spark, sf_dir)
    return splits.temporal_position(train), test


@query(f"{_SPLIT}, {_HISTORY} SELECT user_id, item_id FROM h")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorers.history(_histories(spark, sf_dir)[0], 20).select("user_id", "item_id")


@query(f"{_SPLIT}, {_HISTORY}, u AS MATERIALIZED (SELECT user_id, avg(rating) AS s FROM h GROUP BY 1) {_ROWS.format(score='u.s')} LEFT JOIN u USING (user_id)")
def user_mean_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(scorers.score_users(*_histories(spark, sf_dir), "rating", scorers.mean))


@query(f"{_SPLIT}, {_HISTORY}, u AS MATERIALIZED (SELECT user_id, rating AS s FROM (SELECT user_id, rating, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, rating) AS rk FROM h GROUP BY 1, 2) WHERE rk = 1) {_ROWS.format(score='u.s')} LEFT JOIN u USING (user_id)")
def user_mode_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(scorers.score_users(*_histories(spark, sf_dir), "rating", scorers.mode))


@query(f"WITH {sql.alignment()} SELECT split, user_id, item_id, grp, score FROM scored")
def popularity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.scored(spark, sf_dir).select("split", "user_id", "item_id", "grp", "score")


def _evaluated() -> str:
    by_threshold = f"""b AS (SELECT score AS th, count(*) AS n, sum(y) AS p FROM scored WHERE split = 'val' GROUP BY 1), tt AS (SELECT sum(n) AS size, sum(p) AS positives FROM b),
r AS (SELECT th, sum(n) OVER (ORDER BY th DESC) AS pp, sum(p) OVER (ORDER BY th DESC) AS tp FROM b),
v AS (SELECT CAST(NULL AS DOUBLE) AS th, 0.0 AS value UNION ALL SELECT th, {sql.counts('f1', 'size', 'positives', 'pp', 'tp')} FROM r, tt),
best AS (SELECT th FROM v ORDER BY round(value, 12) DESC, th ASC NULLS FIRST LIMIT 1)"""
    return f"WITH {sql.alignment()}, {by_threshold}, q AS (SELECT split, y, CASE WHEN score >= th THEN 1 ELSE 0 END AS prediction FROM scored, best), c AS (SELECT split, CAST(count(*) AS BIGINT) AS size, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(prediction) AS BIGINT) AS predicted, CAST(sum(prediction * y) AS BIGINT) AS true_ FROM q GROUP BY 1) SELECT split, {', '.join(f'round({m}, 9) AS {m}' for m in metrics.METRICS)} FROM (SELECT *, {sql.all_counts()} FROM c)"


@query(_evaluated())
def popularity_threshold_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold that is best on val, applied to val and test."""
    scored = shared.scored(spark, sf_dir)
    best = metrics.best_threshold(scored.where("split = 'val'"), "f1").select("threshold")
    q = scored.crossJoin(F.broadcast(best)).withColumn("prediction", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)).cast("int"))
    out = metrics._metrics(metrics.confusion(q, "split"), "split")
    return out.select("split", *(F.round(m, 9).alias(m) for m in metrics.METRICS))


def neighbours_sql(source: str, users: str = "user_id", n: int = 20) -> str:
    return f"""w AS (SELECT {users} AS u, item_id, CAST(count(*) AS DOUBLE) AS w FROM {source} GROUP BY 1, 2), nm AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
dt AS (SELECT a.item_id, b.item_id AS other, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.u = b.u AND a.item_id <> b.item_id GROUP BY 1, 2),
nb AS (SELECT item_id, other, similarity FROM (SELECT dt.item_id, other, dot / (x.norm * z.norm) AS similarity, row_number() OVER (PARTITION BY dt.item_id ORDER BY round(dot / (x.norm * z.norm), 12) DESC, other) AS rk FROM dt JOIN nm x ON x.item_id = dt.item_id JOIN nm z ON z.item_id = dt.other) WHERE rk <= {n})"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.snapshots(spark, sf_dir).select("user_id", "item_id", "event_id")


@query(f"WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item_id, event_id FROM events), {neighbours_sql('ev')} SELECT item_id, other, round(similarity, 9) AS similarity FROM nb")
def item_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine neighbours where pairs of user and item repeat: counts, not ones."""
    return scorers.neighbours(_events(spark, sf_dir), 20).select("item_id", "other", F.round("similarity", 9).alias("similarity"))


_COLD_EVENTS = f"""WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item_id, event_id FROM events),
warm AS (SELECT * FROM ev WHERE CAST('0x' || substr(md5(user_id), 1, 2) AS INTEGER) % 4 <> 0),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rk FROM ev WHERE CAST('0x' || substr(md5(user_id), 1, 2) AS INTEGER) % 4 = 0),
{neighbours_sql('warm')},
pr AS (SELECT DISTINCT user_id, item_id FROM c WHERE rk <= 5 AND item_id IN (SELECT item_id FROM warm)), sz AS (SELECT user_id, count(*) AS n FROM pr GROUP BY 1),
hit AS (SELECT pr.user_id, nb.other AS item_id, sum(similarity) AS s FROM pr JOIN nb ON nb.item_id = pr.item_id GROUP BY 1, 2),
rw AS (SELECT DISTINCT user_id, item_id FROM c WHERE rk > 5)"""


@query(f"{_COLD_EVENTS} SELECT rw.user_id, rw.item_id, round(coalesce(hit.s / sz.n, 0.0), 9) AS score FROM rw LEFT JOIN hit USING (user_id, item_id) LEFT JOIN sz USING (user_id)")
def cold_item_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    cold = F.conv(F.substring(F.md5("user_id"), 1, 2), 16, 10).cast("int") % 4 == 0
    placed = splits.temporal_position(ev.where(cold), "event_id")
    out = scorers.score_cold_item_knn(ev.where(~cold), placed.where("position < 5"), placed.where("position >= 5").select("user_id", "item_id").distinct())
    return _out(out)
