"""Queries of the metrics, over the alignment task's scored candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateworks.operators import metrics
from slateworks.operators.responses import coverage, with_failures_as_no
from slateworks.plans import shared, sql
from slateworks.plans.registry import query
from slateworks.sources import bindings

_BASE = f"WITH {sql.alignment()}"
_TEST = f"{_BASE}, t AS (SELECT * FROM scored WHERE split = 'test'), th AS (SELECT avg(score) AS th FROM t), q AS (SELECT t.*, CASE WHEN score >= th THEN 1 ELSE 0 END AS prediction FROM t, th)"
_COUNT = "CAST(count(*) AS BIGINT) AS size, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(prediction) AS BIGINT) AS predicted, CAST(sum(prediction * y) AS BIGINT) AS true_"
_ROUND = lambda names, suffix="": ", ".join(f"round({n}, 9) AS {n}" for n in names)
_FOUR = _ROUND(metrics.METRICS)
_AVG = ", ".join(f"avg({m}) AS {m}" for m in metrics.METRICS)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.scored(spark, sf_dir).where("split = 'test'")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _test(spark, sf_dir)
    return t.crossJoin(F.broadcast(t.agg(F.avg("score").alias("th")))).withColumn("prediction", (F.col("score") >= F.col("th")).cast("int"))


@query(f"{_TEST}, c AS (SELECT {_COUNT} FROM q) SELECT size, positives, predicted, true_ AS true, {_FOUR} FROM (SELECT *, {sql.all_counts()} FROM c)")
def micro_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.micro(_predicted(spark, sf_dir)))


@query(f"{_TEST}, c AS (SELECT grp, {_COUNT} FROM q GROUP BY 1), m AS (SELECT {sql.all_counts()} FROM c) SELECT CAST(count(*) AS BIGINT) AS groups, {', '.join(f'round(avg({m}), 9) AS {m}' for m in metrics.METRICS)} FROM m")
def macro_group_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.macro_by_group(_predicted(spark, sf_dir), "grp"))


@query(f"{_TEST}, c AS (SELECT user_id, grp, {_COUNT} FROM q GROUP BY 1, 2), m AS (SELECT user_id, {sql.all_counts()} FROM c), u AS (SELECT user_id, {_AVG} FROM m GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS users, {', '.join(f'round(avg({m}), 9) AS {m}' for m in metrics.METRICS)} FROM u")
def user_group_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.macro_by_user(_predicted(spark, sf_dir), "user_id", "grp"))


def _sweep(metric: str) -> str:
    return f"""WITH d AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)),
b AS (SELECT score AS threshold, count(*) AS n, sum(y) AS p FROM d GROUP BY 1), t AS (SELECT count(*) AS size, sum(y) AS positives FROM d),
r AS (SELECT threshold, sum(n) OVER (ORDER BY threshold DESC) AS pp, sum(p) OVER (ORDER BY threshold DESC) AS tp FROM b),
v AS (SELECT CAST(NULL AS DOUBLE) AS threshold, {sql.counts(metric, 'size', 'positives', '0', '0')} AS value FROM t UNION ALL SELECT threshold, {sql.counts(metric, 'size', 'positives', 'pp', 'tp')} FROM r, t)
SELECT threshold, round(value, 9) AS value FROM v ORDER BY round(value, 12) DESC, threshold ASC NULLS FIRST LIMIT 1"""


@query(_sweep("accuracy"))
def best_threshold_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.best_threshold(bindings.labelled(spark, sf_dir), "accuracy"))


@query(_sweep("precision"))
def best_threshold_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.best_threshold(bindings.labelled(spark, sf_dir), "precision"))


@query(_sweep("recall"))
def best_threshold_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.best_threshold(bindings.labelled(spark, sf_dir), "recall"))


@query(_sweep("f1"))
def best_threshold_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.best_threshold(bindings.labelled(spark, sf_dir), "f1"))


@query("WITH d AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)), c AS (SELECT unnest([500.0, 1000.0, 2000.0]) AS th), v AS (SELECT CAST(th AS DOUBLE) AS threshold, avg(CASE WHEN (score >= th) = (y = 1) THEN 1.0 ELSE 0.0 END) AS value FROM d, c GROUP BY 1 UNION ALL SELECT NULL, avg(1.0 - y) FROM d) SELECT threshold, round(value, 9) AS value FROM v ORDER BY round(value, 12) DESC, threshold ASC NULLS FIRST LIMIT 1")
def best_threshold_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    agree = lambda df: F.avg((F.col("prediction") == F.col("y")).cast("double"))
    return _rounded(metrics.best_custom_threshold(bindings.labelled(spark, sf_dir), agree, [None, 500.0, 1000.0, 2000.0]))


def _group_sweep(weight: str) -> str:
    return f"""{_BASE}, d AS (SELECT user_id, grp, y, score FROM scored WHERE split = 'val'),
s AS (SELECT DISTINCT score AS th FROM d), u AS (SELECT user_id, count(DISTINCT grp) AS gs FROM d GROUP BY 1), k AS (SELECT count(*) AS us FROM u), gg AS (SELECT count(DISTINCT grp) AS gn FROM d),
c AS (SELECT th, user_id, grp, count(*) AS size, sum(y) AS positives, sum(CASE WHEN score >= th THEN 1 ELSE 0 END) AS predicted, sum(CASE WHEN score >= th THEN y ELSE 0 END) AS true_ FROM d, s GROUP BY 1, 2, 3),
v AS (SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0 AS value UNION ALL SELECT th, sum({sql.counts('f1', 'size', 'positives', 'predicted', 'true_')} * {weight}) FROM c JOIN u USING (user_id), k, gg GROUP BY 1)
SELECT threshold, round(value, 9) AS value FROM v ORDER BY round(value, 12) DESC, threshold ASC NULLS FIRST LIMIT 1"""


@query(_group_sweep("1.0 / gn"))
def best_group_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.best_group_threshold(shared.scored(spark, sf_dir).where("split = 'val'"), "f1", ("grp",)))


@query(_group_sweep("1.0 / (gs * us)"))
def best_user_group_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.best_group_threshold(shared.scored(spark, sf_dir).where("split = 'val'"), "f1", ("grp",), "user_id"))


def ranking_sql(ks: tuple[int, ...], source: str = "t") -> str:
    """Ranked groups g(user_id, grp, n, positives, ties, hr_k, ndcg_k) of source(user_id, grp, y, score)."""
    table = "CAST([" + ", ".join(repr(x) for x in metrics._discounts(max(ks))) + "] AS DOUBLE[])"
    parts, outer = [], []
    for k in ks:
        slots = f"CAST(greatest(0, least(least({k}, n) - start, t)) AS BIGINT)"
        miss = f"list_reduce(list_prepend(CAST(1.0 AS DOUBLE), list_transform(range({slots}), lambda i: greatest(t - p - i, 0) / CAST(t - i AS DOUBLE))), lambda a, b: a * b)"
        parts.append(f"CASE WHEN {slots} > 0 THEN 1.0 - {miss} ELSE 0.0 END AS h{k}, CASE WHEN {slots} > 0 THEN p / CAST(t AS DOUBLE) * ({table}[start + {slots} + 1] - {table}[start + 1]) ELSE 0.0 END AS w{k}, {table}[least(P_, least({k}, n)) + 1] AS i{k}")
        outer.append(f"max(h{k}) AS hr_{k}, CASE WHEN max(i{k}) = 0 THEN 0.0 ELSE sum(w{k}) / max(i{k}) END AS ndcg_{k}")
    return f"""bl AS (SELECT user_id, grp, score, CAST(count(*) AS BIGINT) AS t, CAST(sum(y) AS BIGINT) AS p FROM {source} GROUP BY 1, 2, 3),
bs AS (SELECT *, CAST(sum(t) OVER (PARTITION BY user_id, grp) AS BIGINT) AS n, CAST(sum(p) OVER (PARTITION BY user_id, grp) AS BIGINT) AS P_, CAST(sum(t) OVER (PARTITION BY user_id, grp ORDER BY score DESC NULLS LAST) - t AS BIGINT) AS start FROM bl),
bv AS (SELECT *, {', '.join(parts)} FROM bs),
g AS (SELECT user_id, grp, max(n) AS n, max(P_) AS positives, bool_or(t > 1) AS ties, {', '.join(outer)} FROM bv GROUP BY 1, 2)"""


_RANKED = f"{_BASE}, t AS (SELECT * FROM scored WHERE split = 'test'), {ranking_sql((1, 5, 10))}"


@query(f"{_RANKED}, u AS (SELECT user_id, avg(hr_5) AS hr_5, avg(ndcg_5) AS ndcg_5 FROM g GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS users, round(avg(hr_5), 9) AS hr_5, round(avg(ndcg_5), 9) AS ndcg_5 FROM u")
def popularity_ranking_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well popularity ranks what users did among what they did not, ties counted as any order."""
    groups = metrics.ranking_by_group(_test(spark, sf_dir), ("user_id", "grp"), (5,))
    return _rounded(metrics.ranking_by_user(groups, "user_id", (5,)))


@query(f"{_RANKED} SELECT user_id, grp, round(hr_1, 9) AS hr_1, round(hr_5, 9) AS hr_5, round(hr_10, 9) AS hr_10 FROM g")
def hit_rate_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = metrics.ranking_by_group(_test(spark, sf_dir), ("user_id", "grp"), (1, 5, 10))
    return _rounded(groups.select("user_id", "grp", "hr_1", "hr_5", "hr_10"))


@query(f"{_RANKED} SELECT user_id, grp, round(ndcg_1, 9) AS ndcg_1, round(ndcg_5, 9) AS ndcg_5, round(ndcg_10, 9) AS ndcg_10 FROM g")
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = metrics.ranking_by_group(_test(spark, sf_dir), ("user_id", "grp"), (1, 5, 10))
    return _rounded(groups.select("user_id", "grp", "ndcg_1", "ndcg_5", "ndcg_10"))


@query(f"{_RANKED} SELECT CAST(count(*) AS BIGINT) AS groups, CAST(count_if(ties) AS BIGINT) AS with_ties, CAST(count_if(positives = 0) AS BIGINT) AS without_positives, CAST(count_if(n <= 5) AS BIGINT) AS not_above_k FROM g")
def ranking_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking_diagnostics(metrics.ranking_by_group(_test(spark, sf_dir), ("user_id", "grp"), (5,)), 5)


_LOST = "CASE WHEN CAST('0x' || substr(md5(user_id || grp), 1, 2) AS INTEGER) % 7 = 0 THEN NULL ELSE score END AS score"


def _with_lost_groups(df: DataFrame) -> DataFrame:
    lost = F.conv(F.substring(F.md5(F.concat("user_id", "grp")), 1, 2), 16, 10).cast("int") % 7 == 0
    return df.withColumn("score", F.when(~lost, F.col("score")))


@query(f"{_BASE}, t AS (SELECT user_id, grp, y, {_LOST} FROM scored WHERE split = 'test'), {ranking_sql((5,))}, z AS (SELECT user_id, grp, CASE WHEN grp IN (SELECT grp FROM t WHERE score IS NULL) THEN 0.0 ELSE hr_5 END AS hr_5, CASE WHEN grp IN (SELECT grp FROM t WHERE score IS NULL) THEN 0.0 ELSE ndcg_5 END AS ndcg_5 FROM g), u AS (SELECT user_id, avg(hr_5) AS hr_5, avg(ndcg_5) AS ndcg_5 FROM z GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS users, round(avg(hr_5), 9) AS hr_5, round(avg(ndcg_5), 9) AS ndcg_5 FROM u")
def failed_group_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = metrics.ranking_by_group(_with_lost_groups(_test(spark, sf_dir)), ("user_id", "grp"), (5,), failed_as_zero=True)
    return _rounded(metrics.ranking_by_user(groups, "user_id", (5,)))


@query(f"{_BASE}, t AS (SELECT user_id, grp, y, {_LOST} FROM scored WHERE split = 'test'), q AS (SELECT y, CASE WHEN coalesce(score, 0) >= 10 THEN 1 ELSE 0 END AS prediction FROM t), c AS (SELECT {_COUNT} FROM q) SELECT size, positives, predicted, true_ AS true, {_FOUR} FROM (SELECT *, {sql.all_counts()} FROM c)")
def failure_as_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_failures_as_no(_with_lost_groups(_test(spark, sf_dir)))
    return _rounded(metrics.micro(rows.withColumn("prediction", (F.col("score") >= 10).cast("int"))))


@query(f"{_BASE}, t AS (SELECT {_LOST} FROM scored WHERE split = 'test') SELECT CAST(count(*) AS BIGINT) AS requested, CAST(count(score) AS BIGINT) AS scored, CAST(count(*) - count(score) AS BIGINT) AS failed, round(count(score) / CAST(count(*) AS DOUBLE), 9) AS share FROM t")
def score_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(coverage(_with_lost_groups(_test(spark, sf_dir))))


@query(f"{_BASE}, c AS (SELECT split, grp, count(*) AS n, sum(y) AS p FROM scored GROUP BY 1, 2) SELECT split, CAST(count(*) AS BIGINT) AS groups, CAST(min(n) AS BIGINT) AS least, round(avg(n), 9) AS mean, CAST(max(n) AS BIGINT) AS most, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n - p) AS BIGINT) AS sampled FROM c GROUP BY 1")
def candidate_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = shared.scored(spark, sf_dir).groupBy("split", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    return _rounded(groups.groupBy("split").agg(F.count(F.lit(1)).alias("groups"), F.min("n").alias("least"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("sampled")))


@query(f"{_TEST}, o AS (SELECT prediction, row_number() OVER (PARTITION BY grp ORDER BY md5(concat_ws(':', 'order', '9', grp, item_id)), item_id) AS position FROM q) SELECT CAST(position AS BIGINT) AS position, CAST(count(*) AS BIGINT) AS n, round(avg(prediction), 9) AS rate FROM o GROUP BY 1")
def position_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of yes by place in the group."""
    from slateworks.operators.candidates import shuffled

    return _rounded(shuffled(_predicted(spark, sf_dir), 9, "grp").groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("rate")))


_GAP = f"WITH {sql.KEPT}, {sql.split(0.7, 0.1, 0.2)}, m AS (SELECT avg(rating) AS s FROM split WHERE split = 'train'), e AS (SELECT user_id, rating - s AS d FROM split, m WHERE split = 'test')"


def _mean_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slateworks.operators import scorers

    rows = shared.split(spark, sf_dir)
    return scorers.score_global(rows.where("split = 'train'"), rows.where("split = 'test'"), "rating", scorers.mean)


@query(f"{_GAP} SELECT CAST(count(*) AS BIGINT) AS rows, round(avg(abs(d)), 9) AS mae, round(sqrt(avg(d * d)), 9) AS rmse FROM e")
def mae_rmse_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.regression(_mean_scored(spark, sf_dir), "rating"))


@query(f"{_GAP}, u AS (SELECT user_id, avg(abs(d)) AS mae, sqrt(avg(d * d)) AS rmse FROM e GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS users, round(avg(mae), 9) AS mae, round(avg(rmse), 9) AS rmse FROM u")
def mae_rmse_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.regression(_mean_scored(spark, sf_dir), "rating", user="user_id"))
