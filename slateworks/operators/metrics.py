"""Metrics: classification in groups, thresholds, ranking with ties, regression, agreement of policies."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slateworks.functions.ordered import running_sums

METRICS = ("accuracy", "precision", "recall", "f1")


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)


def from_counts(metric: str, size: Column, positives: Column, predicted: Column, true: Column) -> Column:
    if metric == "accuracy":
        return _ratio(size - positives - predicted + 2 * true, size)
    if metric == "precision":
        return _ratio(true, predicted)
    if metric == "recall":
        return _ratio(true, positives)
    if metric == "f1":
        return _ratio(2 * true, positives + predicted)
    raise ValueError(f"no metric {metric}")


def confusion(df: DataFrame, *group: str, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """size, positives, predicted and true positives of each group."""
    yes = F.coalesce(F.col(prediction).cast("int"), F.lit(0))
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("size"), F.sum(F.col(y).cast("long")).alias("positives"), F.sum(yes).alias("predicted"), F.sum(yes * F.col(y)).alias("true"))


def _metrics(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *(from_counts(m, *(F.col(c) for c in ("size", "positives", "predicted", "true"))).alias(m) for m in METRICS))


def micro(df: DataFrame) -> DataFrame:
    return _metrics(confusion(df), "size", "positives", "predicted", "true")


def macro_by_group(df: DataFrame, *group: str) -> DataFrame:
    """Mean over groups."""
    return _metrics(confusion(df, *group)).agg(F.count(F.lit(1)).alias("groups"), *(F.avg(m).alias(m) for m in METRICS))


def macro_by_user(df: DataFrame, user: str, *group: str) -> DataFrame:
    """Mean over users of the mean over each one's groups."""
    users = _metrics(confusion(df, user, *group), user).groupBy(user).agg(*(F.avg(m).alias(m) for m in METRICS))
    return users.agg(F.count(F.lit(1)).alias("users"), *(F.avg(m).alias(m) for m in METRICS))


def _best(table: DataFrame) -> DataFrame:
    """The row with the best value; predicting nothing (null threshold) wins ties, then the smallest threshold."""
    return table.withColumn("value", F.round("value", 12)).orderBy(F.desc("value"), F.asc_nulls_first("threshold")).limit(1)


def best_threshold(df: DataFrame, metric: str, y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, value): score >= threshold predicts yes; a null threshold predicts nothing."""
    by = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("p"))
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size"), F.coalesce(F.sum("p"), F.lit(0)).alias("positives"))
    run = running_sums(by, "threshold", ["n", "p"]).crossJoin(F.broadcast(total))
    zero = F.lit(0).cast("long")
    nothing = total.select(F.lit(None).cast("double").alias("threshold"), from_counts(metric, F.col("size"), F.col("positives"), zero, zero).alias("value"))
    return _best(nothing.unionByName(run.select("threshold", from_counts(metric, F.col("size"), F.col("positives"), F.col("run_n"), F.col("run_p")).alias("value"))))


def best_custom_threshold(df: DataFrame, value: Callable[[DataFrame], Column], candidates: list[float | None], y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, value) of the best of a few candidates by the caller's aggregate over y and prediction."""
    rows = [df.withColumn("prediction", F.lit(0) if t is None else (F.col(score) >= t).cast("int")) for t in candidates]
    parts = [r.agg(value(r).alias("value")).select(F.lit(t).cast("double").alias("threshold"), "value") for r, t in zip(rows, candidates)]
    return _best(reduce(DataFrame.unionByName, parts))


def best_group_threshold(df: DataFrame, metric: str, group: tuple[str, ...], user: str | None = None, y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, value) that is best for the mean over groups, or with user for the mean over users of their groups' means.

    Each group's metric changes only at its own scores. The changes, weighted by what the group counts, are summed by score
    and run down over the distinct scores: one pass instead of one for each threshold.
    """
    keys = [*([user] if user else []), *(g for g in group if g != user)]
    by = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("p"))
    down = Window.partitionBy(*keys).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    zero = F.lit(0).cast("long")
    counted = by.select(*keys, "threshold", F.sum("n").over(whole).alias("size"), F.sum("p").over(whole).alias("positives"), F.sum("n").over(down).alias("pp"), F.sum("p").over(down).alias("tp"))
    counted = counted.withColumn("v", from_counts(metric, F.col("size"), F.col("positives"), F.col("pp"), F.col("tp"))).withColumn("v0", from_counts(metric, F.col("size"), F.col("positives"), zero, zero))
    each = counted.withColumn("delta", F.col("v") - F.coalesce(F.lag("v").over(Window.partitionBy(*keys).orderBy(F.desc("threshold"))), F.col("v0")))
    groups = counted.groupBy(*keys).agg(F.first("v0").alias("v0"))
    if user:
        per_user = groups.groupBy(user).agg(F.count(F.lit(1)).alias("_groups"))
        share = per_user.crossJoin(F.broadcast(per_user.agg(F.count(F.lit(1)).alias("_users")))).select(user, (1.0 / (F.col("_groups") * F.col("_users"))).alias("weight"))
        groups, each = groups.join(share, user), each.join(share, user)
    else:
        share = F.broadcast(groups.agg((1.0 / F.count(F.lit(1))).alias("weight")))
        groups, each = groups.crossJoin(share), each.crossJoin(share)
    start = groups.agg(F.coalesce(F.sum(F.col("v0") * F.col("weight")), F.lit(0.0)).alias("value"))
    sums = running_sums(each.groupBy("threshold").agg(F.sum(F.col("delta") * F.col("weight")).alias("d")), "threshold", ["d"])
    table = sums.crossJoin(F.broadcast(start)).select("threshold", (F.col("value") + F.col("run_d")).alias("value"))
    return _best(start.select(F.lit(None).cast("double").alias("threshold"), "value").unionByName(table))


def _discounts(k: int) -> list[float]:
    out = [0.0]
    for i in range(1, k + 1):
        out.append(out[-1] + 1 / math.log2(i + 1))
    return out


def ranking_by_group(df: DataFrame, group: tuple[str, ...], ks: tuple[int, ...], y: str = "y", score: str = "score", failed_as_zero: bool = False) -> DataFrame:
    """hr_k and ndcg_k of each group, expected over all orders of rows with equal scores, and n, positives, ties.

    A group with a null score has failed: all its values are 0 with failed_as_zero, else its nulls rank last.
    """
    blocks = df.groupBy(*group, F.col(score).alias("_score")).agg(F.count(F.lit(1)).alias("_t"), F.sum(F.col(y).cast("long")).alias("_p"))
    whole, down = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(F.desc_nulls_last("_score")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.select(*group, "_score", "_t", "_p", F.sum("_t").over(whole).alias("_n"), F.sum("_p").over(whole).alias("_all"), (F.sum("_t").over(down) - F.col("_t")).alias("_start"))
    out = []
    table = F.array(*(F.lit(d) for d in _discounts(max(ks))))
    at = lambda i: F.element_at(table, (i + 1).cast("int"))
    for k in ks:
        k_eff = F.least(F.lit(k), F.col("_n"))
        slots = F.greatest(F.lit(0), F.least(k_eff - F.col("_start"), F.col("_t"))).cast("int")
        miss = F.aggregate(F.sequence(F.lit(0), F.greatest(slots - 1, F.lit(0))), F.lit(1.0), lambda acc, i: acc * F.greatest(F.col("_t") - F.col("_p") - i, F.lit(0)) / (F.col("_t") - i))
        out.append(F.max(F.when(slots > 0, 1.0 - miss).otherwise(0.0)).alias(f"hr_{k}"))
        gain = F.when(slots > 0, F.col("_p") / F.col("_t") * (at(F.col("_start") + slots) - at(F.col("_start")))).otherwise(0.0)
        ideal = F.max(at(F.least(F.col("_all"), k_eff)))
        out.append(F.when(ideal == 0, 0.0).otherwise(F.sum(gain) / ideal).alias(f"ndcg_{k}"))
    result = blocks.groupBy(*group).agg(F.max("_n").alias("n"), F.max("_all").alias("positives"), F.max(F.col("_t") > 1).alias("ties"), F.count_if(F.col("_score").isNull()).alias("_null"), *out)
    if failed_as_zero:
        result = result.withColumns({f"{m}_{k}": F.when(F.col("_null") > 0, 0.0).otherwise(F.col(f"{m}_{k}")) for m in ("hr", "ndcg") for k in ks})
    return result.drop("_null")


def ranking_by_user(groups: DataFrame, user: str, ks: tuple[int, ...]) -> DataFrame:
    """Mean over users of the mean over their groups."""
    names = [f"{m}_{k}" for k in ks for m in ("hr", "ndcg")]
    users = groups.groupBy(user).agg(*(F.avg(n).alias(n) for n in names))
    return users.agg(F.count(F.lit(1)).alias("users"), *(F.avg(n).alias(n) for n in names))


def ranking_diagnostics(groups: DataFrame, k: int) -> DataFrame:
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if("ties").alias("with_ties"), F.count_if(F.col("positives") == 0).alias("without_positives"), F.count_if(F.col("n") <= k).alias("not_above_k"))


def regression(df: DataFrame, y: str = "y", score: str = "score", user: str | None = None) -> DataFrame:
    """mae and rmse over all rows, or with user the mean over users of each one's."""
    gap = F.col(y).cast("double") - F.col(score)
    both = (F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))
    if user is None:
        return df.agg(F.count(F.lit(1)).alias("rows"), *both)
    return df.groupBy(user).agg(*both).agg(F.count(F.lit(1)).alias("users"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"))


def rank_agreement(utilities: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """(policies, kendall_tau, spearman_rho) of two utilities of policies, by pairs and average ranks; null for two policies."""
    n = utilities.count()
    if n < 2:
        raise ValueError("agreement needs two policies at least")
    # One row for each policy: a handful.
    left, right = utilities.select(F.col(name).alias("_i"), F.col(a).alias("_a"), F.col(b).alias("_b")), utilities.select(F.col(name).alias("_j"), F.col(a).alias("_c"), F.col(b).alias("_d"))
    pairs = left.join(right, F.col("_i") < F.col("_j"))
    da, db = F.signum(F.col("_a") - F.col("_c")), F.signum(F.col("_b") - F.col("_d"))
    tau = pairs.agg(F.sum(da * db).alias("s"), F.sum(F.abs(da)).alias("x"), F.sum(F.abs(db)).alias("z"))
    tau = tau.select(F.when((F.col("x") == 0) | (F.col("z") == 0), None).otherwise(F.col("s") / F.sqrt(F.col("x") * F.col("z"))).alias("kendall_tau"))
    average = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2
    rho = utilities.select(average(a).alias("_ra"), average(b).alias("_rb")).agg(F.corr("_ra", "_rb").alias("spearman_rho"))
    out = tau.crossJoin(rho)
    if n == 2:
        out = out.select(*(F.lit(None).cast("double").alias(c) for c in out.columns))
    return out.select(F.lit(n).cast("long").alias("policies"), "kendall_tau", "spearman_rho")


def kendall_p(tau: float, n: int) -> float:
    """Two-sided probability under no association, without ties: by counting orders up to 8, by the normal beyond."""
    if n <= 8:
        pairs = n * (n - 1) // 2
        values = [sum(1 if p[i] < p[j] else -1 for i in range(n) for j in range(i + 1, n)) / pairs for p in permutations(range(n))]
        return sum(abs(v) >= abs(tau) - 1e-12 for v in values) / len(values)
    return math.erfc(abs(tau) / math.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1))) / math.sqrt(2))


def spearman_p(rho: float, n: int) -> float:
    """Two-sided probability by Student's t with n - 2 degrees of freedom."""
    if n < 3:
        raise ValueError("needs three at least")
    if abs(rho) >= 1:
        return 0.0
    t, nu = abs(rho) * math.sqrt((n - 2) / (1 - rho * rho)), n - 2
    steps = 20_000
    top = math.atan2(t, math.sqrt(nu))
    # With t = sqrt(nu) tan(u) the density is a power of the cosine.
    f = lambda u: math.cos(u) ** (nu - 1)
    h = (math.pi / 2 - top) / steps
    tail = h / 3 * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * f(top + i * h) for i in range(steps + 1))
    return 2 * tail * math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)


def by_utility(table: DataFrame, policy: str, utility: str, position: str) -> list:
    """The policies by utility, best first; those with the same utility stay in the order of position. A row for each policy."""
    return [r[policy] for r in table.orderBy(F.desc(utility), position).select(policy).collect()]
