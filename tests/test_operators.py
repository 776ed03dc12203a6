import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slateworks.operators import candidates, evaluation, filters, joins, metrics, policies, responses, scorers, splits, tasks


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    rows = [(f"u{i % 4}", f"g{i // 5}", int(rng.random() < 0.4), float(rng.integers(0, 4))) for i in range(60)]
    rows = [(f"u{int(g[1:]) % 4}", g, y, s) for _, g, y, s in rows]
    return rows, spark.createDataFrame(rows, "user_id string, grp string, y int, score double").persist()


def f1(rows, t):
    pp = sum(s >= t for *_, s in rows)
    tp = sum(y for _, _, y, s in rows if s >= t)
    p = sum(y for _, _, y, _ in rows)
    return 2 * tp / (pp + p) if pp + p else 0.0


def test_thresholds_match_brute_force(scored):
    rows, df = scored
    by = {}
    for r in rows:
        by.setdefault((r[0], r[1]), []).append(r)
    users = sorted({u for u, _ in by})
    options = [math.inf, *sorted({r[3] for r in rows})]
    group = lambda t: np.mean([f1(v, t) for v in by.values()])
    user = lambda t: np.mean([np.mean([f1(v, t) for (u, _), v in by.items() if u == x]) for x in users])
    for value, got in ((lambda t: f1(rows, t), metrics.best_threshold(df, "f1")), (group, metrics.best_group_threshold(df, "f1", ("user_id", "grp"))), (user, metrics.best_group_threshold(df, "f1", ("grp",), "user_id"))):
        best = max(options, key=lambda t: (round(value(t), 12), -options.index(t)))
        row = got.first()
        assert row.value == pytest.approx(value(best)) and (row.threshold if row.threshold is not None else math.inf) == best


def test_ranking_is_the_mean_over_orders_of_ties(spark):
    cases = [[(1, 2.0), (0, 2.0), (0, 1.0)], [(1, 1.0), (1, 1.0), (0, 1.0), (0, 1.0)], [(0, 3.0), (0, 1.0)], [(0, 2.0), (1, 1.0), (0, 1.0), (1, 0.0)]]
    rows = [("u", f"g{i}", y, s) for i, c in enumerate(cases) for y, s in c]
    got = {r.grp: r for r in metrics.ranking_by_group(spark.createDataFrame(rows, "user_id string, grp string, y int, score double"), ("user_id", "grp"), (1, 2, 3)).collect()}
    for i, c in enumerate(cases):
        orders = [o for o in itertools.permutations(c) if all(a[1] >= b[1] for a, b in zip(o, o[1:]))]
        for k in (1, 2, 3):
            hr = np.mean([any(y for y, _ in o[:k]) for o in orders])
            ideal = sum(1 / math.log2(j + 2) for j in range(min(k, len(c), sum(y for y, _ in c))))
            ndcg = np.mean([sum(y / math.log2(j + 2) for j, (y, _) in enumerate(o[:k])) for o in orders]) / ideal if ideal else 0.0
            assert got[f"g{i}"][f"hr_{k}"] == pytest.approx(hr) and got[f"g{i}"][f"ndcg_{k}"] == pytest.approx(ndcg)


def test_agreement(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 3.0), ("c", 3.0, 2.0), ("d", 3.0, 4.0)], "p string, x double, z double")
    row = metrics.rank_agreement(df, "p", "x", "z").first()
    assert row.kendall_tau == pytest.approx(3 / math.sqrt(5 * 6)) and row.spearman_rho == pytest.approx(3 / math.sqrt(4.5 * 5))
    assert metrics.rank_agreement(df.limit(2), "p", "x", "z").first().kendall_tau is None
    with pytest.raises(ValueError):
        metrics.rank_agreement(df.limit(1), "p", "x", "z")
    assert metrics.kendall_p(1.0, 4) == pytest.approx(2 / 24) and metrics.spearman_p(0.8, 5) == pytest.approx(0.104088, abs=1e-5)


def interactions(spark, users=12, n=14):
    rows = [(f"u{u:02d}", f"i{(u * 5 + k * 3) % 40:02d}", k + 1, (u + k) % 5 + 1) for u in range(users) for k in range(n)]
    return spark.createDataFrame(rows, "user_id string, item_id string, ts int, rating int").withColumn("liked", (F.col("rating") >= 4).cast("int"))


def test_split_counts_and_order_independence(spark):
    rows = spark.createDataFrame([("a", str(i)) for i in range(15)] + [("b", str(i)) for i in range(10)], "user_id string, item_id string")
    out = splits.random_fractions(rows, 0.7, 0.0, 0.3, 1)
    counts = {(r.user_id, r.split): r["count"] for r in out.groupBy("user_id", "split").count().collect()}
    assert counts == {("a", "test"): 5, ("a", "train"): 10, ("b", "test"): 3, ("b", "train"): 7}
    again = splits.random_fractions(rows.orderBy(F.rand(3)).repartition(3), 0.7, 0.0, 0.3, 1)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(ValueError):
        splits.random_fractions(rows, 0.7, 0.0, 0.2, 1)
    with pytest.raises(ValueError):
        splits.cold_users(rows, 2, 0.1, 0.2, 0)


def test_cold_users_are_cut_in_time(spark):
    out = splits.cold_users(interactions(spark), 4, 0.2, 0.3, 0)
    by = {}
    for r in out.collect():
        by.setdefault(r.user_id, []).append(r)
    kinds = [frozenset(r.split for r in v) for v in by.values()]
    assert kinds.count(frozenset({"train"})) == 6 and kinds.count(frozenset({"history", "val"})) == 2 and kinds.count(frozenset({"history", "test"})) == 4
    for v in by.values():
        past = [r.ts for r in v if r.split == "history"]
        assert not past or len(past) == 4 and max(past) < min(r.ts for r in v if r.split != "history")


def test_negatives_are_unseen_and_groups_full(spark):
    rows = interactions(spark)
    items = spark.createDataFrame([(f"i{i:02d}",) for i in range(60)], "item_id string")
    out = candidates.non_interactions(rows.where("ts <= 6"), items, rows, 2, 6, 3).collect()
    seen = {(r.user_id, r.item_id) for r in rows.collect()}
    groups = {}
    for r in out:
        groups.setdefault((r.user_id, r.chunk), []).append(r)
        assert ((r.user_id, r.item_id) in seen) == (r.y == 1)
    assert all(len(g) == 6 and sum(r.y for r in g) == 2 and len({r.item_id for r in g}) == 6 for g in groups.values())
    few = items.limit(45)
    need = rows.select("user_id").distinct().select("user_id", F.lit(0).cast("long").alias("chunk"), F.lit(25).alias("need"))
    full = candidates.draw_negatives(need, few, rows, 1, attempts=1)
    assert {r["count"] for r in full.distinct().groupBy("user_id").count().collect()} == {25}
    assert full.join(rows, ["user_id", "item_id"]).isEmpty()
    with pytest.raises(ValueError):
        candidates.draw_negatives(need.withColumn("need", F.lit(50)), few, rows, 1)


def test_users_who_have_seen_nearly_all_get_what_is_left(spark):
    items = spark.createDataFrame([(f"i{i:03d}",) for i in range(200)], "item_id string")
    seen = spark.createDataFrame([("u", f"i{i:03d}") for i in range(190)] + [("v", f"i{i:03d}") for i in range(195)] + [("w", f"i{i:03d}") for i in range(200)], "user_id string, item_id string")
    need = spark.createDataFrame([("u", 0, 9), ("u", 1, 10)], "user_id string, chunk long, need int")
    out = candidates.draw_negatives(need, items, seen, 3).collect()
    for chunk, n in ((0, 9), (1, 10)):
        got = {r.item_id for r in out if r.chunk == chunk}
        assert len(got) == n and all(i >= "i190" for i in got)
    shown = policies.recommend_random(seen, seen.select("user_id"), items, 10, 3).collect()
    assert sorted((r.user_id, r.rank) for r in shown) == [("u", i) for i in range(1, 11)] + [("v", i) for i in range(1, 6)]


def test_tasks_do_not_leak(spark):
    rows = interactions(spark)
    users = rows.select("user_id").distinct().withColumn("age", F.lit(1))
    items = spark.createDataFrame([(f"i{i:02d}", "t") for i in range(60)], "item_id string, title string")
    config = tasks.TaskConfig(m=1, total=4, k=3, val=0.2, train=0.5, test=0.3)
    for make in (tasks.alignment, tasks.preference, tasks.cold_start):
        task = make(users, items, rows, config)
        held = task.rows.where("split IN ('val', 'test')")
        assert held.where("rating IS NOT NULL").count() == 0 and held.count() > 0
        assert task.split("train").where("candidate_group IS NOT NULL").count() == 0
        pairs = lambda df: {(r.user_id, r.item_id) for r in df.where("y = 1").collect()}
        assert not pairs(task.split("val")) & pairs(task.split("test")) and not pairs(held) & pairs(task.split("train"))
        x, y = task.xy("test")
        assert "y" not in x.columns and y.columns == ["y"] and "item_title" in task.features
    recommend = {"popularity": policies.recommend_popular, "random": lambda t, u, i, k: policies.recommend_random(t, u, i, k, 1)}
    policy = tasks.policy_ranking(users, items, rows, config, recommend, k=5)
    assert {r["count"] for r in policy.rows.groupBy("user_id", "policy").count().collect()} == {5}
    saved = tasks.popularity_scored(tasks.alignment(users, items, rows, config))
    found = evaluation.evaluate(saved, ks=(1, 3))
    assert set(found) == {"threshold", "val", "test"} and 0 <= found["test"]["ranking"]["ndcg_3"] <= 1


def test_scorers(spark):
    train = spark.createDataFrame([("a", "x", 1, 5), ("a", "y", 2, 3), ("b", "x", 1, 5), ("b", "z", 2, 1), ("c", "x", 1, None), ("c", "y", 2, 2)], "user_id string, item_id string, position int, rating int")
    rows = spark.createDataFrame([("a", "x"), ("b", "new")], "user_id string, item_id string")
    of = lambda df: {r.item_id: r.score for r in df.collect()}
    assert of(scorers.score_global(train, rows, "rating", scorers.mean)) == {"x": 3.2, "new": 3.2}
    assert of(scorers.score_global(train, rows, "rating", scorers.mode)) == {"x": 5.0, "new": 5.0}
    assert of(scorers.score_items(train, rows, "rating", scorers.mean)) == {"x": 5.0, "new": 3.2}
    assert of(scorers.score_users(train, rows, "rating", scorers.mean, last=1)) == {"x": 3.0, "new": 1.0}
    with pytest.raises(ValueError):
        scorers.score_users(train, rows.union(spark.createDataFrame([("q", "x")], "u string, i string")), "rating", scorers.mean).count()
    near = {(r.item_id, r.other): r.similarity for r in scorers.neighbours(train, 5).collect()}
    assert near[("x", "y")] == pytest.approx(2 / math.sqrt(6)) and ("y", "z") not in near


def test_factor_policies_follow_the_contract(spark):
    rows = interactions(spark, users=6, n=8)
    items = spark.createDataFrame([(f"i{i:02d}",) for i in range(40)], "item_id string")
    users = rows.select("user_id").distinct()
    seen = {(r.user_id, r.item_id) for r in rows.collect()}
    for layers in (0, 1):
        factors = policies.fit_pairwise(rows, items, 4, 1, 0.1, 1e-4, layers, 0)
        got = policies.recommend_factors(factors, rows, users, items, 5, "p").collect()
        assert len(got) == 30 and not seen & {(r.user_id, r.item_id) for r in got} and {r["rank"] for r in got} == {1, 2, 3, 4, 5}


def test_answers_with_retries_and_budget(spark):
    asked = responses.ask(spark.createDataFrame([("a",), ("never",)], "prompt string"), flaky_client(), lambda a: a.startswith("C1"))
    got = {r.prompt: (r.answer, r.tries, r.error) for r in asked.collect()}
    assert got["a"] == ("C1: yes", 3, None) and got["never"][:2] == (None, 5) and "TimeoutError" in got["never"][2]
    with pytest.raises(responses.BudgetExceeded):
        responses.check_budget(asked)
    budget = responses.ErrorBudget()
    for _ in range(19):
        budget.record(True)
    with pytest.raises(responses.BudgetExceeded):
        budget.record(True)


def flaky_client():
    def make():
        state = {}

        def call(prompt):
            state[prompt] = state.get(prompt, 0) + 1
            if prompt == "never" or state[prompt] < 3:
                raise TimeoutError("slow")
            return "C1: yes"

        return call

    return make


def test_filters_and_joins_check_what_they_get(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "user_id string, item_id string")
    assert {r.user_id for r in filters.min_interactions(df, 2).collect()} == {"a"}
    assert filters.sample_users(df, 1, 3).collect() == filters.sample_users(df.orderBy(F.desc("user_id")), 1, 3).collect()
    for wrong in (lambda: filters.require_columns(df, "z"), lambda: filters.pipeline([]), lambda: filters.min_interactions(df, 0), lambda: filters.sample_users(df, 0, 1)):
        with pytest.raises(ValueError):
            wrong()
    capped = filters.groups_per_policy(df.withColumn("policy", F.lit("p")), 1, 3, "policy", "user_id")
    assert {r.user_id for r in capped.collect()} == {"a"}
    other = spark.createDataFrame([("x", 1.0)], "item_id string, v double")
    assert {r.item_id: r.v for r in joins.with_fallback(df, other, "item_id", "v", 0.5).collect()} == {"x": 1.0, "y": 0.5}
