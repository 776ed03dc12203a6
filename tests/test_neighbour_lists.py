import math
import re

import numpy as np
import pyarrow as pa
import pytest

from slateworks.operators import neighbour_lists, policies, scorers


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(2)
    # One item that everybody has, one user who has everything, repeats, nulls.
    rows = [(f"u{rng.integers(60)}", f"i{rng.integers(45)}") for _ in range(900)] + [(f"u{u}", "hot") for u in range(60)] + [("all", f"i{i}") for i in range(45)] + [("u1", None), (None, "i1")]
    return rows, spark.createDataFrame(rows, "user_id string, item_id string").repartition(3).persist()


def expected(rows, n):
    w = {}
    for u, i in rows:
        if u is not None and i is not None:
            w.setdefault(u, {}).setdefault(i, 0)
            w[u][i] += 1
    square, dot = {}, {}
    for items in w.values():
        for i, a in items.items():
            square[i] = square.get(i, 0) + a * a
            for j, b in items.items():
                if i != j:
                    dot[i, j] = dot.get((i, j), 0) + a * b
    near = {}
    for (i, j), d in dot.items():
        near.setdefault(i, []).append((-round(d / math.sqrt(square[i] * square[j]), 12), j))
    return w, {i: sorted(v)[:n] for i, v in near.items()}


def listed(lists, near, index):
    name = {r["index"]: r.item_id for r in index.collect()}
    return {name[r.i]: [(name[o], d / math.sqrt(r.q * q)) for o, d, q in zip(r.others, r.dots, r.qs)] for r in near.collect()}


@pytest.mark.parametrize("block_pairs", [None, 3000])
def test_neighbours_and_sums_match_brute_force(spark, train, block_pairs):
    rows, df = train
    w, near = expected(rows, 7)
    lists, index = neighbour_lists.item_lists(df)
    found = neighbour_lists.near_lists(lists, 7, block_pairs)
    got = listed(lists, found, index)
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for _, j in v] for i, v in near.items()}
    assert all(s == pytest.approx(-t) for i in got for (_, s), (t, _) in zip(got[i], near[i]))
    users = df.select("user_id").where("user_id <> 'u3'")
    top = neighbour_lists.recommended(lists, found, users, 4, 7, block_pairs).join(index, "index").collect()
    for u, items in w.items():
        s = {}
        for i in items:
            for t, j in near[i]:
                s[j] = s.get(j, 0.0) - t
        best = [j for _, j in sorted((-round(v, 9), j) for j, v in s.items() if j not in items)[:4]]
        assert [r.item_id for r in sorted((r for r in top if r.user_id == u), key=lambda r: r["rank"])] == ([] if u == "u3" else best)


def test_long_rows_go_in_steps(monkeypatch):
    rng = np.random.default_rng(3)
    each = [np.unique(rng.integers(0, 30, rng.integers(1, 12))) for _ in range(40)]
    for heavy in (False, True):
        weights = [rng.integers(1, 4, len(x)) if heavy else np.ones(len(x), int) for x in each]
        squares = np.zeros(30, int)
        for x, v in zip(each, weights):
            squares[x] += v * v
        column = lambda xs: pa.array([list(map(int, x)) for x in xs], pa.list_(pa.int64()))
        batch = pa.record_batch({"i": column(each), "w": column(weights), "q": column([squares[x] for x in each])})
        results = []
        for step in (1 << 20, 40, 1):
            monkeypatch.setattr(neighbour_lists, "STEP_PAIRS", step)
            dealt = sorted(neighbour_lists._deal_lists(3)([batch]), key=lambda b: b["block"][0].as_py())
            results.append(sorted((r["i"], tuple(r["others"]), tuple(r["dots"])) for b in neighbour_lists._near(3, 5)(iter(dealt)) for r in b.to_pylist()))
        assert results[0] and results[0] == results[1] == results[2]


def test_pairs_of_items_never_leave_a_task(spark, train):
    """The pairs of a user's items were joined and shuffled, a row for nearly each of them."""
    _, df = train
    plan = scorers.neighbours(df, 3)._jdf.queryExecution().toString() + policies.recommend_item_knn(df, df, 3)._jdf.queryExecution().toString()
    assert "block" in plan and not re.search(r"item_id#\d+ < item_id#\d+", plan)


def test_nothing_to_recommend_from(spark, train):
    _, df = train
    assert policies.recommend_item_knn(df.limit(0), df, 3).collect() == []
    one = spark.createDataFrame([("a", "x"), ("b", "y")], "user_id string, item_id string")
    assert policies.recommend_item_knn(one, one, 3).collect() == []
