"""Pairwise fits: the triples' gradients of brute force, the same vectors in one task and in pieces, draws from all unseen items."""

import os

import numpy as np
import pytest

from slateworks.functions.scratch import shared_root
from slateworks.operators import pairwise, policies


def brute(user, item, users, items, n, dims, epochs, rate, decay, layers, seed):
    e = np.concatenate([pairwise.initial(seed, 0, 0, users, dims), pairwise.initial(seed, 1, 0, items, dims)])
    a = np.zeros((users + items,) * 2)
    a[user, users + item] = a[users + item, user] = 1
    degree = np.maximum(a.sum(axis=1), 1)
    a /= np.sqrt(np.outer(degree, degree))
    over = sum(np.linalg.matrix_power(a, p) for p in range(layers + 1)) / (layers + 1)
    m, s = np.zeros_like(e), np.zeros_like(e)
    for epoch in range(epochs):
        f, up = over @ e, np.zeros_like(e)
        for u, i, j in zip(user, users + item, users + pairwise.Unseen(user, item, n).draw(seed, epoch)):
            if j >= users:
                g = 1 / (1 + np.exp(f[u] @ (f[i] - f[j])))
                up[u] += g * (f[i] - f[j])
                up[i] += g * f[u]
                up[j] -= g * f[u]
        if layers:
            down = decay * e - over @ up
            m, s = 0.9 * m + 0.1 * down, 0.999 * s + 0.001 * down**2
            e = e - rate * m / (1 - 0.9 ** (epoch + 1)) / (np.sqrt(s / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        else:
            e = e * (1 - rate * decay) + rate * up
    return over @ e


@pytest.fixture(scope="module")
def pairs():
    rng = np.random.default_rng(0)
    rows = {(int(u), int(i)) for u, i in zip(rng.integers(1, 25, 150), rng.integers(0, 33, 150))} | {(0, i) for i in range(30)}
    return tuple(np.array(c) for c in zip(*sorted(rows)))


@pytest.mark.parametrize("layers", [0, 2])
def test_fit_is_that_of_all_triples(pairs, layers, monkeypatch):
    monkeypatch.setattr(pairwise, "STEP", 16)
    user, item = pairs
    size = 25, 33, 30, 4, 5, 0.05, 0.01, layers, 3
    assert np.allclose(np.concatenate(pairwise.fit_in_task(user, item, *size)), brute(user, item, *size), atol=1e-12)


def test_draws_are_from_all_unseen_items(pairs):
    user, item = pairs
    unseen = pairwise.Unseen(user, item, 30)
    drawn = [unseen.draw(1, epoch) for epoch in range(400)]
    assert all((q[user == 0] == -1).all() for q in drawn)
    for u in range(1, 25):
        assert set(np.concatenate([q[user == u] for q in drawn]).tolist()) == set(range(30)) - set(item[user == u].tolist())


@pytest.mark.parametrize("layers", [0, 2])
def test_pieces_give_the_vectors_of_one_task_and_leave_nothing_else(spark, pairs, layers, monkeypatch):
    user, item = pairs
    train = spark.createDataFrame([(f"u{u:02d}", f"i{i:02d}") for u, i in zip(*pairs)] + [("u01", None)], "user_id string, item_id string")
    items = spark.createDataFrame([(f"i{i:02d}",) for i in range(30)], "item_id string")
    work = 4, 2, 0.05, 0.01, layers, 3
    root = shared_root(spark).removeprefix("file:")
    found = []
    for most in (pairwise.ONE_TASK, 0):
        monkeypatch.setattr(pairwise, "ONE_TASK", most)
        monkeypatch.setattr(pairwise, "PIECE", 6)
        monkeypatch.setattr(pairwise, "BLOCK", 2)
        monkeypatch.setattr(pairwise, "PART_BYTES", 1250)
        before = set(os.listdir(root))
        factors = policies.fit_pairwise(train, items, *work)
        kept = [name for d in set(os.listdir(root)) - before for name in os.listdir(f"{root}/{d}")]
        assert sorted(kept) == ["items", "offered", "pairs", "users", "vectors"]
        found.append({(r.side, r.name): r.v for r in factors.collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == 58
    assert all(np.allclose(found[0][key], found[1][key], atol=1e-6) for key in found[0])
    expected = brute(user, item, 25, 33, 30, *work)
    assert np.allclose(found[1][(0, "u03")], expected[3], atol=1e-6) and np.allclose(found[1][(1, "i32")], expected[25 + 32], atol=1e-6)


@pytest.mark.parametrize("name", ["policy_bpr", "policy_lightgcn"])
def test_queries_learn_whose_taste_is_whose(spark, tmp_path, name):
    """Customers of odd and of even numbers order parts of their own kind alone, and are to be shown such."""
    from __spark_entry__ import queries

    rng = np.random.default_rng(1)
    lines = [(c, 2 * int(p) + c % 2) for c in range(40) for p in rng.choice(30, 15, replace=False)]
    write = lambda rows, schema, table: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    write([(c, c, "2020-01-01") for c in range(40)], "o_orderkey long, o_custkey long, o_orderdate string", "orders")
    write([(c, p, 40.0) for c, p in lines], "l_orderkey long, l_partkey long, l_quantity double", "lineitem")
    write([(p, "n", "b", "t") for p in range(60)], "p_partkey long, p_name string, p_brand string, p_type string", "part")
    shown = queries()[name](spark, str(tmp_path)).collect()
    own = [int(r.user_id) % 2 == int(r.item_id) % 2 for r in shown]
    assert len(shown) == 10 * len({r.user_id for r in shown}) and np.mean(own) > 0.9
