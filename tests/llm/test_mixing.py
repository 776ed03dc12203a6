import numpy as np
import pytest
from pyspark.sql import functions as F

from slateworks.llm import mixing


def brute_targets(by_source):
    names = sorted((s for s in by_source if s is not None)) + ([None] if None in by_source else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, goal, open_ = 1.5 * sum(by_source.values()), {}, set(names)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * by_source[s]}
        if not above:
            goal |= share
            break
        for s in above:
            goal[s] = 2.0 * by_source[s]
            left -= goal[s]
        open_ -= above
    return goal


def documents(n, seed):
    rng = np.random.default_rng(seed)
    sources = ["b", "a", "é", "zz", None, "Z", "tiny"]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), sources[min(6, int(rng.exponential(1.3)))]) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "only empty"), (None, "x y z", None), (n, "x \t y", "a"), (n, "x \t y", "a"), (n + 2, "long " * 3000, "tiny")]


@pytest.mark.parametrize("block", [16, 4096])
def test_targets_and_totals(spark, block, monkeypatch):
    rows = documents(600, 1)
    monkeypatch.setattr(mixing.copies, "__defaults__", (block,))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix(df)
    first, second = (sorted(map(tuple, out.collect()), key=str) for out in (out, mixing.mix(df)))
    assert first == second and len(first) == len(rows)
    by_source = {}
    for _, t, s in rows:
        by_source[s] = by_source.get(s, 0) + len((t or "").split())
    goal = brute_targets(by_source)
    taken, biggest = {}, {}
    source_of = {r[0]: r[2] for r in rows}
    for r in out.collect():
        s = source_of[r.doc_id] if r.doc_id is not None else None
        assert r.source_size == by_source[s] and r.target == pytest.approx(goal[s]) and r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        assert r.size == 0 or abs(r.copies - goal[s] / by_source[s]) < 1 + 1e-6
        taken[s] = taken.get(s, 0) + r.taken
        biggest[s] = max(biggest.get(s, 0), r.size)
    for s in goal:
        assert abs(taken[s] - goal[s]) <= biggest[s] + 1e-6


def test_rows_of_one_id_are_spread(spark):
    rows = [(None, "w " * (i % 7 + 1), "a") for i in range(3000)] + [(i % 2, "w w", "a") for i in range(3000)] + [(10 + i, "w", "b") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit(1))
    scratch = mixing.Scratch(spark)
    sized = df.select("doc_id", "source", F.lit(1).alias("size"), F.monotonically_increasing_id().alias("row"))
    orders = mixing.ordered(scratch, sized).select("_order", "doc_id").distinct()
    assert orders.count() == len(rows)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and mixing.mixed(df).columns == df.columns


def test_unique_ids_mix_alike_in_any_partitioning(spark):
    df = spark.createDataFrame([(i, "w " * (i % 37), f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixing.mix(df).collect())) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))


@pytest.mark.parametrize("n", [1, 2, 7, 200])
def test_targets_of_many_sources(spark, n):
    rng = np.random.default_rng(n)
    by_source = {f"s{i:03d}": int(rng.integers(0, 10 ** int(rng.integers(1, 6)))) for i in range(n)}
    table = spark.createDataFrame(list(by_source.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(mixing.Scratch(spark), table).collect()}
    assert got == pytest.approx(brute_targets(by_source))


def test_rows_are_repeated(spark):
    df = spark.createDataFrame(documents(100, 2), "doc_id long, text string, source string")
    counts = {}
    for r in mixing.mix(df).collect():
        counts[r.size] = counts.get(r.size, 0) + r.copies
    got = mixing.mixed(df)
    assert got.columns == df.columns
    assert 0 < got.count() <= 2 * df.count()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.mixed(df).count() == 0


def test_flight_keeps_the_constraints():
    rng = np.random.default_rng(0)
    p, size = rng.random(500), rng.integers(1, 1000, 500).astype(float)
    a = np.stack([np.ones(500), size / 1000], axis=1)
    q = mixing.flight(p, a, rng.random(500))
    assert np.allclose(a.T @ p, a.T @ q, atol=1e-6) and ((q > 0) & (q < 1)).sum() <= 2
    many = np.mean([mixing.flight(p[:40], a[:40], rng.random(40)) for _ in range(400)], axis=0)
    assert np.abs(many - p[:40]).max() < 0.12
