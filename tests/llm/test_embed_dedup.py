import numpy as np
import pytest
from pyspark.sql import functions as F

from slateworks.llm import embed_dedup


def brute(rows, threshold=0.98):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, dtype=np.float32).astype(float)
        return x / np.linalg.norm(x)

    units = [unit(v) for _, _, v in rows]
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][1] is not None and rows[i][1] == rows[j][1] and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(rows[i][0])
    out = []
    for i in range(n):
        c = min((x for x in groups[root(i)] if x is not None), default=None)
        out.append((rows[i][0], links[i], c, rows[i][0] is not None and rows[i][0] == c))
    return sorted(out, key=str)


def rows_(seed, n, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            j = int(rng.integers(len(out)))
            v = np.array(out[j][2]) + rng.normal(size=dim) * 0.19 * rng.random() / np.sqrt(dim) * np.linalg.norm(out[j][2])
            label = out[j][1]
        else:
            v, label = rng.normal(size=dim), int(rng.integers(3))
        out.append((i, label, [float(x) for x in np.float32(v)]))
    return out


SCHEMA = "vec_id long, label int, embedding array<float>"


def test_matches_brute_force(spark):
    rows = rows_(1, 400)
    rows += [(1000, None, rows[0][2]), (1001, 0, None), (1002, 0, [0.0] * 64), (1003, 0, [float("nan")] * 64), (1004, 0, [None] * 64), (1005, 1, []), (1006, 1, [1.0, 2.0]), (1007, 1, [2.0, 4.0]), (1008, 1, [1.0]), (None, 2, [float(x) for x in range(1, 65)]), (1009, 2, [float(x) for x in range(1, 65)]), (1009, 2, [float(x) for x in range(1, 65)]), (1010, 0, [float("inf")] + [1.0] * 63)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cid", F.lit(1)).withColumn("n", F.lit("x"))
    assert sorted(map(tuple, embed_dedup.near_duplicates(df).collect()), key=str) == brute(rows)


def test_large_buckets_meet_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    center = rng.normal(size=16)
    rows = [(i, 1, [float(x) for x in np.float32(center + rng.normal(size=16) * 0.1)]) for i in range(90)]
    monkeypatch.setattr(embed_dedup, "BLOCK", 20)
    assert sorted(map(tuple, embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("dim", [2, 3, 4, 8, 16, 64, 128, 256, 768])
def test_recall_at_the_threshold_in_any_dimension(dim):
    """Pairs at cosine 0.98, the hardest case, that share a bucket. Hashes do not depend on how many vectors there are."""
    rng, n = np.random.default_rng(dim), 600
    x, d = rng.normal(size=(n, dim)), rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d -= (d * x).sum(axis=1, keepdims=True) * x
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    z = 0.98 * x + np.sqrt(1 - 0.98**2) * d
    a, b = (embed_dedup.bucket_keys(v, np.zeros(n, dtype=np.int64)) for v in (x, z))
    found = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
    assert found.mean() > 0.985, (dim, found.mean())
    assert (embed_dedup.bucket_keys(x[:5], np.zeros(5, dtype=np.int64)) == a[:5]).all()


def test_low_dimensions_match_brute_force(spark):
    for dim in (1, 2, 4):
        rows = rows_(dim, 120, dim)
        got = sorted(map(tuple, embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
        expected = brute(rows)
        assert sum(g[1] for g in got) >= 0.98 * sum(e[1] for e in expected) and all(g[1] <= e[1] for g, e in zip(got, expected))
