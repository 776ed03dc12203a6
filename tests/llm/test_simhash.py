import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from slateworks.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return sorted(((d, f"{p:016x}", min((x for x in groups[root(i)] if x is not None), default=None)) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def texts(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if i % 3 and rows:
            t = rows[rng.integers(len(rows))][1] or ""
            w = t.split()
            if w:
                w[rng.integers(len(w))] = "Changed"
            t = " ".join(w)
        else:
            t = " ".join(rng.choice(words, rng.integers(1, 300)))
        rows.append((i * 7 % 1009, t))
    return rows


def test_matches_brute_force(spark):
    rows = texts(1, 150) + [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "One"), (2004, "one\ttwo"), (2004, "one\ttwo"), (None, "é ä " * 50), (None, "q r s t u")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert got == brute_components(rows)


def test_keep_one_row_of_each_component(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "some other words that stand alone here"), (3, "a third text, the id is used again for it"), (None, "nobody knows the id of this text at all")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("least", F.lit(1)))
    assert out.columns == ["doc_id", "text", "least"]
    assert sorted((r.doc_id is None, r.doc_id, r.text[:7]) for r in out.collect()) == [(False, 3, "a b c d"), (False, 3, "a third"), (False, 9, "some ot"), (True, None, "nobody ")]
    unique = spark.createDataFrame(rows[:2] + rows[3:4], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(unique).collect()) == [3, 9]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_and_crowded_buckets_agree_with_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(20):
            v = b
            for bit in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                v ^= 1 << bit
            values.add(v)
    values = np.array(sorted(values), dtype=np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    from slateworks.llm._common import Scratch, connected_components

    def labels(links):
        parent = {int(v): int(v) for v in values.view(np.int64)}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            assert (int(a) ^ int(b)) & (2**64 - 1) and ((int(a) ^ int(b)) & (2**64 - 1)).bit_count() <= 4
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return {v: root(v) for v in parent}

    every = [(int(a), int(b)) for i, a in enumerate(values.view(np.int64)) for b in values.view(np.int64)[:i] if ((int(a) ^ int(b)) & (2**64 - 1)).bit_count() <= 4]
    expected = labels(every)
    scratch = Scratch(spark)
    found = [tuple(r) for r in simhash.near_links(scratch, df).collect()]
    assert labels(found) == expected
    nodes = {r.node: r.component for r in connected_components(scratch, simhash.near_links(scratch, df)).collect()}
    assert all(expected[v] == nodes.get(v, v) for v in expected)
    crowded = [tuple(r) for r in simhash.near_links(scratch, df, limit=8).collect()]
    assert labels(crowded) == expected
    batch = next(simhash._keys(iter([df.toPandas()]))).sort_values(["bucket", "fp"])
    beyond = [t for t in simhash._links(iter([batch.iloc[:1000], batch.iloc[1000:]]), 8) if t["b"].isna().any()]
    assert beyond
