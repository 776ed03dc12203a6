import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slateworks.llm import suffix_dedup
from slateworks.llm._common import Scratch


def brute(rows):
    seen = {}
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        for p in range(len(b) - 199):
            seen[b[p : p + 200]] = seen.get(b[p : p + 200], 0) + 1
    out = []
    for (d, _), b in zip(rows, data):
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def rows_():
    rng = np.random.default_rng(7)
    words = ["the", "of", "ér", "thing", "on", "wh", "at", "rend"]
    make = lambda n: " ".join(rng.choice(words, n))
    passages = [make(n) for n in (45, 60, 80, 150, 400)]
    rows = []
    for i in range(60):
        parts = [make(int(rng.integers(1, 150)))]
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(len(passages))]
            a, b = sorted(rng.integers(0, len(p), 2))
            parts += [p if rng.random() < 0.5 else p[a:b], make(int(rng.integers(1, 60)))]
        rows.append((i, "".join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(108, rows[0][1])] * 2
    for i in range(12):
        t = rows[i + 20][1]
        at = rng.integers(0, len(t))
        rows.append((200 + i, t[:at] + "#" + t[at + 1 :]))
    x = make(90)
    rows += [(300, x + "|" + x), (301, "a" * 700), (302, "a" * 199), (303, "ab" * 150), (304, ""), (305, None), (None, passages[3][:210]), (306, "z" * 200), (307, "q" * 200), (308, "q" * 200)]
    rows += [(309, "abc" * 60 + passages[4][:199]), (310, passages[4][:199] + "!")]
    return rows


def test_matches_brute_force(spark):
    rows = rows_()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit(1)).withColumn("k1", F.lit("x"))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_plain_doubling_matches_brute_force(spark):
    rows = rows_()
    data = [(i, (t or "").encode()) for i, (_, t) in enumerate(rows)]
    seen = {}
    for i, b in data:
        for p in range(len(b) - 199):
            seen.setdefault(b[p : p + 200], []).append((i, p))
    expected = sorted(at for places in seen.values() if len(places) > 1 for at in places)
    texts = spark.createDataFrame(data, "row long, text binary")
    assert sorted(map(tuple, suffix_dedup.doubled_spans(Scratch(spark), texts).collect())) == expected


def test_blocks_of_long_texts_agree():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 100, 3000, dtype=np.uint8)
    whole = list(suffix_dedup._anchors(text))
    kept = suffix_dedup._BLOCK
    try:
        suffix_dedup._BLOCK = 500
        parts = list(suffix_dedup._anchors(text))
    finally:
        suffix_dedup._BLOCK = kept

    def cover(found):
        return {(int(a) - int(d), int(a)) for anchor, near, far, _, _ in found for a, n, f in zip(anchor, near, far) for d in range(n, f + 1)}

    assert cover(parts) == cover(whole) and len(cover(whole)) == 2801


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "x" * 5000)]])
def test_small_tables(spark, rows):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute(rows)
