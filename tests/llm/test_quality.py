import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from slateworks.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(n - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    chars, symbols, dups = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    upper = sum(any(c.isupper() for c in w) and not any(c.islower() for c in w) for w in words)
    letters = sum(any(c.isalpha() for c in w) for w in words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    rejected = symbols * 10 > n or upper * 2 > n or dups * 2 > len(lines) or chars < 2 * n or chars > 12 * n or letters * 2 < n
    return n, chars, symbols, dups, len(covered), failed, not failed and not rejected


def test_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    words = ["the", "quick", "fox", "Élan", "42", "##", "A", "|", "été", "over", "DOG", "🙂"] + [f"w{i}" for i in range(60)]
    texts = [None, "", " \n ", "a b", "a b c", "a b c a b c", "x\ny\nx\n\n \nx", "aaa " * 60, "LOUD!! WORD " * 20 + " ".join(f"Q{i}" for i in range(90)), "1 2 3 " + " ".join(map(str, range(100))), "w " * 30_000]
    for n in (50, 60, 120, 400):
        for pool in (words, words[:30], words[12:]):
            texts.append("".join(w + rng.choice([" ", "\n", "  ", "\t"], p=[0.85, 0.08, 0.04, 0.03]) for w in rng.choice(pool, n)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = sorted(map(tuple, quality.quality(df).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=str)
    assert quality.quality(df.limit(0)).count() == 0
    assert quality.quality(df).where("kept").count() == sum(brute(t)[-1] for _, t in rows)


def test_order_is_by_rejection_per_cost(spark):
    rows = [(i, " ".join(f"word{j}#" for j in range(60))) for i in range(30)]
    assert quality.order(spark.createDataFrame(rows, "doc_id long, text string"))[0] == "symbols"


def test_cascade_counts_what_is_left():
    patterns = [({"a", "b"}, 50), ({"b"}, 10), ({"c"}, 30), (set(), 100)]
    assert quality.cascade(patterns, {"a": 1.0, "b": 2.0, "c": 1.0}) == ["a", "c", "b"]
    assert quality.cascade(patterns, {"a": 1.0, "b": 1.0, "c": 1.0}) == ["b", "c", "a"]
    assert quality.cascade([], {"b": 1.0, "a": 5.0}) == ["a", "b"]
