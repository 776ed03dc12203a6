import zlib

import numpy as np
from pyspark.sql import functions as F

from slateworks.llm import toxicity


def corpus(n=1200):
    rng = np.random.default_rng(2)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text, toxic = list(rng.choice(words, 40)), int(rng.random() < 0.25)
        if toxic:
            text += list(rng.choice(["zzbad" + s for s in ("", "ly", "er", "ness")] + ["qfoul"], 2))
            if rng.random() < 0.6:
                text.append("muslim")
        elif rng.random() < 0.03:
            text.append("jewish")
        docs.append((i, " ".join(rng.permutation(text))))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy_and_identity_terms(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("label", F.lit("x"))
    y = spark.createDataFrame([(*r, 1) for r in labels] + [(None, 1, 1), (99999, 1, 1), (5, None, 0)], "doc_id long, toxic int, quality int")
    rows = toxicity.toxicity(d, y).collect()
    truth = dict(labels)
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out]) > 0.97
    fair, plain = toxicity.train(d, y), toxicity.train(d, y, counterfactual=0.0)
    gap = lambda m: abs(toxicity.score_text("a muslim neighbour", m) - toxicity.score_text("a jewish neighbour", m))
    assert gap(fair) < 0.5 * gap(plain) and toxicity.score_text("a muslim neighbour", fair) < 0.3
    kept = toxicity.without_toxic(d, y)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_odd_rows(spark):
    docs, labels = corpus(200)
    odd = [(None, "zzbad"), (7, None), (8, ""), (9, "w " * 200_000 + "zzbadly"), (9, "w")]
    d = spark.createDataFrame(docs + [(10_000 + i, t) for i, (_, t) in enumerate(odd)] + odd[:1], "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(d, y).collect()}
    assert rows[10_001].score == rows[10_002].score == rows[10_004].score and rows[10_003].score > rows[10_004].score and rows[None].held_out is False
    assert toxicity.toxicity(d.limit(0), y).count() == 0
    untrained = toxicity.toxicity(d, y.limit(0)).collect()
    assert {r.score for r in untrained} == {0.5}


def test_nothing_is_rejected_where_nothing_was_learned(spark):
    d = spark.createDataFrame([(1, "a clean text"), (2, None), (3, "")], "doc_id long, text string")
    for y in ([], [(99, 1), (98, 0)]):
        labels = spark.createDataFrame(y, "doc_id long, toxic int")
        assert {r.predicted for r in toxicity.toxicity(d, labels).collect()} == {0}
        assert toxicity.without_toxic(d, labels).count() == 3


def test_swaps_are_between_counterparts():
    terms = toxicity.listed({"x": ["a", "b", "c"], "y": ["c", "d"], "z": ["alone"]})
    assert terms == {"a": "b", "b": "c", "c": "a", "d": "c"}
    assert toxicity.swapped({"a", "d", "w"}, terms) == {"b", "c", "w"} and toxicity.swapped({"w"}, terms) is None
    assert toxicity.features({"abcdef", "w"}, {}) == {"abcdef", "w", "abcd-", "abcde-"} and toxicity.features({"abcdef"}, {"abcdef": "w"}) == {"abcdef"}
    rows = [(0, {"w"}), (0, {"v"}), (1, {"a", "u"})]
    pairs = toxicity.counterfactuals(rows, {"a": "b"})
    assert pairs == [({"a", "u"}, {"b", "u"}), ({"w", "a"}, {"w", "b"}), ({"v", "a"}, {"v", "b"})]


def test_gradient_and_score_match_brute_force():
    rng = np.random.default_rng(4)
    vocabulary = [f"f{i}" for i in range(12)]
    sets = [(int(rng.random() < 0.4), {f for f in vocabulary if rng.random() < 0.3}) for _ in range(40)]
    terms = {"f0": "f1", "f1": "f2"}
    index = {f: i for i, f in enumerate(vocabulary)}
    y = np.array([a for a, _ in sets], dtype=float)
    both = toxicity.counterfactuals(sets, terms)
    rows = toxicity._sparse([x for _, x in sets], index)
    plus, minus = toxicity._sparse([a - b for a, b in both], index), toxicity._sparse([b - a for a, b in both], index)
    w, b = rng.normal(size=12), 0.3

    def loss(w, b):
        logit = lambda words: b + sum(w[index[f]] for f in words)
        fit = [np.log1p(np.exp(-logit(x))) if a else np.log1p(np.exp(logit(x))) for a, x in sets]
        return np.mean(fit) + 3.0 * np.mean([(logit(p) - logit(q)) ** 2 for p, q in both])

    got, grad, gb = toxicity._loss(w, b, rows, y, plus, minus, len(both), 3.0)
    assert abs(got - loss(w, b)) < 1e-9
    for i in range(12):
        e = np.eye(12)[i] * 1e-6
        assert abs((loss(w + e, b) - loss(w - e, b)) / 2e-6 - grad[i]) < 1e-5
    assert abs((loss(w, b + 1e-6) - loss(w, b - 1e-6)) / 2e-6 - gb) < 1e-5
    model = toxicity.Model({"abcdef": 1.0, "abcd-": 0.5, "term": -0.25, "term-": 9.0}, -1.0, {"terms": "others"})
    for text, z in (("Abcdef abcdef", 0.5), ("abcdxyz, TERM", -0.75), ("terms", -1.0), ("", -1.0), (None, -1.0)):
        assert abs(toxicity.score_text(text, model) - 1 / (1 + np.exp(-z))) < 1e-12


def test_the_penalty_acts_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fair, plain = toxicity.train(d, y), toxicity.train(d, y, counterfactual=0.0)
    found = fair.counterparts.keys() - toxicity.listed(toxicity.IDENTITY_TERMS).keys()
    assert found and fair.pairs == plain.pairs > 0
    square = lambda m: sum(m.weights.get(t, 0.0) ** 2 for t in found)
    assert square(fair) < 0.01 * square(plain)
    again = toxicity.train(d.repartition(7), y.repartition(3))
    assert again == fair
    rows = toxicity.scored(d, fair).join(y, "doc_id").where("crc32(cast(doc_id AS string)) % 4 = 2").collect()
    toxic, clean = [r.score >= 0.3 for r in rows if r.toxic], [r.score >= 0.3 for r in rows if not r.toxic]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02
