"""Toxicity classifier with a counterfactual penalty: swapping an identity term in a labelled text must not move its score.

A logistic regression over the words of a text and their beginnings, present or not. It is fitted on the driver, on a
bounded sample of the labelled rows (SAMPLE_ROWS, the rows with the smallest hashes of doc_id; near-copies count once), by
proximal gradient steps on log loss + L1 + COUNTERFACTUAL * mean (change of the logit when a term is swapped)^2. Weights of
other features stay non-negative, so that no clean word can hide an insult. Scoring reads every whole text.

Terms are those listed (a parameter) and those found: words that go with the label, yet are used in both, as names of
groups are. Each is swapped for a word of its slot: the next of its list, or, if found, the word nearest in frequency that
does not go with the label and follows the same word most often. Swaps are made in every sampled text that holds a term,
and each term and its counterpart are put into some clean texts as well.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slateworks.llm._common import Scratch, bounded_batches

SAMPLE_ROWS, MAX_FEATURES, MIN_Z, MIN_DOCS = 16_000, 3_000, 4.0, 4
COUNTERFACTUAL, L1, STEPS, RATE = 4.0, 2e-4, 600, 2.0
THRESHOLD = 0.3
#: Found terms: texts of each label that hold one at least, how many at most, and the z up to which a counterpart is neutral.
SPREAD, MAX_TERMS, NEUTRAL_Z = 5, 500, 1.0
#: Clean texts that each term and its counterpart are put into.
INSERTED = 5
PREFIXES = (4, 5, 6, 7)
#: Terms that name a group of people, by the kind of group within which they are swapped.
IDENTITY_TERMS = {
    "religion": ["muslim", "muslims", "jewish", "jews", "christian", "christians", "hindu", "buddhist", "atheist", "catholic", "musulman", "juif", "muslimisch", "jüdisch", "musulmán", "judío"],
    "origin": ["african", "asian", "american", "european", "arab", "mexican", "chinese", "indian", "black", "white", "latino", "immigrant", "immigrants", "refugee", "refugees", "noir", "schwarz", "negro"],
    "gender": ["woman", "women", "man", "men", "female", "male", "girl", "boy", "femme", "homme", "frau", "mann", "mujer", "hombre"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "transgender", "trans", "queer", "heterosexual", "homosexual"],
    "ability": ["blind", "deaf", "disabled", "autistic", "elderly", "old", "young"],
}
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """Weights of features, bias, the counterpart of each term, and the pairs of texts that the penalty compared."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    counterparts: dict[str, str] = field(default_factory=dict)
    pairs: int = 0


def listed(terms: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """The counterpart of each term: the next one of its list. A term of two lists has that of the first."""
    out: dict[str, str] = {}
    for group in terms.values():
        for i, term in enumerate(group):
            if len(group) > 1:
                out.setdefault(term, group[(i + 1) % len(group)])
    return out


def features(words: set[str], terms: Mapping[str, str]) -> set[str]:
    """The words, and the beginnings of longer ones as word- . Terms give no beginnings."""
    out = set(words)
    for w in words:
        if w not in terms:
            out.update(f"{w[:n]}-" for n in PREFIXES if len(w) > n)
    return out


def swapped(words: set[str], terms: Mapping[str, str]) -> set[str] | None:
    """The words with each term replaced by its counterpart; None without any term."""
    present = {w for w in words if w in terms}
    return (words - present) | {terms[w] for w in present} if present else None


def counterfactuals(rows: list[tuple[int, set[str]]], terms: Mapping[str, str]) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets that should score alike: texts and themselves swapped, clean texts with a term and with its counterpart."""
    pairs = [(words, other) for _, words in rows if (other := swapped(words, terms)) is not None]
    clean = [words for label, words in rows if not label]
    for i, term in enumerate(sorted(terms)):
        for k in range(min(INSERTED, len(clean))):
            words = clean[(i * INSERTED + k) % len(clean)]
            pairs.append((words | {term}, words | {terms[term]}))
    return pairs


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, label, text in zip(batch["doc_id"], batch["label"], batch["text"]):
            words = _words(text)
            shingles = {zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))}
            # Two minima: a passage that texts share does not make them copies.
            copy = min(shingles) << 31 ^ min(h * 0x9E3779B1 & 0x7FFFFFFF for h in shingles)
            rows.append((int(doc), int(label), copy, words))
        yield pd.DataFrame(rows, columns=["doc_id", "label", "copy", "words"])


def _loss(w: np.ndarray, b: float, rows: tuple, y: np.ndarray, plus: tuple, minus: tuple, m: int, counterfactual: float) -> tuple[float, np.ndarray, float]:
    """Mean log loss plus the penalty, and its gradient by weights and bias; rows, plus, minus: row and column numbers."""
    n, k = len(y), len(w)
    z = np.clip(b + np.bincount(rows[0], w[rows[1]], n), -30, 30)
    p = 1 / (1 + np.exp(-z))
    loss = float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    error = (p - y) / n
    grad = np.bincount(rows[1], error[rows[0]], k)
    if m:
        gap = np.bincount(plus[0], w[plus[1]], m) - np.bincount(minus[0], w[minus[1]], m)
        loss += counterfactual * float(np.mean(gap**2))
        grad = grad + 2 * counterfactual / m * (np.bincount(plus[1], gap[plus[0]], k) - np.bincount(minus[1], gap[minus[0]], k))
    return loss, grad, float(error.sum())


def _sparse(sets: list[set[str]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [(r, index[f]) for r, s in enumerate(sets) for f in sorted(s) if f in index]
    flat = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return flat[:, 0], flat[:, 1]


def _fit(rows: list[tuple[int, set[str]]], vocabulary: list[str], terms: Mapping[str, str], counterfactual: float) -> Model:
    """The model fitted to (label, words)."""
    index = {f: i for i, f in enumerate(vocabulary)}
    free = np.array([f in terms for f in vocabulary], dtype=bool)
    y = np.array([label for label, _ in rows], dtype=float)
    n, k = len(rows), len(vocabulary)
    own = _sparse([features(w, terms) for _, w in rows], index)
    both = [(features(w, terms), features(s, terms)) for w, s in counterfactuals(rows, terms)]
    plus, minus = _sparse([a - b for a, b in both], index), _sparse([b - a for a, b in both], index)
    w, b = np.zeros(k), math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    gw, gb = np.full(k, 1e-8), 1e-8
    for _ in range(STEPS if k else 0):
        _, grad, error = _loss(w, b, own, y, plus, minus, len(both), counterfactual)
        gw += grad**2
        gb += error**2
        step = RATE / np.sqrt(gw) / 10
        w = w - step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
        w = np.where(free, w, np.maximum(w, 0))
        b -= RATE / math.sqrt(gb) / 10 * error
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-4}, float(b), dict(terms), len(both))


def _found(sample: DataFrame, scored: DataFrame) -> dict[str, str]:
    """Counterparts of found terms, scored: (feature, a, df, z). At most MAX_TERMS terms and as many neutral words reach the driver."""
    spread = scored.where(~F.col("feature").endswith("-") & (F.col("a") >= SPREAD) & (F.col("df") - F.col("a") >= SPREAD))
    terms = spread.where(F.col("z") >= MIN_Z).orderBy(F.desc("df"), "feature").limit(MAX_TERMS)
    neutral = spread.where(F.abs("z") <= NEUTRAL_Z).orderBy(F.desc("df"), "feature").limit(MAX_TERMS)
    seen = {r["feature"]: (r["df"], r["z"] >= MIN_Z) for r in terms.union(neutral).select("feature", "df", "z").collect()}

    def slotted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(b, a) for words in batch["words"] for a, b in {(a, b) for a, b in zip(words, words[1:]) if b in seen}]
            yield pd.DataFrame(rows, columns=["feature", "slot"])

    counts = sample.select("words").mapInPandas(slotted, "feature string, slot string").groupBy("feature", "slot").agg(F.count(F.lit(1)).alias("n"))
    slots = {r["feature"]: r["slot"] for r in counts.groupBy("feature").agg(F.min_by("slot", F.struct(-F.col("n"), F.col("slot"))).alias("slot")).collect()} if seen else {}
    out = {}
    for word, (df, term) in seen.items():
        if term:
            others = [(slots.get(x) != slots.get(word), abs(d - df), x) for x, (d, t) in seen.items() if not t]
            if others:
                out[word] = min(others)[2]
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, counterfactual: float = COUNTERFACTUAL, terms: Mapping[str, Sequence[str]] = IDENTITY_TERMS) -> Model:
    """A model learned from labels(doc_id, toxic) whose crc32(doc_id as text) mod 4 is not 2, and the texts of docs.

    terms: identity terms by the kind of group within which they are swapped, besides those found in the sample.
    Rows with a null doc_id, a label other than 0 or 1, or no document give nothing to learn from. Without any row left
    the model has no weights and bias 0: all texts score 0.5, and none is rejected (see rejects). Of copies with the same
    label the smallest doc_id is learned from, so reruns agree. What reaches the driver is at most sample_rows rows of at
    most MAX_FEATURES words and the terms.
    """
    scratch = Scratch(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    chosen = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most sample_rows rows of two numbers are broadcast.
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    drawn = joined.mapInPandas(_sampled, "doc_id long, label int, copy long, words array<string>")
    once = drawn.groupBy("copy", "label").agg(F.min_by("words", F.struct("doc_id", "words")).alias("words")).select("label", "words")
    sample = scratch.cut(once, "toxicity-sample")
    counts = sample.groupBy().agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    n, pos = counts["n"], counts["pos"] or 0
    if not n:
        return Model()

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "features": [sorted(features(set(w), {})) for w in batch["words"]]})

    each = sample.select("label", "words").mapInPandas(featured, "label int, features array<string>").select("label", F.explode("features").alias("feature"))
    with_ = each.groupBy("feature").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("df")).where(F.col("df") >= MIN_DOCS)
    share = (F.col("df") / n).cast("double")
    z = (F.col("a") - F.col("df") * (pos / n)) / F.sqrt(F.col("df") * (pos / n) * (1 - pos / n) * F.greatest(1 - share, F.lit(1 / n)) + 1e-9)
    judged = scratch.cut(with_.withColumn("z", z), "toxicity-features")
    counterparts = listed(terms) | _found(sample, judged)
    best = judged.where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
    vocabulary = sorted({r["feature"] for r in best.select("feature").collect()} | set(counterparts))
    starts = {f[:-1] for f in vocabulary if f.endswith("-")}

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = set(vocabulary)
        for batch in batches:
            words = [[w for w in set(ws) if w in keep or any(w[:k] in starts for k in PREFIXES)] for ws in batch["words"]]
            yield pd.DataFrame({"label": batch["label"], "words": words})

    rows = [(r["label"], set(r["words"])) for r in sample.select("label", "words").mapInPandas(needed, "label int, words array<string>").collect()]
    rows.sort(key=lambda r: (r[0], sorted(r[1])))
    return _fit(rows, vocabulary, counterparts, counterfactual)


def score_text(text: str | None, model: Model) -> float:
    """Probability of label 1; texts without known words, empty ones too, get the bias alone."""
    z, weights = model.bias, model.weights
    if text and weights:
        words = set(_words(text))
        seen: set[str] = set()
        for w in sorted(words):
            if (v := weights.get(w)) is not None:
                z += v
            if len(w) > 4 and w not in model.counterparts:
                for n in PREFIXES:
                    if len(w) > n and (start := w[:n] + "-") in weights:
                        seen.add(start)
        z += sum(weights[s] for s in sorted(seen))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def rejects(model: Model, score: Column | float) -> Column | bool:
    """Whether a text with this score is taken for toxic; a model without weights tells no texts apart and rejects none."""
    return score >= THRESHOLD if model.weights else (F.lit(False) if isinstance(score, Column) else False)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id of every row of docs, and its score."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(t, model) for t in texts], dtype=float)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text").cast("string")).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, terms: Mapping[str, Sequence[str]] = IDENTITY_TERMS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text).

    held_out: crc32(doc_id as text) mod 4 is 2 (false for a null doc_id). predicted: score >= THRESHOLD, 0 for all rows
    where there was nothing to learn from. Null and empty texts score as a text without known words. Repeated rows give
    repeated results, other columns are not read, an empty table gives an empty result.
    """
    model = train(docs, labels, terms=terms)
    out = scored(docs, model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", rejects(model, F.col("score")).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, terms: Mapping[str, Sequence[str]] = IDENTITY_TERMS) -> DataFrame:
    """The rows of docs(doc_id, text, ..) that are not predicted toxic, with all their columns.

    Null and empty texts stay, as nothing in them is toxic; repeated rows fare alike; rows with a null doc_id are judged as
    others. All rows stay where there was nothing to learn from; an empty table gives an empty result.
    """
    model = train(docs, labels, terms=terms)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not t or not rejects(model, score_text(t, model)) for t in texts], dtype=bool)

    return docs.where(clean(F.col("text").cast("string")))
