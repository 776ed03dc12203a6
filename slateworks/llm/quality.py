"""Quality rules as a short-circuit cascade: the rule that rejects most for its cost is asked first, and the rest only of what is left.

All in Spark's own expressions. The order comes from a drawn sample: each rule's time there, net of a job without any rule,
and how many documents it rejects of those that the rules before it leave. The verdict is the same in any order; only the
work differs.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slateworks.llm._common import WORD_PATTERN

#: Documents of the sample from which the order of the rules is estimated; it has no part in any verdict.
SAMPLE_ROWS, SAMPLE_SEED = 1_000, 17
#: A rule is timed on the sample so many times over, and that again and again, of which the shortest counts.
TIMES, REPEATS = 20, 3
MIN_WORDS = 50
_TEXT, _WORDS, _LINES = "_q_text", "_q_words", "_q_lines"
_UPPER_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{Ll}]*\p{Lu}[^\x20\x09-\x0D\p{Ll}]*+(?![^\x20\x09-\x0D])"
_LETTER_WORD = r"[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*+"
_SYMBOLS = "[#*$%&|<>]"


def rules() -> dict[str, Column]:
    """Name -> whether a document is rejected. They read the columns that measured() adds."""
    text, words = F.col(_TEXT), F.col("n_words")
    return {
        # more than a symbol for every ten words
        "symbols": F.col("n_symbols") * 10 > words,
        # most words without small letters
        "shouting": F.regexp_count(text, F.lit(_UPPER_WORD)) * 2 > words,
        # most lines said before
        "repeated_lines": F.col("n_dup_lines") * 2 > F.size(_LINES),
        # words of under 2 or over 12 code points on average
        "word_length": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 12 * words),
        # most words without any letter
        "letters": F.regexp_count(text, F.lit(_LETTER_WORD)) * 2 < words,
    }


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once: a filter that Spark pushes below the columns cannot multiply it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words of the array are in windows of three that occur twice or more in it."""

    def covered(positions: Column) -> Column:
        gaps = F.zip_with(positions, F.slice(positions, 2, F.greatest(F.size(positions), F.lit(1))), lambda a, b: F.least(F.lit(3), b - a))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    def again(ranked: Column) -> Column:
        beside = lambda k: F.get(ranked, k)["h"]
        found = F.filter(ranked, lambda x, k: (x["h"] == beside(k - 1)) | (x["h"] == beside(k + 1)))
        return _let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def of_windows(keys: Column) -> Column:
        ranked = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), _let(ranked, again)).otherwise(0)

    def of_words(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1)))
        keys = F.transform(starts, lambda i: F.xxhash64(F.try_element_at(w, i), F.try_element_at(w, i + 1), F.try_element_at(w, i + 2)))
        return F.when(F.size(w) >= 3, _let(keys, of_windows)).otherwise(0)

    return _let(words, of_words).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base rules, base_failed, and what the other rules read."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias(_TEXT))
    df = df.withColumn(_WORDS, F.regexp_extract_all(_TEXT, F.lit(f"({WORD_PATTERN})")))
    df = df.withColumn(_LINES, F.filter(F.split(_TEXT, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        "doc_id",
        F.size(_WORDS).cast("long").alias("n_words"),
        F.aggregate(_WORDS, F.lit(0), lambda s, w: s + F.char_length(w)).cast("long").alias("word_chars"),
        F.regexp_count(_TEXT, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(_LINES) - F.size(F.array_distinct(_LINES))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(_WORDS)).alias("n_repeat_words"),
        _TEXT,
        _LINES,
    )
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def cascade(patterns: list[tuple[set[str], int]], seconds: dict[str, float]) -> list[str]:
    """Rules in the order of documents rejected per second among those left by the rules before; by name where none rejects.

    patterns: which rules reject a document, and how many documents are like that.
    """
    left, out = patterns, []
    while len(out) < len(seconds):
        gain = {name: sum(n for hit, n in left if name in hit) / seconds[name] for name in seconds if name not in out}
        out.append(min(gain, key=lambda name: (-gain[name], name)))
        left = [(hit, n) for hit, n in left if out[-1] not in hit]
    return out


def order(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules in the cascade's order, from about sample_rows rows drawn from the whole table; by name on an empty one."""
    found, n = rules(), docs.count()
    drawn = docs.select("doc_id", "text").sample(min(1.0, sample_rows / max(1, n)), SAMPLE_SEED).repartition(4)
    sample = measured(drawn).where("NOT base_failed").persist()
    try:
        rows = sample.groupBy(*(rule.alias(name) for name, rule in found.items())).agg(F.count(F.lit(1)).alias("_n")).collect()
        many = sample.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

        def took(rule: Column) -> float:
            best = float("inf")
            for _ in range(REPEATS):
                began = time.perf_counter()
                many.agg(F.sum(rule.cast("long"))).first()
                best = min(best, time.perf_counter() - began)
            return best

        empty = took(F.col("base_failed"))
        seconds = {name: max(took(rule) - empty, 1e-3) for name, rule in found.items()}
    finally:
        sample.unpersist()
    return cascade([({name for name in found if r[name]}, r["_n"]) for r in rows], seconds)


def quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row of docs(doc_id, text).

    kept: neither base_failed nor rejected by a rule of the cascade. A null text counts as empty, which base_failed rejects;
    repeated rows give repeated results; other columns are not read; an empty table gives an empty result.
    """
    found, verdict = rules(), F.when(F.col("base_failed"), False)
    for name in order(docs, sample_rows):
        verdict = verdict.when(found[name], False)
    out = measured(docs).withColumn("kept", verdict.otherwise(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT rid, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}'))) AS upper_words,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS letter_words
  FROM d LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR 2 * upper_words > n_words OR 2 * n_dup_lines > n_lines
         OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 2 * letter_words < n_words) AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
"""
