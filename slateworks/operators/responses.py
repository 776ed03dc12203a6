"""Text-model answers: prompts, a client that is passed in, strict parsing, retries with a budget, repeated runs and votes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS, BUDGET_SHARE, BUDGET_AFTER = 5, 0.10, 20


class BudgetExceeded(RuntimeError):
    pass


class ErrorBudget:
    """Stops a run when over a tenth of at least twenty attempts failed; finish() checks in any case."""

    def __init__(self, share: float = BUDGET_SHARE, after: int = BUDGET_AFTER):
        self.share, self.after, self.attempts, self.errors = share, after, 0, 0

    def record(self, failed: bool) -> None:
        self.attempts += 1
        self.errors += failed
        if self.attempts >= self.after:
            self.finish()

    def finish(self) -> None:
        if self.attempts and self.errors / self.attempts > self.share:
            raise BudgetExceeded(f"{self.errors} of {self.attempts} answers failed")


def labelled_candidates(rows: DataFrame, order: str, *group: str) -> DataFrame:
    """rows with label C1, C2, .. in their group's order."""
    return rows.withColumn("label", F.concat(F.lit("C"), F.row_number().over(Window.partitionBy(*group).orderBy(order)).cast("string")))


def prompts(candidates: DataFrame, history: DataFrame, describe: Column, *group: str) -> DataFrame:
    """(group, prompt): the history of the user and the labelled candidates of the group, and what to answer.

    candidates: group, user_id, label, and what describe reads; history: user_id, position, line.
    """
    past = history.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("past")).select("user_id", F.array_join(F.transform("past", lambda x: x["line"]), "\n").alias("past"))
    number = F.substring("label", 2, 10).cast("int")
    asked = candidates.groupBy("user_id", *(g for g in group if g != "user_id")).agg(F.sort_array(F.collect_list(F.struct(number.alias("n"), F.concat_ws(" ", "label", describe).alias("line")))).alias("asked"))
    lines = F.array_join(F.transform("asked", lambda x: x["line"]), "\n")
    text = F.concat(F.lit("What this person chose before:\n"), F.coalesce("past", F.lit("nothing known")), F.lit("\n\nWould they choose each of these?\n"), lines, F.lit("\n\nAnswer with a line for each, as C1: yes or C1: no."))
    return asked.join(past, "user_id", "left").select(*group, text.alias("prompt"))


def ask(requests: DataFrame, client: Callable[[], Callable[[str], str]], accept: Callable[..., bool], attempts: int = MAX_ATTEMPTS, share: float | None = None) -> DataFrame:
    """requests(prompt, ..) with answer, tries and error. client makes, in each task, a function from prompt to answer.

    An answer that accept turns down, or an exception, is tried again; after the last try answer is null and error tells why.
    accept gets the answer, and n of the request where there is one. With a share, a task of which more than that share of
    answers failed asks no further: its other requests fail without a try.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, budget, spent = client(), ErrorBudget(share if share is not None else 1.0), None
        for batch in batches:
            rows = []
            sizes = [(int(n),) for n in batch["n"]] if "n" in batch else [()] * len(batch)
            for prompt, n in zip(batch["prompt"], sizes):
                answer, error, tries = None, spent, 0
                while spent is None and answer is None and tries < attempts:
                    tries += 1
                    try:
                        given = call(prompt)
                        answer, error = (given, None) if accept(given, *n) else (None, "not accepted: " + given[:200])
                    except Exception as failure:  # noqa: BLE001 - whatever the endpoint raises is a failed attempt
                        error = f"{type(failure).__name__}: {failure}"
                rows.append((answer, tries, error))
                if spent is None:
                    try:
                        budget.record(answer is None)
                    except BudgetExceeded as failure:
                        spent = f"not asked: {failure}"
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=["answer", "tries", "error"])], axis=1)

    return requests.mapInPandas(run, f"{fields}, answer string, tries int, error string")


def check_budget(asked: DataFrame, share: float = BUDGET_SHARE) -> None:
    """BudgetExceeded if more than that share of all answers failed."""
    row = asked.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed")).first()
    budget = ErrorBudget(share)
    budget.attempts, budget.errors = row["n"], row["failed"]
    budget.finish()


def parse_yes_no(answers: DataFrame, answer: str, n: str | Column, *group: str) -> DataFrame:
    """(group, label, y) for answers with a line 'Ck: yes' or 'Ck: no' for each of C1 .. Cn; null y if anything else is there.

    Blank lines are ignored. One line without a colon, an unknown or repeated label, or another word fails the whole answer.
    """
    n = F.col(n) if isinstance(n, str) else n
    lines = F.filter(F.split(F.coalesce(F.col(answer), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    label = F.transform(lines, lambda x: F.regexp_extract(F.trim(x), r"^(?i)(C[0-9]+)\s*:\s*(?:yes|no)\s*$", 1))
    word = F.transform(lines, lambda x: F.lower(F.regexp_extract(F.trim(x), r"^(?i)C[0-9]+\s*:\s*(yes|no)\s*$", 1)))
    wanted = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("C"), i.cast("string")))
    df = answers.select(*group, F.transform(label, F.upper).alias("_label"), word.alias("_word"), wanted.alias("_wanted"))
    valid = F.sort_array("_label") == F.sort_array("_wanted")
    each = df.withColumn("_valid", valid).select(*group, "_valid", "_label", "_word", F.explode("_wanted").alias("label"))
    at = F.array_position("_label", F.col("label"))
    return each.select(*group, "label", F.when(F.col("_valid"), (F.try_element_at("_word", at.cast("int")) == "yes").cast("int")).alias("y"))


def parse_single(answer: Column) -> Column:
    """1 for yes, 0 for no, in any case and with blanks around; null for all else."""
    text = F.lower(F.trim(answer))
    return F.when(text == "yes", 1).when(text == "no", 0)


def parse_ranking(answers: DataFrame, answer: str, n: str | Column, *group: str) -> DataFrame:
    """(group, label, rank, score): all labels found, in order, must be C1 .. Cn once each; score is n - rank. Else null."""
    n = F.col(n) if isinstance(n, str) else n
    found = F.regexp_extract_all(F.coalesce(F.col(answer), F.lit("")), F.lit(r"\b(C[0-9]+)\b"))
    wanted = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("C"), i.cast("string")))
    df = answers.select(*group, n.alias("_n"), found.alias("_found"), wanted.alias("_wanted"))
    each = df.select(*group, "_n", "_found", (F.sort_array("_found") == F.sort_array("_wanted")).alias("_valid"), F.explode("_wanted").alias("label"))
    rank = F.when(F.col("_valid"), F.array_position("_found", F.col("label")))
    return each.select(*group, "label", rank.cast("long").alias("rank"), (F.col("_n") - rank).cast("long").alias("score"))


def parse_integer(answer: Column, allowed: list[int]) -> Column:
    """A bare whole number among those allowed; null for all else."""
    text = F.trim(answer)
    number = F.when(text.rlike(r"^[+-]?[0-9]{1,9}$"), text.cast("int"))
    return F.when(number.isin(allowed), number)


def parse_rating(answer: Column, allowed: list[int]) -> Column:
    """A number after RATING:, given once, or a bare number; null for all else."""
    marked = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"(?i)\brating\s*:\s*([+-]?[0-9]{1,9})\b"))
    number = F.when(F.size(marked) == 1, F.get(marked, F.lit(0)).cast("int"))
    return F.when(F.size(marked) > 0, F.when(number.isin(allowed), number)).otherwise(parse_integer(answer, allowed))


def parse_decision(answer: Column, field: str) -> tuple[Column, Column]:
    """(y, reason) of a record 'FIELD: yes|no' with REASON: over one or more lines; null y where the field is not there once."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(rf"(?im)^\s*{field}\s*:\s*(yes|no)\s*$"))
    reason = F.trim(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?is)\breason\s*:\s*(.*?)(?=\n\s*[A-Z_]+\s*:|$)", 1))
    return F.when(F.size(found) == 1, (F.lower(F.get(found, F.lit(0))) == "yes").cast("int")), F.nullif(reason, F.lit(""))


def parse_taste(answer: Column) -> Column:
    """TASTE, REASON, HIGH and LOW blocks as one text joined by ' | '; null without a TASTE block."""
    block = lambda name: F.nullif(F.trim(F.regexp_extract(F.coalesce(answer, F.lit("")), rf"(?is)(?:^|\n)\s*{name}\s*:\s*(.*?)(?=\n\s*(?:TASTE|REASON|HIGH|LOW)\s*:|$)", 1)), F.lit(""))
    return F.when(block("TASTE").isNotNull(), F.concat_ws(" | ", *(block(b) for b in ("TASTE", "REASON", "HIGH", "LOW"))))


def batch_signatures(rows: DataFrame, order: str, ordered: bool, *group: str) -> DataFrame:
    """(group, signature, first): groups whose items are the same, in order or as a multiset, share a signature; first asks."""
    items = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), "item_id"))), lambda x: x["item_id"])
    signed = rows.groupBy(*group).agg(F.concat_ws("|", items if ordered else F.sort_array(items)).alias("signature"))
    at = F.row_number().over(Window.partitionBy("user_id", "signature").orderBy(*group))
    return signed.withColumn("first", at == 1)


def scoring_units(rows: DataFrame) -> DataFrame:
    """Each pair of user and item once."""
    return rows.select("user_id", "item_id").distinct()


def majority(votes: DataFrame, score: str, *key: str) -> DataFrame:
    """(key, score): 1 if more than half of the answered runs are above one half, 0 on a tie; null if all runs failed."""
    n, yes = F.count(score), F.count_if(F.col(score) > 0.5)
    return votes.groupBy(*key).agg(F.when(n == 0, None).otherwise((yes * 2 > n).cast("int")).alias("score"))


def with_failures_as_no(df: DataFrame, score: str = "score") -> DataFrame:
    return df.withColumn(score, F.coalesce(F.col(score), F.lit(0.0)))


def coverage(df: DataFrame, score: str = "score") -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count(score)
    return df.agg(n.alias("requested"), ok.alias("scored"), (n - ok).alias("failed"), F.when(n == 0, 0.0).otherwise(ok / n).alias("share"))


def fail_if_none(df: DataFrame, score: str = "score") -> DataFrame:
    """The rows with a score; RuntimeError without any."""
    out = df.where(F.col(score).isNotNull())
    if out.isEmpty():
        raise RuntimeError("no answer could be used")
    return out


def stub_client() -> Callable[[], Callable[[str], str]]:
    """A client for tests: answers every candidate line of the prompt by the parity of its checksum."""

    def make() -> Callable[[str], str]:
        import re
        import zlib

        def call(prompt: str) -> str:
            lines = re.findall(r"^(C\d+) (.*)$", prompt, re.M)
            return "\n".join(f"{label}: {'yes' if zlib.crc32(text.encode()) % 2 else 'no'}" for label, text in lines)

        return call

    return make
