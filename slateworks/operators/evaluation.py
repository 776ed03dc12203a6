"""Evaluation of saved predictions: decide on val, measure on every split, write what came out."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateworks.operators import metrics, responses
from slateworks.operators.filters import nullable_prediction
from slateworks.sources.datasets import write_json


def evaluate(predictions: DataFrame, ks: tuple[int, ...] = (1, 5, 10), tune: bool = True) -> dict:
    """Metrics by split of predictions(split, user_id, candidate_group, y, score[, prediction]).

    With tune the threshold that is best on val for the mean over users of their groups' F1 decides; else prediction does.
    """
    out: dict = {}
    if tune:
        best = metrics.best_group_threshold(predictions.where("split = 'val'"), "f1", ("candidate_group",), "user_id").first()
        out["threshold"] = best["threshold"]
        yes = F.lit(0) if best["threshold"] is None else (F.col("score") >= best["threshold"]).cast("int")
        predictions = predictions.withColumn("prediction", yes)
    for name in sorted(r["split"] for r in predictions.select("split").distinct().collect()):
        part = predictions.where(F.col("split") == name)
        groups = metrics.ranking_by_group(part, ("user_id", "candidate_group"), ks, failed_as_zero=True)
        out[name] = {"micro": metrics.micro(part).first().asDict(), "macro_user": metrics.macro_by_user(part, "user_id", "candidate_group").first().asDict(), "ranking": metrics.ranking_by_user(groups, "user_id", ks).first().asDict()}
    return out


def evaluate_run(spark: SparkSession, folder: str, dry_run: bool = False, force: bool = False) -> dict | None:
    """Evaluates folder/predictions.parquet and writes folder/metrics.json; None if that is there already and force is off."""
    target = Path(folder, "metrics.json")
    if target.exists() and not force:
        return None
    found = evaluate(spark.read.parquet(f"{folder}/predictions.parquet"))
    if not dry_run:
        write_json({"metrics": found}, str(target))
    return found


def listwise_bundle(rows: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> dict:
    """Of rows(split, user_id, candidate_group, y, score), score null where an answer failed: the threshold that is best on the
    answered rows of val, and for val and test the metrics of what was answered and strict ones.

    Strict: a failed row predicts no, a group with a failed row ranks as zero.
    """
    best = metrics.best_group_threshold(rows.where("split = 'val' AND score IS NOT NULL"), "f1", ("candidate_group",), "user_id").first()
    threshold = best["threshold"] if best else None
    judged, out = nullable_prediction(rows, threshold), {"threshold": threshold}
    group = ("user_id", "candidate_group")
    for name in ("val", "test"):
        part = judged.where(F.col("split") == name)
        done = part.where("prediction IS NOT NULL")
        ranked = lambda strict, part=part: metrics.ranking_by_user(metrics.ranking_by_group(part, group, ks, failed_as_zero=strict), "user_id", ks).first().asDict()
        pointwise = lambda df: {"micro": metrics.micro(df).first().asDict(), "macro_user": metrics.macro_by_user(df, "user_id", "candidate_group").first().asDict()}
        out[name] = {"answered": pointwise(done), "failure_as_negative": pointwise(part), "ranking": ranked(False), "ranking_failed_as_zero": ranked(True), "coverage": responses.coverage(part).first().asDict()}
    return out


def runs_below(root: str) -> list[str]:
    """Folders below root that hold predictions, in order."""
    return sorted(str(p.parent) for p in Path(root).rglob("predictions.parquet"))


def evaluate_runs(spark: SparkSession, root: str, dry_run: bool = False, force: bool = False) -> dict[str, dict | None]:
    """evaluate_run of each run below root, by folder; what is there already stays unless force is on, a dry run writes nothing."""
    return {folder: evaluate_run(spark, folder, dry_run, force) for folder in runs_below(root)}


def write_policy_metrics(agreement: dict, tables: dict[str, DataFrame], folder: str, name: str) -> str:
    """folder/name/policy_metrics.json: the agreement and small tables of a task's policies, a row for each policy."""
    path = f"{folder}/{name}/policy_metrics.json"
    write_json({"task": name, "agreement": agreement, **{k: [r.asDict() for r in t.collect()] for k, t in tables.items()}}, path)
    return path
