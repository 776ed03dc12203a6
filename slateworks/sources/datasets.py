"""Canonical data sets on disk: users, items and interactions as Parquet, and a manifest that tells where they came from."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMON = ("name", "version", "sources", "tables", "targets", "caveats", "schema_version")


@dataclass(frozen=True)
class CanonicalDataset:
    name: str
    version: str
    root: str

    def _load(self, spark: SparkSession, table: str, columns: list[str] | None) -> DataFrame:
        df = spark.read.parquet(f"{self.root}/{table}.parquet")
        return df.select(*columns) if columns else df

    def users(self, spark: SparkSession, columns: list[str] | None = None) -> DataFrame:
        return self._load(spark, "users", columns)

    def items(self, spark: SparkSession, columns: list[str] | None = None) -> DataFrame:
        return self._load(spark, "items", columns)

    def interactions(self, spark: SparkSession, columns: list[str] | None = None) -> DataFrame:
        return self._load(spark, "interactions", columns)

    def manifest(self) -> dict:
        return json.loads(Path(self.root, "manifest.json").read_text())

    def write(self, tables: dict[str, DataFrame], manifest: dict, max_rows: int = 100_000) -> dict:
        """Writes the three tables in files of at most max_rows rows, and the manifest with their row counts."""
        for name in ("users", "items", "interactions"):
            tables[name].write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(f"{self.root}/{name}.parquet")
        spark = tables["users"].sparkSession
        counts = {n: spark.read.parquet(f"{self.root}/{n}.parquet").count() for n in tables}
        full = make_manifest(self.name, self.version, manifest.pop("sources", []), counts, **manifest)
        write_json(full, f"{self.root}/manifest.json")
        return full


def make_manifest(name: str, version: str, sources: list[dict], tables: dict[str, int], targets: dict | None = None, caveats: list[str] | None = None, **extra) -> dict:
    """extra sections must not shadow the common ones."""
    if shadowed := [k for k in extra if k in _COMMON]:
        raise ValueError(f"sections are taken: {', '.join(shadowed)}")
    return {"name": name, "version": version, "sources": sources, "tables": tables, "targets": targets or {}, "caveats": caveats or [], "schema_version": 1, **extra}


def json_safe(value):
    """Values that JSON has: not-a-number is null, sets are sorted lists, all else text."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted(map(json_safe, value), key=str)
    if isinstance(value, float) and value != value:
        return None
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def write_json(value: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(json_safe(value), indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def predictions(parts: dict[str, DataFrame]) -> DataFrame:
    """Scored rows of several splits as one table with a split column."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_errors(asked: DataFrame, path: str) -> None:
    """Failed answers as lines of JSON."""
    asked.where(F.col("error").isNotNull()).write.mode("overwrite").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) from lines of JSON; the first line of a key counts, a line that is not JSON is an error."""
    lines = spark.read.option("mode", "FAILFAST").schema("key string, value string, line long").json(path)
    return lines.groupBy("key").agg(F.min_by("value", "line").alias("value"))


def append_cache(rows: DataFrame, cache: DataFrame, path: str) -> None:
    """Adds the rows whose key the cache lacks, in one append."""
    rows.join(cache.select("key"), "key", "left_anti").select("key", "value", F.monotonically_increasing_id().alias("line")).write.mode("append").json(path)


def run_metrics(spark: SparkSession, root: str, latest_only: bool = False) -> DataFrame:
    """(path, run, stamp, task, method, metrics) of every metrics.json below root; with latest_only the last of each task and method."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "metrics.json").load(root)
    text = F.col("content").cast("string")
    run = F.element_at(F.split("path", "/"), -2)
    out = found.select("path", run.alias("run"), F.regexp_extract(run, r"^(\d{8}T\d{4,6}Z)", 1).alias("stamp"), F.get_json_object(text, "$.task").alias("task"), F.get_json_object(text, "$.method").alias("method"), F.get_json_object(text, "$.metrics").alias("metrics"))
    if not latest_only:
        return out
    best = out.groupBy("task", "method").agg(F.max_by(F.struct("path", "run", "stamp", "metrics"), F.struct("stamp", "run")).alias("b"))
    return best.select("b.path", "b.run", "b.stamp", "task", "method", "b.metrics")


def write_report(table: DataFrame, path: str, order: list[str], markdown: bool = False) -> None:
    """A table as CSV parts with a header, in order; or, for a report of a few rows, as one markdown file."""
    if not markdown:
        table.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        return
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(cells) + " |" for cells in (table.columns, ["---"] * len(table.columns), *([cell(v) for v in r] for r in table.orderBy(*order).collect()))]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(lines) + "\n")


def enrichment_manifest(manifest: dict, item_columns: list[str], section: str, column: str, task_column: str) -> dict | None:
    """What a task's manifest says of an enrichment of items: None where the canonical manifest has no such section.

    ValueError if it is on with another column, with one the items lack, or without the sha256 of its source.
    """
    told = (manifest.get("item_enrichment") or {}).get(section)
    if not isinstance(told, dict):
        return None
    if not told.get("enabled"):
        return {section: {"enabled": False}}
    sha = (told.get("source") or {}).get("sha256")
    for wrong, why in ((told.get("column") != column, "is of an unknown column"), (column not in item_columns, "is missing from the items"), (not isinstance(sha, str) or not sha, "has no fingerprint of its source")):
        if wrong:
            raise ValueError(f"{section} {why}: {told.get('column')!r}")
    return {section: {"enabled": True, "canonical_column": column, "task_column": task_column, "source_sha256": sha}}
