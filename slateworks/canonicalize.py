"""python -m slateworks.canonicalize ratings|libraries SOURCE TARGET [--summaries CSV]: raw files to canonical tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from slateworks.sources import adapters
from slateworks.sources.datasets import CanonicalDataset, fingerprints


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("kind", choices=("ratings", "libraries"))
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--version", default="1")
    parser.add_argument("--summaries")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("canonicalize").getOrCreate()
    tables = (adapters.rating_files if given.kind == "ratings" else adapters.libraries)(spark, given.source)
    if given.summaries:
        tables["items"] = adapters.with_summaries(spark, tables["items"], given.summaries)
    # Raw files are a handful.
    sources = [r.asDict() for r in fingerprints(spark, given.source).collect()]
    return CanonicalDataset(given.kind, given.version, given.target).write(tables, {"sources": sources})


if __name__ == "__main__":
    main()
