"""Tables kept between steps in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables that written() has made and that are still there, in the order of their making.
_WRITTEN: list[str] = []

#: Long binary values: without these, a page and a reader's batch hold a hundred of them and more.
_PACKED = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(1 << 24), "parquet.enable.dictionary": "false"}


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset: a temporary one if all runs in this process, else RuntimeError."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="slateworks-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written as Parquet below the shared folder and read again: short plans, pruned columns, nothing lost with
    an executor. It goes when the driver ends."""
    spark = df.sparkSession
    root = f"{shared_root(spark)}/slateworks-{uuid.uuid4().hex}"
    schema = df.schema
    options = _PACKED if any(f.dataType.typeName() == "binary" for f in schema.fields) else {}
    df.write.options(**options).parquet(f"{root}/{name}")

    def remove() -> None:
        with contextlib.suppress(Exception):
            delete(spark, root)

    atexit.register(remove)
    _WRITTEN.append(root)
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of steps that are over, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that make gives, written. What make itself wrote on the way goes, and so do the shuffle files of its steps.

    So several such tables take the disk one after the other. Tables meant to stay must be made before.
    """
    before = len(_WRITTEN)
    out = written(make(), name)
    for root in _WRITTEN[before:-1]:
        delete(out.sparkSession, root)
    del _WRITTEN[before:-1]
    released(out.sparkSession)
    return out


def in_parts(parts: int, make: Callable[[int], DataFrame], name: str) -> DataFrame:
    """The rows of make(0) .. make(parts - 1), each written and its shuffle files gone before the next; a single one stays a plan."""
    return make(0) if parts == 1 else reduce(DataFrame.unionAll, [alone(lambda: make(p), name) for p in range(parts)])


def looped(table: DataFrame, steps: int, step: Callable[[DataFrame, int], DataFrame], name: str) -> DataFrame:
    """step applied again and again to a written table, each result written and the one before it deleted."""
    last = None
    for n in range(steps):
        now = table
        table = alone(lambda: step(now, n), name)
        if last:
            delete(table.sparkSession, last)
            _WRITTEN.remove(last)
        last = _WRITTEN[-1]
    return table
