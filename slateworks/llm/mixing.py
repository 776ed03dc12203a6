"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target number of words. A document is taken floor(target / source size) times, and once more with the
rest of that ratio as inclusion probability. The flight phase of the cube method moves these probabilities along the null
space of the balancing constraints (documents and words of the source) until all but a few are 0 or 1. It runs in blocks
of documents; what a block leaves open, at most one document for each constraint, goes into the blocks of the next round.
Only the last two documents of a source are landed: rounded so that its words stay closest to the target.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slateworks.functions.ordered import running_sums
from slateworks.llm._common import WORD_PATTERN, Scratch

WEIGHTS, TOTAL_SHARE, CAP, BLOCK, SEED = (3, 1, 2), 1.5, 2.0, 4096, 20240607
_EPS = 1e-9


def flight(p: np.ndarray, constraints: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Moves probabilities p (n) to 0 or 1 with constraints (n, q) @ p unchanged in sum; at most q stay open.

    draws: a number from [0, 1) for each step, which makes the result the same every time. Each step takes the q + 1
    documents that are open longest and moves them along a null vector of their constraints until one is decided.
    """
    p, q = p.copy(), constraints.shape[1]
    waiting = iter(np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist())
    active = [i for _, i in zip(range(q + 1), waiting)]
    step = 0
    while len(active) == q + 1:
        a = constraints[active].T
        u = np.linalg.svd(a)[2][-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            x = p[active]
            up = np.where(u > 1e-14, (1 - x) / u, np.where(u < -1e-14, -x / u, np.inf)).min()
            down = np.where(u > 1e-14, x / u, np.where(u < -1e-14, (x - 1) / u, np.inf)).min()
        moved = x + up * u if draws[step % len(draws)] * (up + down) < down else x - down * u
        step += 1
        moved = np.where(moved < _EPS, 0.0, np.where(moved > 1 - _EPS, 1.0, moved))
        if ((moved > 0) & (moved < 1)).all():
            # Rounding left the one that was to be decided just inside.
            k = int(np.minimum(moved, 1 - moved).argmin())
            moved[k] = round(moved[k])
        p[active] = moved
        active = [i for i in active if 0 < p[i] < 1]
        for i in waiting:
            active.append(i)
            if len(active) == q + 1:
                break
    return p


def _landed(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rounding of the few open documents whose words come closest to the expected ones."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        gap = np.abs(ways @ size[open_] - p[open_] @ size[open_])
        p = p.copy()
        p[open_] = ways[int(gap.argmin())]
    return p


def _block(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_order", "size", "p", "doc_id"], kind="stable").reset_index(drop=True)
        p, size = part["p"].to_numpy(dtype=float), part["size"].to_numpy(dtype=float)
        scale = max(1.0, float(np.abs(size).max(initial=0.0)))
        draws = (part["_order"].to_numpy(dtype=np.int64).view(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
        p = flight(p, np.stack([np.ones(len(p)), size / scale], axis=1), draws)
        return part.assign(p=_landed(p, size) if last else p).drop(columns="_block")

    return run


def sizes(docs: DataFrame) -> DataFrame:
    """Columns of docs and _size: the number of words of text (null: 0)."""
    return docs.withColumn("_size", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long"))


def targets(scratch: Scratch, by_source: DataFrame, total_share: float = TOTAL_SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """by_source(source, source_size) with target: shares of total_share * all sizes by weight, none above cap * its source's.

    Weights follow the order of sources by code point, null last. The excess over a cap is shared again by weight among the
    others: the water level that gives every source min(cap, level * weight). Only sums reach the driver.
    """
    ordered = scratch.cut(by_source.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "mix-sources")
    numbered = ordered.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())))
    # One row for each partition of the sorted sources.
    before = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = (F.col("_before") + F.col("_at") - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int"))
    table = scratch.cut(numbered.join(before, "_part").select("source", "source_size", weight.alias("_w"), (F.col("source_size") * cap).alias("_cap")), "mix-weights")
    sums = table.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    total, every = (sums["size"] or 0) * total_share, sums["w"] or 0.0
    # Sources fill up in the order of cap / weight; at the level where one does, those before are full, the others are not.
    steps = table.groupBy((F.col("_cap") / F.col("_w")).alias("_level")).agg(F.sum("_cap").alias("c"), F.sum("_w").alias("w"))
    filled = running_sums(steps, "_level", ["c", "w"], descending=False)
    full = filled.where(F.col("run_c") + F.col("_level") * (F.lit(every) - F.col("run_w")) <= total).agg(F.max(F.struct("_level", "run_c", "run_w")).alias("s")).first()["s"]
    rest = every - (full["run_w"] if full else 0.0)
    level = (total - (full["run_c"] if full else 0.0)) / rest if rest > 0 else full["_level"] if full else 0.0
    return table.select("source", "source_size", F.least("_cap", F.col("_w") * level).alias("target"))


def ordered(scratch: Scratch, sized: DataFrame, seed: int = SEED) -> DataFrame:
    """sized(row, doc_id, ..) with _order, a hash of doc_id, and of the row too where other rows have that doc_id.

    So a doc_id that many rows have (null, say) is spread like any other, and unique ones are ordered alike in every run.
    """
    repeated = sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_again"))
    repeated = scratch.cut(repeated, "mix-repeated")
    if repeated.isEmpty():
        return sized.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id"))
    marked = sized.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return marked.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("_again"), F.col("row")))).drop("_id", "_again")


def copies(scratch: Scratch, sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of sized(doc_id, source, size, _order).

    Documents meet in blocks by their order, a hash that few rows share, so a source of any size is spread over tasks. The
    rounds end when each source has one block.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    by_source = scratch.cut(by_source, "mix-by-source")
    goal = scratch.cut(targets(scratch, by_source.drop("_docs")), "mix-targets").withColumnRenamed("source", "_s").drop("source_size")
    # A row for each source, as many as the table has documents at most: Spark picks how to join.
    known = by_source.withColumnRenamed("source", "_s").join(goal.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(CAP))).otherwise(0.0)
    state = sized.join(known, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "source_size", "target", "_docs", "_order", ratio.alias("_ratio"))
    fixed = F.floor(F.col("_ratio") + _EPS)
    state = state.withColumn("_fixed", fixed).withColumn("p", F.greatest(F.col("_ratio") - fixed, F.lit(0.0))).drop("_ratio")
    state = state.withColumn("_open", (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS))
    schema = "doc_id long, source string, size long, source_size long, target double, _docs long, _order long, _fixed long, p double, _open boolean"
    out = [state.where("NOT _open")]
    open_, number = state.where("_open"), 0
    most = by_source.agg(F.max("_docs")).first()[0] or 0
    while True:
        blocks = F.greatest(F.ceil(F.col("_docs") / block), F.lit(1))
        dealt = open_.withColumn("_block", F.pmod(F.xxhash64(F.lit(number), "_order"), blocks))
        last = most <= block
        moved = dealt.groupBy("source", "_block").applyInPandas(_block(last), schema)
        moved = scratch.cut(moved.withColumn("_open", (F.col("p") > 0) & (F.col("p") < 1)), f"mix-round{number}")
        out.append(moved.where("NOT _open"))
        if last:
            break
        # A block leaves at most two documents open.
        most = 2 * -(-most // block)
        open_ = moved.where("_open").withColumn("_docs", 2 * F.ceil(F.col("_docs") / block))
        number += 1
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every.select("doc_id", "source", "size", "source_size", "target", (F.col("_fixed") + F.round("p").cast("long")).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of docs(doc_id, text, source).

    taken: words that the mix takes of the document, size times copies (0, 1 or 2). Null texts and those without words have
    size 0, as their sources may have, whose target then is 0. Null sources are a source of their own. Repeated rows are
    decided one by one. Other columns are not read; an empty table gives an empty result. Reruns give the same rows.
    """
    scratch = Scratch(docs.sparkSession)
    light = sizes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"))
    sized = scratch.cut(light.select("doc_id", "source", F.col("_size").alias("size"), F.monotonically_increasing_id().alias("row")), "mix-sizes")
    out = copies(scratch, ordered(scratch, sized).drop("row"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, ..) with each row as many times as the mix takes it, all columns kept.

    Rows that the mix leaves out go, texts that are null or hold no word among them where their source is not taken whole.
    Null sources are a source of their own, repeated rows are decided one by one, a null doc_id is like any other, columns
    beside may have any name, and an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    row = "_slateworks_row"
    own = scratch.cut(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    light = sizes(own.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"))
    sized = scratch.cut(light.select("row", "doc_id", "source", F.col("_size").alias("size")), "mix-sizes")
    placed = ordered(scratch, sized).select(F.col("row").alias("doc_id"), "source", "size", "_order")
    times = copies(scratch, placed).where("copies > 0").select(F.col("doc_id").alias(row), F.col("copies").cast("int").alias("_slateworks_copies"))
    joined = own.join(times, row)
    return joined.withColumn("_slateworks_copies", F.explode(F.sequence(F.lit(1), F.col("_slateworks_copies")))).select(*docs.columns)
