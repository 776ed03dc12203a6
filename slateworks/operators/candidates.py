"""Candidate groups: what a user did, among what the user might have done."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slateworks.functions.hashing import draw, hash_key
from slateworks.functions.scratch import written


def indexed(items: DataFrame, item: str = "item_id") -> DataFrame:
    """Distinct items with index from 0 in their order. Each partition of the sorted items counts on its own."""
    ordered = written(items.select(item).distinct().repartitionByRange(item).sortWithinPartitions(item).withColumn("_part", F.spark_partition_id()), "items")
    # As many rows as there are partitions.
    before = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    at = F.row_number().over(Window.partitionBy("_part").orderBy(item))
    return ordered.withColumn("_at", at).join(F.broadcast(before), "_part").select(item, (F.col("_before") + F.col("_at") - 1).cast("long").alias("index"))


def chunks(positives: DataFrame, size: int, seed: int | None, order: tuple[str, ...] = (), max_groups: int | None = None, offset: int = 0, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """positives with chunk: consecutive runs of size rows of each user, in hash order or the given order, the first offset skipped."""
    by = order or (hash_key("chunk", seed, user, item), item)
    at = F.row_number().over(Window.partitionBy(user).orderBy(*by)) - 1
    out = positives.withColumn("chunk", F.floor(at / size).cast("long")).where(F.col("chunk") >= offset)
    return out if max_groups is None else out.where(F.col("chunk") < offset + max_groups)


#: Items a scan gives a user by one row, so that no row holds the whole catalog.
SCAN_BLOCK = 50_000


def _lacking(groups: DataFrame, found: DataFrame, user: str) -> DataFrame:
    """groups with _have, the number of items found, where that is less than need."""
    have = found.groupBy(user, "chunk").agg(F.count(F.lit(1)).alias("_have"))
    joined = groups.select(user, "chunk", "need").join(have, [user, "chunk"], "left")
    return joined.withColumn("_have", F.coalesce("_have", F.lit(0))).where(F.col("_have") < F.col("need"))


def draw_negatives(groups: DataFrame, catalog: DataFrame, observed: DataFrame, seed: int, tag: str = "negative", attempts: int = 4, excluded: DataFrame | None = None, index: DataFrame | None = None, user: str = "user_id", item: str = "item_id", strict: bool = True) -> DataFrame:
    """(user, chunk, item) for groups(user, chunk, need): need distinct items that the user has not observed.

    A table of draws meets the catalog by index; what is observed or excluded goes, and the first need distinct items stay.
    Each group first has half as many draws again as it needs; groups left short get attempts * need + 16; what is short
    still, which needs a user who has seen most of the catalog, is filled by a scan of the catalog for that user. So the
    work grows with the groups, not with users times items, and no group stays short that could be full. ValueError for a
    group with too few unseen items; with strict=False it gets all there are.
    """
    index = indexed(catalog, item) if index is None else index
    n = index.count()
    if not n:
        raise ValueError("the catalog is empty")
    seen = observed.select(user, item).distinct()
    seen = seen if excluded is None else seen.union(excluded.select(user, item)).distinct()

    def first(some: DataFrame, draws) -> DataFrame:
        drawn = some.select(user, "chunk", "need", F.explode(F.sequence(F.lit(0), draws.cast("int"))).alias("_j"))
        drawn = drawn.withColumn("index", draw(tag, seed, F.lit(n), user, F.col("chunk").cast("string"), F.col("_j").cast("string")))
        fresh = drawn.join(index, "index").join(seen, [user, item], "left_anti").groupBy(user, "chunk", "need", item).agg(F.min("_j").alias("_j"))
        at = F.row_number().over(Window.partitionBy(user, "chunk").orderBy("_j"))
        return fresh.withColumn("_at", at).where(F.col("_at") <= F.col("need")).select(user, "chunk", item)

    most = F.col("need") * attempts + 15
    found = written(first(groups, F.least(most, F.col("need") + F.ceil(F.col("need") / 2) + 7)), "draws")
    short = written(_lacking(groups, found, user), "short")
    if short.isEmpty():
        return found
    again = written(first(short, most), "draws")
    found = found.join(short.select(user, "chunk"), [user, "chunk"], "left_anti").unionByName(again)
    short = written(_lacking(short, again, user), "short")
    if short.isEmpty():
        return found
    more = written(_scanned(short, again, index, n, seen, seed, user, item), "scanned")
    if strict:
        lacking = _lacking(short, again.unionByName(more), user).first()
        if lacking is not None:
            raise ValueError(f"{lacking[user]} has not seen {lacking['_have']} items only, {lacking['need']} are needed")
    return found.unionByName(more)


def _scanned(short: DataFrame, found: DataFrame, index: DataFrame, n: int, seen: DataFrame, seed: int, user: str, item: str) -> DataFrame:
    """Items for groups that lack some, in hashed order, from all that their users have not seen.

    These users have seen most of the catalog, so a scan is not much longer than the list of what they have seen.
    """
    starts = short.select(user).distinct().withColumn("_start", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(SCAN_BLOCK))))
    every = starts.select(user, F.explode(F.sequence("_start", F.least(F.col("_start") + SCAN_BLOCK - 1, F.lit(n - 1)))).alias("index"))
    unseen = every.join(index, "index").select(user, item).join(seen, [user, item], "left_anti")
    open_ = short.join(unseen, user).join(found, [user, "chunk", item], "left_anti")
    at = F.row_number().over(Window.partitionBy(user, "chunk").orderBy(hash_key("scan", seed, user, F.col("chunk").cast("string"), item), item))
    return open_.withColumn("_at", at).where(F.col("_at") <= F.col("need") - F.col("_have")).select(user, "chunk", item)


def non_interactions(positives: DataFrame, catalog: DataFrame, observed: DataFrame, m: int, total: int, seed: int, tag: str = "negative", temporal: tuple[str, ...] = (), max_groups: int | None = None, offset: int = 0, excluded: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """(user_id, chunk, item_id, y): each group has total // (m + 1) positives of a user and m times as many unseen items.

    With total = m + 1 each positive is a group of its own. temporal keeps the given order of positives instead of a hashed one.
    """
    size = total // (m + 1)
    if size < 1:
        raise ValueError("a group of that total has no place for a positive")
    placed = chunks(positives, size, seed, temporal, max_groups, offset).select("user_id", "chunk", "item_id")
    groups = placed.groupBy("user_id", "chunk").agg((F.count(F.lit(1)) * m).cast("int").alias("need"))
    negatives = draw_negatives(groups, catalog, observed, seed, tag, excluded=excluded, index=index)
    return placed.withColumn("y", F.lit(1)).unionByName(negatives.withColumn("y", F.lit(0)))


def observed_preferences(rows: DataFrame, target: str, m: int, total: int, seed: int, max_groups: int | None = None) -> DataFrame:
    """(user_id, chunk, item_id, y): positives and negatives are both observed; groups of users with too few negatives are left out.

    Negatives may repeat across a user's groups.
    """
    size = total // (m + 1)
    placed = chunks(rows.where(F.col(target) == 1), size, seed, max_groups=max_groups).select("user_id", "chunk", "item_id")
    groups = placed.groupBy("user_id", "chunk").agg((F.count(F.lit(1)) * m).alias("need"))
    offered = groups.join(rows.where(F.col(target) == 0).select("user_id", "item_id"), "user_id")
    at = F.row_number().over(Window.partitionBy("user_id", "chunk").orderBy(hash_key("preference", seed, "user_id", F.col("chunk").cast("string"), "item_id"), "item_id"))
    picked = offered.withColumn("_at", at).where(F.col("_at") <= F.col("need"))
    full = picked.groupBy("user_id", "chunk", "need").agg(F.count(F.lit(1)).alias("_n")).where("_n = need").select("user_id", "chunk")
    both = placed.withColumn("y", F.lit(1)).unionByName(picked.select("user_id", "chunk", "item_id", F.lit(0).alias("y")))
    return both.join(full, ["user_id", "chunk"], "left_semi")


def shuffled(candidates: DataFrame, seed: int, *group: str) -> DataFrame:
    """candidates with position from 1 in a hashed order within their group, which does not know their label."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(hash_key("order", seed, *(F.col(g).cast("string") for g in group), "item_id"), "item_id"))
    return candidates.withColumn("position", at.cast("long"))


def sample_after_split(rows: DataFrame, n_users: int, max_rows: int | None, seed: int, need_history: bool = True) -> DataFrame:
    """rows with split: all of train, and of n_users evaluated users at most max_rows rows in each other split."""
    held = rows.where("split <> 'train'")
    users = held.select("user_id").distinct()
    if need_history:
        users = users.join(rows.where("split = 'train'").select("user_id").distinct(), "user_id", "left_semi")
    chosen = users.orderBy(hash_key("eval-users", seed, "user_id"), "user_id").limit(n_users)
    kept = held.join(chosen, "user_id", "left_semi")
    if max_rows is not None:
        at = F.row_number().over(Window.partitionBy("split", "user_id").orderBy(hash_key("eval-rows", seed, "user_id", "item_id"), "item_id"))
        kept = kept.withColumn("_at", at).where(F.col("_at") <= max_rows).drop("_at")
    return rows.where("split = 'train'").unionByName(kept)
