"""Item neighbours and sums over them in blocks: lists are dealt to blocks packed, pairs live inside a task and never meet a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateworks.functions.scratch import alone, in_parts
from slateworks.operators.candidates import indexed

#: Pairs of a block, which set the number of blocks; pairs that a task has in memory at once.
BLOCK_PAIRS, STEP_PAIRS = 1 << 26, 1 << 21
#: Entries of dealt lists, a few bytes each, that lie in shuffle files at once; blocks beyond that come in further parts, one after the other.
PART_ENTRIES = 1 << 27


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed: high bytes, mostly zeros, take next to nothing."""
    sizes = np.array([len(a) for a in arrays], np.int64).tobytes()
    planes = b"".join(np.ascontiguousarray(a.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)
    return np.int64(len(planes)).tobytes() + sizes + pa.compress(planes, "zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    total, *sizes = np.frombuffer(blob, np.int64, n + 1)
    planes, out, at = np.frombuffer(pa.decompress(blob[8 * (n + 1) :], int(total), "zstd", asbytes=True), np.uint8) if total else np.empty(0, np.uint8), [], 0
    for size in sizes:
        out.append(np.ascontiguousarray(planes[at : at + 8 * size].reshape(8, -1).T).view(np.int64).ravel())
        at += 8 * size
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a column of lists."""
    offsets = column.offsets.to_numpy()
    return np.diff(offsets), column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


def _within(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start .. start + length - 1 of all lists one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _copies(lengths: np.ndarray, block_of: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each block that any list names: the block and the lists' numbers. block_of has the lists' blocks one after the other."""
    keys = np.unique(block_of.astype(np.int64) * len(lengths) + np.repeat(np.arange(len(lengths)), lengths))
    block, row = np.divmod(keys, max(1, len(lengths)))
    cuts = np.searchsorted(block, np.arange(blocks + 1))
    for b in range(blocks):
        if cuts[b] < cuts[b + 1]:
            yield b, row[cuts[b] : cuts[b + 1]]


def _best(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest values of each row, best first, equal ones in the order they have; rows are ascending from 0."""
    if not len(row):
        return np.empty(0, np.int64)
    low = np.int64(value.max()) - value
    bits = max(1, int(low.max()).bit_length())
    key = (row.astype(np.int64) << bits) | low
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    sizes = np.diff(np.r_[starts, len(row)])
    worst = np.sort(key)[starts + np.minimum(sizes, n) - 1]
    near = np.flatnonzero(key <= np.repeat(worst, sizes))
    near = near[np.argsort(key[near], kind="stable")]
    first = np.flatnonzero(np.r_[True, row[near][1:] != row[near][:-1]])
    return near[np.arange(len(near)) - np.repeat(first, np.diff(np.r_[first, len(near)])) < n]


def _summed(key: np.ndarray, value: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their values (None: of ones)."""
    if value is None:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[starts], np.diff(np.r_[starts, len(key)]) if value is None else np.add.reduceat(value, starts) if len(key) else value


def _by_block(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[int, list]]:
    """(block, rows) of rows sorted by block; each row is a tuple."""
    last, rows = None, []
    for batch in batches:
        for block, *row in zip(*(batch.column(c).to_pylist() for c in ("block", *names))):
            if block != last and rows:
                yield last, rows
                rows = []
            last = block
            rows.append(row)
    if rows:
        yield last, rows


def item_lists(train: DataFrame, user: str = "user_id", item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(user, i, w, q) with a row for each user: its items by index in ascending order, their counts, and the sums of squared
    counts that each item has over all users; and (item, index) in the order of items."""
    rows = train.where(F.col(user).isNotNull() & F.col(item).isNotNull())
    # A few MB of Parquet are many times that as a broadcast table on the driver.
    index = alone(lambda: indexed(rows, item), "index").hint("merge")

    def listed() -> DataFrame:
        # Step by step, so that only one step's shuffle files lie on disk.
        w = alone(lambda: rows.groupBy(user, item).agg(F.count(F.lit(1)).alias("w")), "w")
        q = alone(lambda: w.groupBy(item).agg(F.sum(F.col("w") * F.col("w")).alias("q")), "q")
        known = index.join(q, item).select(item, F.col("index").alias("i"), "q")
        each = w.join(known, item).groupBy(user).agg(F.sort_array(F.collect_list(F.struct("i", "w", "q"))).alias("e"))
        return each.select(user, F.col("e.i").alias("i"), F.col("e.w").alias("w"), F.col("e.q").alias("q"))

    return alone(listed, "lists"), index


def _deal_lists(blocks: int, part: int = 0, parts: int = 1):
    """Lists to the blocks whose number leaves part when divided by parts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, i = _flat(batch.column("i"))
            (_, w), (_, q) = _flat(batch.column("w")), _flat(batch.column("q"))
            starts = np.cumsum(lengths) - lengths
            for block, rows in _copies(lengths, i % blocks, blocks):
                if block % parts != part:
                    continue
                at, n = _within(starts[rows], lengths[rows]), lengths[rows]
                steps = np.diff(i[at], prepend=0)
                yield pa.record_batch({"block": pa.array([block], pa.int32()), "blob": pa.array([_pack(n, steps, w[at], q[at])], pa.binary())})

    return deal


def _near(blocks: int, n: int):
    def found(block: int, blobs: list) -> Iterator[pa.RecordBatch]:
        parts = []
        for k in range(len(blobs)):
            lengths, i, w, q = _unpack(blobs[k][0], 4)
            blobs[k] = None
            i = np.cumsum(i)
            parts.append((lengths, i.astype(np.int32) if not len(i) or i.max() < 1 << 31 else i, None if (w == 1).all() else w, q.astype(np.int32) if not len(q) or q.max() < 1 << 31 else q))
        lengths, items = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        weights = None if all(p[2] is None for p in parts) else np.concatenate([np.ones(len(p[1]), np.int64) if p[2] is None else p[2] for p in parts])
        squares = np.zeros(int(items.max()) + 1, np.int64)
        for p in parts:
            squares[p[1]] = p[3]
        del parts
        norm = np.sqrt(squares.astype(np.float64))
        starts = np.cumsum(lengths) - lengths
        mine = np.flatnonzero(items % blocks == block)
        mine = mine[np.argsort(items[mine], kind="stable")]
        owner = np.searchsorted(starts, mine, side="right") - 1
        # Lists are not empty, so starts are distinct.
        many = np.cumsum(lengths[owner])
        first = np.flatnonzero(np.r_[True, items[mine][1:] != items[mine][:-1]])
        ends = np.r_[first[1:], len(mine)]
        k = 0
        while k < len(first):
            done = many[first[k] - 1] if first[k] else 0
            last = max(k + 1, int(np.searchsorted(many[ends - 1], done + STEP_PAIRS, side="right")))
            part, own = slice(first[k], ends[last - 1]), items[mine[first[k:last]]].astype(np.int64)
            if many[ends[last - 1] - 1] - done <= 2 * STEP_PAIRS:
                n_of = lengths[owner[part]]
                at = _within(starts[owner[part]], n_of)
                row = np.repeat(np.repeat(np.arange(last - k), np.diff(np.r_[first[k:last], ends[last - 1]])), n_of)
                key, dot = _summed((row << 32) | items[at], None if weights is None else np.repeat(weights[mine[part]], n_of) * weights[at])
                row, other = key >> 32, key & ((1 << 32) - 1)
            else:
                # An item of very many pairs is on its own: its sums are kept for each other item.
                sums = np.zeros(len(squares), np.int64)
                for e in range(part.start, part.stop):
                    at = slice(starts[owner[e]], starts[owner[e]] + lengths[owner[e]])
                    sums[items[at]] += 1 if weights is None else weights[mine[e]] * weights[at]
                other = np.flatnonzero(sums)
                row, dot = np.zeros(len(other), np.int64), sums[other]
            fresh = other != own[row]
            row, other, dot = row[fresh], other[fresh], dot[fresh]
            best = _best(row, np.floor(dot / (norm[own[row]] * norm[other]) * 1e12 + 0.5).astype(np.int64), n)
            row, other, dot = row[best], other[best], dot[best]
            if len(row):
                lead = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                offsets = pa.array(np.r_[lead, len(row)].astype(np.int32))
                listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64)))
                yield pa.record_batch({"i": pa.array(own[row[lead]]), "q": pa.array(squares[own[row[lead]]]), "others": listed(other), "dots": listed(dot), "qs": listed(squares[other])})
            k = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, blobs in _by_block(batches, "blob"):
            yield from found(block, blobs)

    return run


def near_lists(lists: DataFrame, n: int, block_pairs: int | None = None, part_entries: int | None = None) -> DataFrame:
    """(i, q, others, dots, qs): of each item the n most similar others by cosine, best first, ties to the smaller index.

    Items are cut into blocks by index. A user's list goes once to each block in which the user has an item, packed with
    others, and the task of the block makes and sums the pairs of its items. So as many lists leave a task as there are
    interactions at most, a few bytes for each of their items, and only the n best of each item go on. Blocks are done in
    parts, so what is dealt at once is bounded.
    """
    spark = lists.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    pairs = lists.agg(F.sum(F.size("i").cast("long") * F.size("i"))).first()[0] or 0
    blocks = max(1, -(-pairs // (block_pairs or BLOCK_PAIRS)))
    size = F.size("i").cast("long")
    entries = lists.agg(F.sum(size * F.least(size, F.lit(blocks)))).first()[0] or 0
    parts = min(blocks, max(1, -(-entries // (part_entries or PART_ENTRIES))))

    def near(part: int) -> DataFrame:
        dealt = lists.select("i", "w", "q").mapInArrow(_deal_lists(blocks, part, parts), "block int, blob binary")
        # More tasks than blocks, so that few get two.
        dealt = dealt.repartition(4 * -(-blocks // parts), "block").sortWithinPartitions("block")
        return dealt.mapInArrow(_near(blocks, n), "i long, q long, others array<long>, dots array<long>, qs array<long>")

    return in_parts(parts, near, "near") if parts > 1 else alone(lambda: near(0), "near")


def neighbours(train: DataFrame, n: int, users: str = "user_id") -> DataFrame:
    """(item_id, other, similarity): each item's n most similar others by cosine of their counts over users; ties go to the
    smaller item."""
    lists, index = item_lists(train, users)
    near = near_lists(lists, n)
    each = near.select("i", "q", F.explode(F.arrays_zip("others", "dots", "qs")).alias("e")).select("i", F.col("e.others").alias("o"), (F.col("e.dots") / (F.sqrt("q") * F.sqrt("e.qs"))).alias("similarity"))
    named = each.join(index.select("item_id", F.col("index").alias("i")), "i").join(index.select(F.col("item_id").alias("other"), F.col("index").alias("o")), "o")
    return named.select("item_id", "other", "similarity")


def _deal_near(blocks: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (of, block_of), (lengths, others), (_, dots), (_, qs) = (_flat(batch.column(c)) for c in ("blocks", "others", "dots", "qs"))
            i, q, starts = batch.column("i").to_numpy(), batch.column("q").to_numpy(), np.cumsum(lengths) - lengths
            for block, rows in _copies(of, block_of, blocks):
                at = _within(starts[rows], lengths[rows])
                yield pa.record_batch({"block": pa.array([block], pa.int32()), "user": pa.array([None], pa.string()), "list": pa.array([None], pa.list_(pa.int64())), "blob": pa.array([_pack(i[rows], q[rows], lengths[rows], others[at], dots[at], qs[at])], pa.binary())})

    return deal


def _recommended(k: int):
    def top(names: list, lists: list, i: np.ndarray, starts: np.ndarray, lengths: np.ndarray, others: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
        sizes, seen = np.array([len(x) for x in lists]), np.concatenate(lists)
        user = np.repeat(np.arange(len(names)), sizes)
        place = np.minimum(np.searchsorted(i, seen), max(0, len(i) - 1))
        known = np.flatnonzero(i[place] == seen) if len(i) else np.empty(0, np.int64)
        place, n_of = place[known], lengths[place[known]] if len(known) else np.empty(0, np.int64)
        at = _within(starts[place] if len(known) else n_of, n_of)
        key, s = _summed((np.repeat(user[known], n_of) << 32) | others[at], sims[at])
        fresh = ~np.isin(key, (user << 32) | seen)
        key, s = key[fresh], s[fresh]
        best = _best(key >> 32, np.floor(s * 1e9 + 0.5).astype(np.int64), k)
        row = key[best] >> 32
        lead = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
        rank = np.arange(len(row)) - np.repeat(lead, np.diff(np.r_[lead, len(row)])) + 1
        return pa.record_batch({"user": pa.array(names, pa.string()).take(pa.array(row)), "index": pa.array(key[best] & ((1 << 32) - 1)), "rank": pa.array(rank.astype(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, ready, names, lists, size = None, [], None, [], [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal ready, parts, names, lists, size
            if names:
                if ready is None:
                    joined = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * 4
                    i, lengths, others, sims = joined
                    starts, order = np.cumsum(lengths) - lengths, np.argsort(i)
                    ready, parts = (i[order], starts[order], lengths[order], others, sims), []
                yield top(names, lists, *ready)
            names, lists, size = [], [], 0

        for batch in batches:
            for block, user, seen, blob in zip(batch.column("block").to_pylist(), batch.column("user").to_pylist(), batch.column("list"), batch.column("blob")):
                if block != last:
                    yield from flushed()
                    last, parts, ready = block, [], None
                if user is None:
                    i, q, lengths, others, dots, qs = _unpack(blob.as_py(), 6)
                    sims = dots / (np.sqrt(np.repeat(q, lengths).astype(np.float64)) * np.sqrt(qs.astype(np.float64)))
                    parts.append((i, lengths, others.astype(np.int32) if not len(others) or others.max() < 1 << 31 else others, sims))
                else:
                    names.append(user)
                    lists.append(seen.values.to_numpy(zero_copy_only=False))
                    size += len(lists[-1])
                    if size >= STEP_PAIRS // 16:
                        yield from flushed()
        yield from flushed()

    return run


def recommended(lists: DataFrame, near: DataFrame, users: DataFrame, k: int, n: int, block_pairs: int | None = None, part_entries: int | None = None) -> DataFrame:
    """(user_id, index, rank): of each user the k items not in the list with the largest sums of similarities to items in it.

    Users are cut into blocks. An item's neighbours go once to each block with a user who has the item, packed; the sums are
    made in the block's task. Blocks are done in parts, so what is dealt at once is bounded.
    """
    own = lists.join(users.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "i")
    pairs = n * (own.agg(F.sum(F.size("i").cast("long"))).first()[0] or 0)
    blocks = max(1, -(-pairs // (block_pairs or BLOCK_PAIRS // 4)))
    parts = min(blocks, max(1, -(-pairs // (part_entries or PART_ENTRIES))))
    placed = own.withColumn("block", F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int"))

    def found(part: int) -> DataFrame:
        mine = placed.where(F.col("block") % parts == part)
        wanted = mine.select("block", F.explode("i").alias("i")).groupBy("i").agg(F.collect_set("block").alias("blocks"))
        dealt = near.join(wanted, "i").select("i", "q", "others", "dots", "qs", "blocks").mapInArrow(_deal_near(blocks), "block int, user string, list array<long>, blob binary")
        rows = dealt.unionByName(mine.select("block", F.col("user_id").alias("user"), F.col("i").alias("list"), F.lit(None).cast("binary").alias("blob")))
        # Neighbours, whose user is null, come before the users of their block.
        rows = rows.repartition(4 * -(-blocks // parts), "block").sortWithinPartitions("block", F.col("user").asc_nulls_first())
        return rows.mapInArrow(_recommended(k), "user string, index long, rank long").select(F.col("user").alias("user_id"), "index", "rank")

    return in_parts(parts, found, "found")
