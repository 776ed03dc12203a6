"""Near copies by the Jaccard similarity of their sets of five-word shingles, at least 4/5: exact, by prefix filtering.

Two sets of that similarity share at least 4/5 of each. So in any one order of all shingles both have a shared one among
their first n - ceil(4n / 5) + 1, and those are the buckets. Shingles that a sample of the texts holds often come last in
the order, so that lines many texts share make few buckets; the sample has no part in what is found. Within a bucket sizes
and places bound the overlap; what may reach 4/5 is compared as whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateworks.llm._common import Scratch, connected_components

SHINGLE, SEED = 5, 43
#: The sample behind the order of shingles: texts, times seen from which a shingle counts as common, shingles sent to the tasks.
SAMPLE_ROWS, COMMON, COMMON_SHINGLES = 16_000, 4, 200_000
#: Rounds in which a bucket's members meet one member only; what they link need not meet again.
STARS = 2
#: Sets of a block, bitmaps of a block, and pairs compared together.
BLOCK, BITMAPS, PAIRS_AT_ONCE = 500, 20_000, 200
#: Rows of a bucket that meet in one task at once.
MEET = 2048
#: Members of leaders' groups that a task keeps to tell each once; shingles of a group whose sets meet in one task.
MEMBERS_AT_ONCE, SETS = 100_000, 1 << 20
#: Numbers up to which a table of them is broadcast.
FEW = 100_000


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of all shingles in order; fewer words than a shingle are one shingle, no words none."""
    words = (text or b"").lower().split()
    n, digest = min(SHINGLE, len(words)), xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(words[i : i + n]), SEED) for i in range(len(words) - n + 1 if n else 0)], dtype=np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    return np.unique(shingle_hashes(text))


def set_print(shingles: np.ndarray) -> int:
    """Signed 64-bit digest; equal sets have equal ones."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def texts_of(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.col("text").cast("string").cast("binary").alias("text"))


def _shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for t in batch["text"]:
            yield pd.DataFrame({"shingle": shingle_set(t).view(np.int64)})


def _common(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample, ascending, and how often they are there."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, rows // SAMPLE_ROWS))) == 0)
    counts = texts_of(sample).mapInPandas(_shingles, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    top = sorted((r["shingle"] & (2**64 - 1), r["n"]) for r in counts.orderBy(F.desc("n"), "shingle").limit(COMMON_SHINGLES).collect())
    return np.array([t[0] for t in top], dtype=np.uint64), np.array([t[1] for t in top], dtype=np.int64)


def prefix(shingles: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n / 5) + 1 shingles in the order of (times seen in the sample, hash)."""
    n = len(shingles)
    seen = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        seen = np.where(common[at] == shingles, times[at], 0)
    return shingles[np.lexsort((shingles, seen))[: n - (4 * n + 4) // 5 + 1]]


def _prefixes(common: np.ndarray, times: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [s for t in batch["text"] if len(s := shingle_set(t))]
            firsts = [prefix(s, common, times) for s in sets]
            if not sets:
                continue
            lengths = [len(f) for f in firsts]
            yield pd.DataFrame({
                "shingle": np.concatenate(firsts).view(np.int64),
                "fp": np.repeat(np.array([set_print(s) for s in sets], dtype=np.int64), lengths),
                "n": np.repeat(np.array([len(s) for s in sets], dtype=np.int32), lengths),
                "place": np.concatenate([np.arange(k, dtype=np.int32) for k in lengths]),
            })

    return run


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shingle and fp -> those of shingles with two fps or more, each fp once."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        rows = rows[~((rows["shingle"] == rows["shingle"].shift()) & (rows["fp"] == rows["fp"].shift()))]
        last = rows["shingle"] == rows["shingle"].iloc[-1]
        rest, done = rows[last], rows[~last]
        yield done[done.duplicated("shingle", keep=False)]
    if rest is not None and len(rest) > 1:
        yield rest


#: The most that two sets can share which meet at these places, all before with what is before, is enough for 4/5.
_MAY = "9 * (least(x.place, y.place) + 1 + least(x.n - x.place - 1, y.n - y.place - 1)) >= 4 * (x.n + y.n)"


def _star(rows: DataFrame, star: int) -> DataFrame:
    """Pairs (a, b) of fps of different components that share a bucket, of which b or a is the bucket's head in this round."""
    x = rows.alias("x")
    head = F.min(F.struct(F.xxhash64("fp", F.lit(star)).alias("h"), "fp", "n", "place", "component")).alias("head")
    met = x.join(rows.groupBy("shingle").agg(head).select("shingle", "head.*").alias("y"), F.expr("x.shingle = y.shingle"))
    return met.where(f"x.component <> y.component AND {_MAY}").select(F.expr("least(x.fp, y.fp)").alias("a"), F.expr("greatest(x.fp, y.fp)").alias("b")).distinct()


def _groups(batches: Iterator[pd.DataFrame], *key: str) -> Iterator[pd.DataFrame]:
    """Rows sorted by key -> the rows of each key that has two rows or more."""
    rest = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[list(key)].to_numpy()
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for x, y in zip(starts, starts[1:]):
            if rest and (rest[-1][list(key)].iloc[-1].to_numpy() != keys[x]).any():
                whole, rest = pd.concat(rest, ignore_index=True), []
                if len(whole) > 1:
                    yield whole
            rest.append(batch.iloc[x:y])
    if rest and sum(map(len, rest)) > 1:
        yield pd.concat(rest, ignore_index=True)


def _tree(side: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[list[tuple[int, int]]]:
    """Spanning trees of rows that link where near(row, others) tells so, one of the two on side 1 and the other on side 2."""
    left = np.arange(len(side))
    while len(left):
        queue, left, edges = [int(left[0])], left[1:], []
        while queue and len(left):
            at = queue.pop()
            met = left[(((side[at] & 1) > 0) & ((side[left] & 2) > 0)) | (((side[at] & 2) > 0) & ((side[left] & 1) > 0))]
            found = met[near(at, met)] if len(met) else met
            if len(found):
                edges += [(at, int(x)) for x in found]
                queue += found.tolist()
                left = np.setdiff1d(left, found, assume_unique=True)
        if edges:
            yield edges


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shingle and pair of blocks -> (leader, fp) of rows that pairs which may be similar, by places, sizes and
    bitmaps, join: a row for each that has such a partner, never one for each pair. The leader is the smallest fp joined."""

    def joined(part: pd.DataFrame) -> Iterator[tuple[int, int]]:
        fp, n, place, component, side = (part[c].to_numpy(dtype=np.int64) for c in ("fp", "n", "place", "component", "side"))
        bits = [np.frombuffer(b, dtype=np.uint8) for b in part["bits"]]

        def near(i: int, others: np.ndarray) -> np.ndarray:
            most = np.minimum(place[i], place[others]) + 1 + np.minimum(n[i] - place[i] - 1, n[others] - place[others] - 1)
            may = (component[others] != component[i]) & (9 * most >= 4 * (n[i] + n[others]))
            for at in np.flatnonzero(may).tolist():
                j = others[at]
                may[at] = 9 * most_shared(int(n[i]), bits[i], int(n[j]), bits[j]) >= 4 * (n[i] + n[j])
            return may

        for edges in _tree(side, near):
            members = fp[np.unique(np.array(edges))]
            yield from ((int(members.min()), m) for m in members.tolist())

    found: set[tuple[int, int]] = set()
    for part in _groups(batches, "shingle", "meet"):
        found.update(joined(part))
        if len(found) >= MEMBERS_AT_ONCE:
            yield pd.DataFrame(sorted(found), columns=["leader", "fp"], dtype="int64")
            found.clear()
    yield pd.DataFrame(sorted(found), columns=["leader", "fp"], dtype="int64")


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by leader and pair of blocks -> links (a, b), spanning trees of the pairs whose whole sets have a similarity of 4/5."""
    for part in _groups(batches, "leader", "meet"):
        fp, side = part["fp"].to_numpy(dtype=np.int64), part["side"].to_numpy(dtype=np.int64)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in part["shingles"]]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum(n)
        held = np.zeros(int(codes.max()) + 1, dtype=bool)

        def near(i: int, others: np.ndarray) -> np.ndarray:
            may = 9 * np.minimum(n[i], n[others]) >= 4 * (n[i] + n[others])
            own = codes[ends[i] - n[i] : ends[i]]
            held[own] = True
            for at in np.flatnonzero(may).tolist():
                j = others[at]
                may[at] = 9 * int(np.count_nonzero(held[codes[ends[j] - n[j] : ends[j]]])) >= 4 * (n[i] + n[j])
            held[own] = False
            return may

        links = [(min(fp[a], fp[b]), max(fp[a], fp[b])) for edges in _tree(side, near) for a, b in edges]
        if links:
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _met_in_blocks(rows: DataFrame) -> DataFrame:
    """rows(fp, blocks, ..) with meet and side: a row for each pair of blocks that it is of, among the blocks of its key."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # Bit 1: a row of the first block, bit 2: of the second; a block with itself has both.
    side = F.when(F.col("own") == F.col("with"), 3).when(F.col("own") < F.col("with"), 1).otherwise(2)
    meet = F.least("own", "with") * F.col("blocks") + F.greatest("own", "with")
    return rows.withColumn("meet", meet).withColumn("side", side).drop("own", "with", "blocks")


def _all(scratch: Scratch, docs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join all fps of different components that share a bucket and are similar.

    Every pair of a bucket meets in a task, by bitmaps. What may be similar leaves the task as members of a leader's group,
    not as pairs; buckets of near copies have mostly the same leader. A group's whole sets meet in a task, once for all the
    buckets shared, and give spanning trees. So rows between tasks grow with the members. Buckets beyond MEET rows and groups
    beyond SETS shingles are cut, and each pair of their blocks meets on its own.
    """
    crowd = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    hits = rows.join(crowd.select("shingle", F.ceil(F.col("rows") / MEET).cast("long").alias("blocks")), "shingle")
    told = _met_in_blocks(hits.drop("n")).join(nodes.select("fp", "n", "bits"), "fp")
    dealt = told.repartition("shingle", "meet").sortWithinPartitions("shingle", "meet", "fp")
    members = scratch.cut(dealt.mapInPandas(_meet, "leader long, fp long").distinct(), "shingles-members")
    sets = _sets_of(scratch, docs, nodes, members.select("fp").distinct())
    size = members.join(nodes.select("fp", "n"), "fp").groupBy("leader").agg(F.ceil(F.sum("n") / SETS).cast("long").alias("blocks"))
    asked = _met_in_blocks(members.join(size, "leader")).join(sets, "fp")
    dealt = asked.repartition("leader", "meet").sortWithinPartitions("leader", "meet", "fp")
    found = scratch.cut(dealt.mapInPandas(_linked, "a long, b long").distinct(), "shingles-links")
    for name in ("shingles-members", "shingles-asked", "shingles-sets"):
        scratch.drop(name)
    return found


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits, a power of two of at least four times as many as there are shingles, of which those that the hashes name are set."""
    size = 1 << max(6, (4 * len(shingles) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(shingles >> np.uint64(20)) % np.uint64(size)] = 1
    return np.packbits(bits)


def most_shared(n: int, x: np.ndarray, m: int, y: np.ndarray) -> int:
    """The most that sets of n and m with bitmaps x and y can share: a bit set on one side only stands for a shingle of that side only."""
    while len(x) != len(y):
        # The longer one as it were with half as many bits.
        if len(x) > len(y):
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"]]
        yield pd.DataFrame({"fp": np.array([set_print(s) for s in sets], dtype=np.int64), "shingles": [s.tobytes() for s in sets]})


def _may_be_similar(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """Without pairs whose bitmaps tell that too little is shared."""
    of = {fp: (n, np.frombuffer(bits, dtype=np.uint8)) for fp, n, bits in zip(sets["fp"], sets["n"], sets["bits"])}
    may = [9 * most_shared(*of[a], *of[b]) >= 4 * (of[a][0] + of[b][0]) for a, b in zip(pairs["a"], pairs["b"])]
    return pairs.loc[np.array(may, dtype=bool), ["a", "b"]]


def _similar(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    of = {fp: np.frombuffer(s, dtype=np.uint64) for fp, s in zip(sets["fp"], sets["shingles"])}
    keep = [9 * len(np.intersect1d(of[a], of[b], assume_unique=True)) >= 4 * (len(of[a]) + len(of[b])) for a, b in zip(pairs["a"], pairs["b"])]
    return pairs.loc[np.array(keep, dtype=bool), ["a", "b"]]


def _compared(pairs: DataFrame, sets: DataFrame, most: int, how) -> DataFrame:
    """Pairs (a, b) that how keeps. Sets are dealt to blocks of about most at most, and the pairs of two blocks, some
    PAIRS_AT_ONCE, are compared together, so that a set is sent once for all its partners in a block."""
    n = pairs.count()
    blocks = max(2 * n // most, math.isqrt(n // PAIRS_AT_ONCE)) + 1
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    dealt = pairs.select(block("a").alias("i"), block("b").alias("j"), "a", "b")
    asked = dealt.select(F.col("i").alias("k"), F.col("j").alias("l"), F.explode(F.array("a", "b")).alias("fp")).distinct().join(sets, "fp")
    return dealt.groupBy("i", "j").cogroup(asked.groupBy("k", "l")).applyInPandas(how, "a long, b long")


def _sets_of(scratch: Scratch, docs: DataFrame, nodes: DataFrame, fps: DataFrame) -> DataFrame:
    """(fp, shingles) of the fps: the whole sets, from texts read again."""
    fps = scratch.cut(fps, "shingles-asked")
    n = fps.count()
    ids = nodes.select("fp", "id").join(fps, "fp", "left_semi").select("id").distinct()
    # Few numbers spare the texts a shuffle; many take one.
    texts = docs.join(F.broadcast(ids) if n <= FEW else ids, F.col("doc_id").cast("long").eqNullSafe(F.col("id")), "left_semi")
    sets = texts_of(texts).mapInPandas(_sets, "fp long, shingles binary").join(F.broadcast(fps) if n <= FEW else fps, "fp", "left_semi")
    return scratch.cut(sets.dropDuplicates(["fp"]), "shingles-sets")


def verified(scratch: Scratch, docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole sets have a similarity of 4/5 at least: first by their bitmaps, what these leave by the sets.

    nodes: (fp, id, n, bits) of every set: a doc_id that has it, its size and its bitmap. Only texts of pairs left are read
    again.
    """
    left = scratch.cut(_compared(pairs, nodes.select("fp", "n", "bits"), BITMAPS, _may_be_similar), "shingles-left")
    sets = _sets_of(scratch, docs, nodes, left.select(F.col("a").alias("fp")).union(left.select("b")).distinct())
    found = scratch.cut(_compared(left, sets, BLOCK, _similar), "shingles-links")
    for name in ("shingles-left", "shingles-asked", "shingles-sets"):
        scratch.drop(name)
    return found


def similar_links(scratch: Scratch, docs: DataFrame, nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs of different sets with similarity >= 4/5.

    nodes: see verified. Every pair that shares a bucket and may be similar is compared, unless links found before,
    known ones to begin with, join the two already.
    """
    spread = texts_of(docs).mapInPandas(_prefixes(*_common(docs, docs.count())), "shingle long, fp long, n int, place int")
    shared = scratch.cut(spread.repartition("shingle").sortWithinPartitions("shingle", "fp").mapInPandas(_shared, spread.schema), "shingles-shared")
    scratch.collect_shuffles()

    def with_components(links: DataFrame | None) -> DataFrame:
        if links is None:
            return shared.withColumn("component", F.col("fp"))
        joined = scratch.cut(connected_components(scratch, links), "shingles-joined")
        return shared.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("shingle", "fp", "n", "place", F.coalesce("component", "fp").alias("component"))

    links = known
    for step in (*range(STARS), None):
        rows = with_components(links)
        if step is None:
            found = _all(scratch, docs, rows, nodes)
        else:
            found = verified(scratch, docs, nodes, scratch.cut(_star(rows, step), "shingles-pairs"))
            scratch.drop("shingles-pairs")
        links = found if links is None else links.union(found)
    return links
