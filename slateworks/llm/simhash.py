"""SimHash near-duplicates: fingerprints of word shingles, candidates by pigeonring filtering, exact Hamming check.

Two fingerprints within TAU bits, cut into SEGMENTS segments that form a ring, have a segment from which every chain of
1, 2, .. segments differs in at most TAU * length / SEGMENTS bits. So a segment is equal and the next differs in at most
one bit: both together are the key of a bucket, the next segment's one-bit neighbours are probed. Inside a bucket the
longer chains prune pairs before the full Hamming check. A bucket gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateworks.llm._common import Scratch, connected_components
from slateworks.llm.shingle_sets import bitmap, set_print, shingle_hashes, similar_links, texts_of, verified

TAU, SEGMENTS, SHINGLE, SEED = 4, 5, 4, 42
#: Buckets beyond this go the other exact way, by keys of radius TAU / 2, so that a task's memory stays bounded.
BUCKET_LIMIT = 8192
_WIDTHS = [13, 13, 13, 13, 12]
_STARTS = [0, 13, 26, 39, 52]
_BLOCK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash. None and texts without words give 0; fewer words than a shingle are one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    last = min(shingle, len(words)) - 1
    begin, end = starts[: len(words) - last].tolist(), (starts + lengths)[last:].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[s:e], seed) for s, e in zip(begin[at : at + _BLOCK], end[at : at + _BLOCK])], dtype="<u8") for at in range(0, len(begin), _BLOCK))


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in blocks:
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        values = np.array([fingerprint(t) for t in batch["text"]], dtype=np.uint64).view(np.int64)
        yield batch.drop(columns="text").assign(fp=values)


def fingerprints(docs: DataFrame, id_type: str = "long") -> DataFrame:
    """(doc_id, fp long) of every row; rows of docs are kept as they are, repeated or not."""
    light = docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return light.mapInPandas(_fingerprints, f"doc_id {id_type}, fp long")


def _segment(values: np.ndarray, i: int) -> np.ndarray:
    i %= SEGMENTS
    return (values >> np.uint64(_STARTS[i])) & np.uint64((1 << _WIDTHS[i]) - 1)


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each fingerprint, ring position, and zero bit of the next segment that is probed set (or none: base)."""
    for batch in batches:
        for at in range(0, len(batch), _BLOCK):
            values = batch["fp"].to_numpy(dtype=np.int64)[at : at + _BLOCK].view(np.uint64)
            out = []
            for i in range(SEGMENTS):
                width = _WIDTHS[(i + 1) % SEGMENTS]
                following = _segment(values, i + 1)
                base = (np.uint64(i) << np.uint64(32)) | (_segment(values, i) << np.uint64(width)) | following
                out.append((base, values, np.ones(len(values), dtype=bool)))
                for j in range(width):
                    bit = np.uint64(1 << j)
                    zero = (following & bit) == 0
                    out.append((base[zero] | bit, values[zero], np.zeros(int(zero.sum()), dtype=bool)))
            yield pd.DataFrame({"bucket": np.concatenate([x[0] for x in out]).view(np.int64), "fp": np.concatenate([x[1] for x in out]).view(np.int64), "base": np.concatenate([x[2] for x in out])})


def _chain_masks() -> list[list[tuple[np.uint64, int]]]:
    """For each ring position: the bits of each chain from 2 segments on, and the bits that may differ there."""
    masks = []
    for i in range(SEGMENTS):
        mask, chains = 0, []
        for length in range(1, SEGMENTS + 1):
            s = (i + length - 1) % SEGMENTS
            mask |= ((1 << _WIDTHS[s]) - 1) << _STARTS[s]
            if length > 1:
                chains.append((np.uint64(mask), TAU * length // SEGMENTS))
        masks.append(chains)
    return masks


_CHAINS = _chain_masks()


def _close(ring: np.ndarray | int, difference: np.ndarray) -> np.ndarray:
    """Whether the differing bits pass the pigeonring chains from this position and the Hamming limit, which is the last chain."""
    passed = np.ones(len(difference), dtype=bool)
    for length in range(SEGMENTS - 1):
        if np.isscalar(ring):
            mask, most = _CHAINS[ring][length]
        else:
            mask, most = np.array([c[length][0] for c in _CHAINS], dtype=np.uint64)[ring], _CHAINS[0][length][1]
        still = np.flatnonzero(passed)
        if not len(still):
            break
        kept = np.bitwise_count(difference[still] & (mask[still] if isinstance(mask, np.ndarray) else mask)) <= most
        passed[still] = kept
    return passed


def _forest(ring: int, values: np.ndarray, base: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links in a bucket between rows of which one is a base row."""
    left, edges = np.arange(len(values)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _close(ring, values[left] ^ values[at]) & (base[left] | base[at])
            found = left[near]
            if len(found):
                edges += [(int(values[at]), int(values[x])) for x in found]
                queue += found.tolist()
                left = left[~near]
    return edges


def _links(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket -> links (a, b), or (a, null) for the rows of a bucket beyond the limit."""

    def table(pairs: list[tuple[int, int]], beyond: np.ndarray | None = None) -> pd.DataFrame:
        ends = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        a, b = pd.Series(ends[:, 0], dtype="Int64"), pd.Series(ends[:, 1], dtype="Int64")
        if beyond is not None:
            more = pd.Series(beyond.view(np.int64), dtype="Int64")
            a, b = pd.concat([a, more]), pd.concat([b, pd.Series([pd.NA] * len(more), dtype="Int64")])
        return pd.DataFrame({"a": a.reset_index(drop=True), "b": b.reset_index(drop=True)})

    rest, over = None, None
    for batch in batches:
        key = batch["bucket"].to_numpy(dtype=np.int64)
        values, base = batch["fp"].to_numpy(dtype=np.int64).view(np.uint64), batch["base"].to_numpy(dtype=bool)
        if over is not None:
            same = int(np.searchsorted(key, over, side="right"))
            if same:
                yield table([], values[:same])
            key, values, base = key[same:], values[same:], base[same:]
            if not len(key):
                continue
            over = None
        if rest is not None:
            key, values, base = (np.concatenate(x) for x in zip(rest, (key, values, base)))
        cuts = np.flatnonzero(np.diff(key)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        if len(key) - last > limit:
            yield table([], values[last:])
            over, rest = int(key[-1]), None
        else:
            rest = tuple(x[last:].copy() for x in (key, values, base))
        if last:
            yield from _runs(key[:last], values[:last], base[:last], table, limit)
    if rest is not None and len(rest[0]):
        yield from _runs(*rest, table, limit)


def _runs(key, values, base, table, limit) -> Iterator[pd.DataFrame]:
    starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    two = starts[sizes == 2]
    ok = base[two] | base[two + 1]
    two = two[ok]
    near = two[_close((key[two] >> 32).astype(np.int64), values[two] ^ values[two + 1])]
    pairs = list(zip(values[near].tolist(), values[near + 1].tolist()))
    for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        own = slice(at, at + size)
        if size > limit:
            yield table([], values[own])
        elif base[own].any():
            pairs += _forest(int(key[at]) >> 32, values[own], base[own])
    if pairs:
        yield table(pairs)


_BALL = np.array([0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))], dtype=np.uint64)


def _balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        values = batch["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        for at in range(0, len(values), 32):
            part = values[at : at + 32]
            yield pd.DataFrame({"ball": (part[:, None] ^ _BALL[None, :]).reshape(-1).view(np.int64), "fp": np.repeat(part, len(_BALL)).view(np.int64)})


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ball -> links between neighbours of a ball, which join all its members."""
    ball, fp = None, None
    for batch in batches:
        balls, fps = batch["ball"].to_numpy(dtype=np.int64), batch["fp"].to_numpy(dtype=np.int64)
        if ball is not None:
            balls, fps = np.concatenate(([ball], balls)), np.concatenate(([fp], fps))
        ball, fp = balls[-1], fps[-1]
        same = np.flatnonzero((balls[1:] == balls[:-1]) & (fps[1:] != fps[:-1]))
        yield pd.DataFrame({"a": fps[same], "b": fps[same + 1]}).drop_duplicates()


def near_links(scratch: Scratch, distinct_fps: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs of fp within TAU bits. distinct_fps: fp, no repeats.

    Members of buckets beyond the limit link through every key at most TAU / 2 bits away that they share: two fingerprints
    share such a key exactly if they are within TAU bits, so links between a key's neighbours are enough, and a key has
    no more members than it has keys around.
    """
    keyed = distinct_fps.select("fp").mapInPandas(_keys, "bucket long, fp long, base boolean")
    found = keyed.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInPandas(lambda batches: _links(batches, limit), "a long, b long")
    found = scratch.cut(found, "simhash-links")
    scratch.collect_shuffles()
    links = found.where("b IS NOT NULL").distinct()
    crowded = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if crowded.isEmpty():
        return links
    balls = crowded.mapInPandas(_balls, "ball long, fp long")
    return links.union(balls.repartition("ball").sortWithinPartitions("ball", "fp").mapInPandas(_meetings, "a long, b long").distinct())


def components(scratch: Scratch, prints: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(fp, component, component_id) for each distinct fp of prints(doc_id, fp): its component's smallest fp and smallest doc_id.

    Links are those of the fingerprints, unless others are given.
    """
    nodes = scratch.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    joined = connected_components(scratch, near_links(scratch, nodes) if links is None else links)
    labelled = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    labelled = scratch.cut(labelled, "simhash-labelled", nodes.count())
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return labelled.join(ids, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows give repeated results. Rows whose
    doc_id is null take part in linking; their component is the smallest doc_id that is not null, or null if there is none.
    Other columns are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.cut(fingerprints(docs), "simhash-fps")
    return prints.join(components(scratch, prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            hashes = shingle_hashes(text)
            own = np.unique(hashes)
            sim = np.uint64(majority(hashes[at : at + _BLOCK] for at in range(0, len(hashes), _BLOCK)))
            rows.append((set_print(own), int(sim.view(np.int64)), len(own), bitmap(own).tobytes()))
        columns = {c: [r[i] for r in rows] for i, c in enumerate(("fp", "sim", "n", "bits"))}
        yield batch.drop(columns="text").assign(**columns)


def _copy_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, sim, n, bits) of every row: the digest of its set of five-word shingles, their SimHash, number and bitmap."""
    return texts_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInPandas(_copies, "doc_id long, fp long, sim long, n long, bits binary")


def _sim_links(scratch: Scratch, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) of fps: members of a component of SimHashes within TAU bits whose sets have a similarity of 4/5 with its head."""
    joined = connected_components(scratch, near_links(scratch, nodes.select(F.col("sim").alias("fp")).distinct()))
    placed = nodes.select("fp", "sim").join(joined.withColumnRenamed("node", "sim"), "sim", "left").select("fp", F.coalesce("component", "sim").alias("component"))
    placed = scratch.cut(placed, "simhash-placed", nodes.count())
    heads = placed.groupBy("component").agg(F.min_by("fp", F.struct(F.xxhash64("fp"), F.col("fp"))).alias("head"))
    pairs = placed.join(heads, "component").where("fp <> head").select(F.least("fp", "head").alias("a"), F.greatest("fp", "head").alias("b"))
    return verified(scratch, docs, nodes, scratch.cut(pairs, "simhash-pairs"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ..) without the near-duplicates: of each component, the row with the smallest doc_id stays, all its columns with it.

    Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 at least. SimHashes of these
    shingles, by pigeonring filtering, give the close ones, which are verified. At 0.8 SimHashes are some 10 of 64 bits apart,
    more than they can search, so what they leave is found by prefix filtering (shingle_sets), among texts not joined yet.
    Null texts and texts without words are near-duplicates of each other. Where that doc_id is repeated within the component,
    or null as all others there, one of its rows stays. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.cut(_copy_prints(docs), "shingles-fps")
    sets = prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.min("sim").alias("sim"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    sets = scratch.cut(sets, "simhash-sets")
    by_fp = components(scratch, prints, similar_links(scratch, docs, sets, _sim_links(scratch, docs, sets)))
    leaders = prints.join(by_fp, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    led = leaders.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    led = scratch.cut(led, "simhash-leaders")
    single = led.where("n = 1 AND doc_id IS NOT NULL").select("doc_id")
    # A row whose doc_id leads is the leader itself if the doc_id is nowhere else in the table.
    repeated = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").join(led.select(F.col("doc_id").alias("_id")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    repeated = scratch.cut(repeated.select("doc_id"), "simhash-repeated")
    if repeated.isEmpty():
        return docs.join(single, "doc_id", "left_semi").select(*docs.columns)
    out = docs.join(single.join(repeated, "doc_id", "left_anti"), "doc_id", "left_semi").select(*docs.columns)
    return out.unionByName(_one_of_each(scratch, docs, repeated, by_fp))


def _one_of_each(scratch: Scratch, docs: DataFrame, repeated: DataFrame, by_fp: DataFrame) -> DataFrame:
    """Rows of docs with a doc_id in repeated: one for each component that this doc_id leads."""
    row = "_slateworks_row"
    some = docs.join(repeated.select(F.col("doc_id").alias("_slateworks_id")), F.col("doc_id").eqNullSafe(F.col("_slateworks_id")), "left_semi")
    some = scratch.cut(some.withColumn(row, F.monotonically_increasing_id()), "simhash-some")
    prints = _copy_prints(some.select(F.col(row).alias("doc_id"), "text")).withColumnRenamed("doc_id", row)
    own = some.select("doc_id", row).join(prints, row).join(by_fp, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = own.groupBy("component").agg(F.min(row).alias(row)).select(row)
    return some.join(first, row, "left_semi").select(*docs.columns)
