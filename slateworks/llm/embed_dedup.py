"""Near-duplicates among embeddings by cross-polytope hashing, with multiprobe buckets and verified pairs.

A hash of a vector is the axis nearest to it after a random rotation (three rounds of random signs and a fast Hadamard
transform); vectors of few dimensions are filled up with zeros to LEAST_DIM first, so that there are axes and rotations
enough. PARTS hashes together name a bucket of a table, whatever the number of vectors; each vector lies in its own bucket and probes the PROBES next
likely ones. Within a bucket every pair of an owner with another row is verified by its cosine in double precision. A pair
that several tables find counts in the first of them. A bucket gives sums and a spanning forest of its links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateworks.llm._common import Scratch, connected_components

COSINE, PARTS, TABLES, PROBES, SEED = 0.98, 4, 6, 5, 977
#: With PARTS hashes of 2 * LEAST_DIM axes a table has 2^28 buckets for each label at least.
LEAST_DIM = 64
#: Rows of a bucket that meet in one task at once; larger buckets are cut into blocks, and every pair of blocks meets.
BLOCK = 4096
#: Pairs of rows compared at once within a block.
_PAIRS = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x, filled up with zeros to the length of signs (rounds, n), after each round's signs and Hadamard transform."""
    n = signs.shape[1]
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    for sign in signs:
        y = y * sign
        h = 1
        while h < n:
            y = y.reshape(len(x), n // (2 * h), 2, h)
            y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
            h *= 2
        y /= math.sqrt(n)
    return y


def bucket_keys(x: np.ndarray, label: np.ndarray, parts: int = PARTS, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Keys (rows, tables, 1 + probes) of unit vectors: first each one's own bucket, then those probed, by how near they are."""
    n = max(LEAST_DIM, 1 << max(0, x.shape[1] - 1).bit_length())
    rng = np.random.default_rng([seed, x.shape[1]])
    rows = np.arange(len(x))
    out = np.empty((len(x), tables, 1 + probes), dtype=np.uint64)
    top = 3
    for t in range(tables):
        axes, loss = [], []
        for _ in range(parts):
            y = rotated(x, rng.choice([-1.0, 1.0], (3, n)))
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :top]
            axes.append(2 * best + (y[rows[:, None], best] < 0))
            value = size[rows[:, None], best]
            loss.append((value[:, :1] - value) ** 2)
        # The own bucket, then each change of one hash to its second or third axis, or of two to their second.
        ways = [(0,) * parts, *(tuple(a if i == p else 0 for i in range(parts)) for p in range(parts) for a in range(1, top)), *(tuple(int(i in (p, q)) for i in range(parts)) for p in range(parts) for q in range(p))]
        cost = np.stack([sum(loss[p][:, a] for p, a in enumerate(w)) for w in ways], axis=1)
        cost[:, 0] = -1
        key = np.stack([_key(t, [axes[p][:, a] for p, a in enumerate(w)], label, x.shape[1]) for w in ways], axis=1)
        order = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
        picked = key[rows[:, None], order]
        if picked.shape[1] < 1 + probes:
            picked = np.concatenate([picked, np.repeat(picked[:, :1], 1 + probes - picked.shape[1], axis=1)], axis=1)
        out[:, t] = picked
    return out


def _key(table: int, axes: list[np.ndarray], label: np.ndarray, dim: int) -> np.ndarray:
    h = label.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(table * 65536 + dim)
    for a in axes:
        h = (h ^ (h >> np.uint64(29))) * _MIX + a.astype(np.uint64) + np.uint64(1)
    return h ^ (h >> np.uint64(31))


def _hashed(tables: int, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["embedding"].map(len), sort=True):
                x = np.array(part["embedding"].tolist(), dtype=float)
                x /= np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(axis=1, keepdims=True)
                keys = bucket_keys(x, part["label"].to_numpy(), PARTS, tables, probes).view(np.int64)
                yield pd.DataFrame({"cid": part["cid"], "n": part["n"], "unit": [r.tobytes() for r in x], "keys": list(keys.reshape(len(x), -1))})

    return run


def _met(tables: int, width: int, threshold: float):
    """Rows of buckets, sorted by bucket and pair of blocks -> (cid, links) sums, and (cid, other) links of spanning forests."""

    def group(cid, n, unit, keys, key, pos, left, right) -> tuple[list, list]:
        table = pos // width
        owner = pos % width == 0
        sums, edges = np.zeros(len(cid), dtype=np.int64), []
        parent = np.arange(len(cid))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        i_all = np.flatnonzero(left)
        rows_at_once = max(1, _PAIRS // len(cid))
        for at in range(0, len(i_all), rows_at_once):
            i = i_all[at : at + rows_at_once]
            near = (unit[i] @ unit.T >= threshold) & right[None, :] & (owner[i][:, None] | owner[None, :]) & (cid[i][:, None] != cid[None, :])
            # Within one block each pair shows twice; keep it once.
            near &= ~(left[None, :] & right[i][:, None]) | (cid[i][:, None] < cid[None, :])
            a, b = np.nonzero(near)
            if not len(a):
                continue
            a = i[a]
            small, large = np.where(cid[a] < cid[b], a, b), np.where(cid[a] < cid[b], b, a)
            t = table[a]
            # Reached: whether the larger one lies in or probes the smaller one's own bucket of the table, or the other way.
            into = np.zeros((2, tables, len(a)), dtype=bool)
            for s in range(tables):
                for w in range(width):
                    into[0, s] |= keys[small, s, 0] == keys[large, s, w]
                    into[1, s] |= keys[large, s, 0] == keys[small, s, w]
            met = into.any(axis=0)
            first = met.argmax(axis=0) == t
            # In its table the pair counts in the bucket of the smaller one if the larger reaches it, else in the larger's.
            first &= np.where(into[0, t, np.arange(len(a))], keys[small, t, 0] == key, keys[large, t, 0] == key)
            a, b = small[first], large[first]
            np.add.at(sums, a, n[b])
            np.add.at(sums, b, n[a])
            for p, q in zip(a.tolist(), b.tolist()):
                rp, rq = root(p), root(q)
                if rp != rq:
                    parent[max(rp, rq)] = min(rp, rq)
                    edges.append((int(cid[p]), int(cid[q])))
        found = np.flatnonzero(sums)
        return list(zip(cid[found].tolist(), sums[found].tolist())), edges

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
                change = np.flatnonzero((rest["key"].to_numpy()[1:] != rest["key"].to_numpy()[:-1]) | (rest["meet"].to_numpy()[1:] != rest["meet"].to_numpy()[:-1])) + 1
                if not len(change):
                    continue
                whole, rest = rest.iloc[: change[-1]], rest.iloc[change[-1] :].reset_index(drop=True)
                starts = [0, *change.tolist()]
            elif rest is not None:
                whole, starts = rest, [0, len(rest)]
            else:
                return
            sums, edges = [], []
            cid, n, pos = (whole[c].to_numpy(dtype=np.int64) for c in ("cid", "n", "pos"))
            side = whole["side"].to_numpy(dtype=np.int64)
            key = whole["key"].to_numpy(dtype=np.int64)
            for begin, end in zip(starts, starts[1:]):
                if end - begin < 2 or not (pos[begin:end] % width == 0).any():
                    continue
                own = slice(begin, end)
                unit = np.stack([np.frombuffer(u) for u in whole["unit"].iloc[own]])
                keys = np.stack(whole["keys"].iloc[own].tolist()).reshape(end - begin, tables, width)
                s, e = group(cid[own], n[own], unit, keys, key[begin], pos[own], side[own] & 1 > 0, side[own] & 2 > 0)
                sums += s
                edges += e
            a = [x[0] for x in sums] + [x[0] for x in edges]
            yield pd.DataFrame({"cid": a, "links": [x[1] for x in sums] + [0] * len(edges), "other": pd.array([None] * len(sums) + [x[1] for x in edges], dtype="Int64")})

    return run


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def _links(scratch: Scratch, hashed: DataFrame, tables: int, probes: int, threshold: float) -> DataFrame:
    """(cid, links, other): see _met. Buckets beyond BLOCK rows are cut, and each pair of their blocks meets on its own."""
    width = 1 + probes
    # Within a table the own bucket comes first, and keys of different tables differ: the first place of a key is enough.
    light = hashed.select("cid", "keys", F.posexplode("keys").alias("pos", "key")).where(F.array_position("keys", F.col("key")) == F.col("pos") + 1).select("cid", "key", "pos")
    crowd = light.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.bool_or(F.col("pos") % width == 0).alias("owned")).where("rows > 1 AND owned")
    hits = light.join(crowd.select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "key")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    hits = hits.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Bit 1: a row of the first block, bit 2: of the second; a block with itself has both.
    meet = F.least("own", "with") * F.col("blocks") + F.greatest("own", "with")
    side = F.when(F.col("own") == F.col("with"), 3).when(F.col("own") < F.col("with"), 1).otherwise(2)
    rows = hits.select("cid", "key", "pos", meet.cast("long").alias("meet"), side.alias("side")).join(hashed, "cid")
    dealt = rows.select("key", "meet", "cid", "n", "pos", "side", "unit", "keys").repartition("key", "meet").sortWithinPartitions("key", "meet", "cid")
    return scratch.cut(dealt.mapInPandas(_met(tables, width, threshold), "cid long, links long, other long"), "embed-links")


def near_duplicates(vectors: DataFrame, threshold: float = COSINE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, label, embedding).

    Rows link if their labels are equal and not null, their vectors have the same length, and their cosine in double precision
    is threshold or more. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; they
    and others without links are components of their own. Equal vectors of a label are one class, which is hashed once; each of
    its rows links with the rest of the class. component_id is the smallest vec_id that is not null; a row with a null vec_id
    and no link has a null one, and kept is false there. Other columns are not read; an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession)
    row = F.col("embedding").cast("array<double>")
    light = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), row.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    light = light.withColumn("usable", usable)
    classes = light.where("usable").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = scratch.cut(classes.withColumn("cid", F.monotonically_increasing_id()), "embed-classes")
    hashed = scratch.cut(classes.select("cid", "n", "label", "embedding").mapInPandas(_hashed(tables, probes), "cid long, n long, unit binary, keys array<long>"), "embed-hashed")
    links = _links(scratch, hashed, tables, probes, threshold)
    sums = links.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = connected_components(scratch, links.where("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    labelled = classes.select("cid", "label", "embedding", "n", "least").join(sums, "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    labelled = scratch.cut(labelled.select("label", "embedding", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("component")), "embed-labelled")
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    found = labelled.join(ids, "component").select("label", "embedding", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    good = light.where("usable").join(found, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = light.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
