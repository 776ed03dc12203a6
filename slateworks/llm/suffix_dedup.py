"""Removal of byte strings that occur twice: string ranks around content-chosen positions, and plain prefix doubling.

repeated_spans, which the query uses: a string of LENGTH bytes that starts at p is named by ranks of ever longer strings
around an anchor in it. The anchor is the position with the smallest hash of SEED_BYTES bytes among those at
p .. p + LENGTH - SEED_BYTES, so equal strings have equal anchors, and one position in about 76 is an anchor. Round 0 ranks
the anchors' SEED_BYTES bytes; each further round ranks longer strings, at growing offsets before and behind the anchor,
for ever smaller groups of the strings that share it. A rank that occurs once ends all strings of its group; a group whose
bytes all occur twice is done; the rest goes on, until a group is a single string of LENGTH bytes. Spark groups the ranks:
no group of equal strings meets in one task except as a partially summed count.

doubled_spans is the plain form: every position has a rank, pairs of ranks at offsets 25, 50 and 100 are sorted and ranked
anew, and positions whose rank is unique drop out. It gives the same bytes, but its rows are all positions of the corpus;
the README has its measured figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateworks.llm._common import Scratch

LENGTH, SEED_BYTES = 200, 50
#: Sizes of the groups of start offsets of one anchor after each round; 1 is a single string of LENGTH bytes.
GROUPS = (38, 7, 1)
#: Bytes of the first ranks of plain doubling; LENGTH is this times a power of 2.
FIRST = 25
#: Starts handled at once: bounds memory, and keeps positions within the low bits of what the sliding minimum compares.
_BLOCK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_rng = np.random.default_rng(20240229)
_TABLES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = [int(x) | 1 for x in _rng.integers(1 << 60, 1 << 63, 2, dtype=np.uint64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of the bases modulo 2^64 and of their inverses, as many as the longest block needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones((2, 1), dtype=np.uint64)

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        row = np.full(n, base, dtype=np.uint64)
        row[0] = 1
        return np.cumprod(row)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.shape[1] < n:
            n = max(n, 2 * self.up.shape[1])
            inverses = [pow(b, -1, 1 << 64) for b in _BASES]
            self.up, self.down = (np.stack([self._row(b, n) for b in bases]) for bases in (_BASES, inverses))
        return self.up, self.down


_powers = _Powers()


class _Hasher:
    """Fingerprints of substrings of a byte array, two independent ones of 64 bits each."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers.upto(len(data) + 1)
        self.sums = np.zeros((2, len(data) + 1), dtype=np.uint64)
        for k in range(2):
            np.cumsum(_TABLES[k][data] * up[k, : len(data)], out=self.sums[k, 1:])

    def of(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[k][end] - self.sums[k][start]) * self.down[k][start])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, values
    while 2 * span <= width:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _anchors(data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each block of starts: anchor, least and greatest distance from the starts that chose it, two ranks, in order."""
    starts = len(data) - LENGTH + 1
    width = LENGTH - SEED_BYTES + 1
    for at in range(0, max(0, starts), _BLOCK):
        part = data[at : min(len(data), at + _BLOCK + LENGTH - 1)]
        hasher, n = _Hasher(part), len(part) - SEED_BYTES + 1
        where = np.arange(n)
        seeds = hasher.of(0, where, where + SEED_BYTES)
        # The rightmost smallest hash: a position further right counts as smaller.
        least = _sliding_least((seeds & ~_LOW) | (_LOW - where.astype(np.uint64)), width)
        chosen = (_LOW - (least & _LOW)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(chosen)) + 1))
        last = np.concatenate((first[1:] - 1, [len(chosen) - 1]))
        anchor = chosen[first]
        spread = hasher.of(1, first, last + LENGTH) ^ _mixed((anchor - first).astype(np.uint64) * np.uint64(1024) + (anchor - last).astype(np.uint64))
        yield at + anchor, anchor - last, anchor - first, seeds[anchor], spread


def _pack(anchor: np.ndarray, near: np.ndarray, far: np.ndarray, ref: np.ndarray | int = 0) -> np.ndarray:
    return (anchor.astype(np.int64) << 17) | (near.astype(np.int64) << 9) | (far.astype(np.int64) << 1) | ref


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts -> round 0: anchors with the range of distances of their starts, the rank of the seed, and that of all bytes."""
    for batch in batches:
        rows: list = []
        size = 0
        for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"]):
            for anchor, near, far, rank, whole in _anchors(np.frombuffer(text, dtype=np.uint8)):
                rows.append((np.full(len(anchor), k1), np.full(len(anchor), k2), _pack(anchor, near, far), rank.view(np.int64), whole.view(np.int64)))
                size += len(anchor)
                if size > 200_000:
                    yield pd.DataFrame(dict(zip(("k1", "k2", "item", "rank", "whole"), map(np.concatenate, zip(*rows)))))
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(dict(zip(("k1", "k2", "item", "rank", "whole"), map(np.concatenate, zip(*rows)))))


def _cut_out(source_far: int | None):
    """Bytes with the items still open in them -> a row for each item with the bytes of its strings.

    source_far: None where bytes are a whole text; else bytes begin that of column far before the anchor. Rows of equal
    texts follow each other and give their items once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for batch in batches:
            rows: list = []
            size = 0
            fars = batch["item"] if source_far is not None else [None] * len(batch)
            for k1, k2, own, text, items in zip(batch["k1"], batch["k2"], fars, batch["bytes"], batch["items"]):
                if own is None:
                    if (k1, k2) == before:
                        continue
                    before = (k1, k2)
                for item in items:
                    item = int(item)
                    anchor, near, far = item >> 17, item >> 9 & 255, item >> 1 & 255
                    at = anchor if own is None else int(own) >> 1 & 255
                    rows.append((k1, k2, item, text[at - far : at - near + LENGTH]))
                    size += LENGTH + far - near
                if size > 8_000_000:
                    yield pd.DataFrame(rows, columns=["k1", "k2", "item", "bytes"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["k1", "k2", "item", "bytes"])

    return run


def _split(group: int):
    """Open items -> their parts: distances cut at multiples of group, with the rank of what all strings of the part share.

    rank covers the bytes common to every string of the full group of distances, so it can be compared between items;
    whole covers all bytes of the strings that this item has in the part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for from_ in range(0, len(batch), 20_000):
                part = batch.iloc[from_ : from_ + 20_000]
                item = part["item"].to_numpy(dtype=np.int64)
                anchor, near, far, ref = item >> 17, item >> 9 & 255, item >> 1 & 255, item & 1
                sizes = np.array([len(x) for x in part["bytes"]], dtype=np.int64)
                offset = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                hasher = _Hasher(np.frombuffer(b"".join(part["bytes"]), dtype=np.uint8))
                parts = far // group - near // group + 1
                row = np.repeat(np.arange(len(part)), parts)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                low = (near[row] // group + nth) * group
                high = np.minimum(low + group - 1, LENGTH - SEED_BYTES)
                own_low, own_high = np.maximum(low, near[row]), np.minimum(high, far[row])
                # byte i of an item is at distance far - i before its anchor
                zero = offset[row] + far[row]
                tag = _mixed(low.astype(np.uint64) + np.uint64(group << 16))
                rank = hasher.of(0, zero - low, zero - high + LENGTH) ^ tag
                span = own_low.astype(np.uint64) * np.uint64(1024) + own_high.astype(np.uint64)
                whole = hasher.of(1, zero - own_high, zero - own_low + LENGTH) ^ _mixed(span + tag)
                frame = {"id": part["id"].to_numpy()[row], "k1": part["k1"].to_numpy()[row], "k2": part["k2"].to_numpy()[row]}
                yield pd.DataFrame(frame | {"item": _pack(anchor[row], own_low, own_high, ref[row]), "rank": rank.view(np.int64), "whole": whole.view(np.int64)})

    return run


def _merge(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the ranges (start << 20 | length), as begins and ends of maximal runs."""
    packed = np.sort(np.asarray(packed, dtype=np.int64))
    begin = packed >> 20
    end = np.maximum.accumulate(begin + (packed & ((1 << 20) - 1)))
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    return begin[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(end) - 1]))]


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch["text"], batch["spans"]):
            begins, ends = _merge(spans) if spans is not None and len(spans) else (np.zeros(0, np.int64),) * 2
            rest, at = hashlib.sha256(), 0
            for begin, end in zip(begins.tolist(), ends.tolist()):
                rest.update(text[at:begin])
                at = end
            rest.update(text[at:])
            runs = np.stack([begins, ends], axis=1).reshape(-1)
            rows.append((len(text), int((ends - begins).sum()), len(begins), rest.hexdigest(), runs))
        yield pd.DataFrame({"doc_id": batch["doc_id"]} | dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "runs"), zip(*rows) if rows else [[]] * 5)))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the text's bytes (null: empty), and a key of 128 bits that equal texts share."""
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit("").cast("binary"))
    half = lambda at: F.conv(F.substring(F.md5(text), at, 16), 16, -10).cast("long")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"), half(1).alias("k1"), half(17).alias("k2"))


def _spans(items: DataFrame) -> DataFrame:
    """The bytes of the items' strings, as (k1, k2, start << 20 | length)."""
    anchor, near, far = F.shiftright("item", 17), F.shiftright("item", 9).bitwiseAND(255), F.shiftright("item", 1).bitwiseAND(255)
    return items.select("k1", "k2", (F.shiftleft(anchor - far, 20) + far - near + LENGTH).alias("span"))


def _ranked(scratch: Scratch, items: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Items done, and items to go on with, of those whose rank occurs again.

    Done: all bytes of the item's strings occur again in the same place. Open ones go on, and with them, for each other
    content of the same rank, one item that stands for it (its lowest bit is set: it is compared with, but not judged).
    """
    ref = F.col("item").bitwiseAND(1) == 1
    # Written first: Spark splits a rank with very many items only in a join that reads both sides from a shuffle.
    twice = scratch.cut(items.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank"), f"{name}-ranks")
    kept = scratch.cut(items.join(twice, "rank", "left_semi"), f"{name}-twice")
    content = kept.groupBy("rank", "whole").agg(F.count(F.lit(1)).alias("n"), F.bool_or(ref).alias("ref"), F.min("item").alias("item"), F.min_by(F.struct(*(c for c in kept.columns if c not in ("rank", "whole", "item"))), F.col("item")).alias("of"))
    content = scratch.cut(content, f"{name}-content")
    done = kept.where(~ref).join(content.where("n > 1").select("rank", "whole"), ["rank", "whole"], "left_semi")
    waiting = scratch.cut(content.where("n = 1 AND NOT ref").select("rank").distinct(), f"{name}-waiting")
    some = content.join(waiting, "rank", "left_semi")
    judged = (F.col("n") == 1) & ~F.col("ref")
    item = F.when(judged, F.col("item")).otherwise(F.col("item").bitwiseOR(F.lit(1).cast("long")))
    return done, some.select("of.*", item.alias("item"))


def repeated_spans(scratch: Scratch, keyed: DataFrame) -> DataFrame:
    """(k1, k2, span): byte ranges that together cover every string of LENGTH bytes which starts anywhere else too."""
    long_ = keyed.where(F.length("text") >= LENGTH)
    items = scratch.cut(long_.select("k1", "k2", "text").mapInPandas(_items, "k1 long, k2 long, item long, rank long, whole long"), "items")
    done, open_ = _ranked(scratch, items, "round0")
    found = [scratch.cut(_spans(done).distinct(), "spans0")]
    listed = open_.groupBy("k1", "k2").agg(F.collect_list("item").alias("items"))
    source = long_.select("k1", "k2", F.col("text").alias("bytes")).join(listed, ["k1", "k2"])
    schema = "k1 long, k2 long, item long, bytes binary"
    parts = scratch.cut(source.mapInPandas(_cut_out(None), schema).withColumn("id", F.monotonically_increasing_id()), "bytes0")
    for name in ("items", "round0-ranks", "round0-waiting", "round0-twice", "round0-content"):
        scratch.drop(name)
    for number, group in enumerate(GROUPS, 1):
        items = scratch.cut(parts.mapInPandas(_split(group), "id long, k1 long, k2 long, item long, rank long, whole long"), f"items{number}")
        done, open_ = _ranked(scratch, items, f"round{number}")
        found.append(scratch.cut(_spans(done).distinct(), f"spans{number}"))
        if group > 1:
            listed = open_.groupBy("id").agg(F.collect_list("item").alias("items"))
            parts = scratch.cut(parts.join(listed, "id").mapInPandas(_cut_out(1), schema).withColumn("id", F.monotonically_increasing_id()), f"bytes{number}")
        for name in (f"items{number}", f"round{number}-ranks", f"round{number}-waiting", f"round{number}-twice", f"round{number}-content", f"bytes{number - 1}"):
            scratch.drop(name)
    out = found[0]
    for spans in found[1:]:
        out = out.union(spans)
    return out.distinct()


def _positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts -> (row, p, rank) for each position with FIRST bytes from it on: two fingerprints of them in one."""
    for batch in batches:
        for row, text in zip(batch["row"], batch["text"]):
            data = np.frombuffer(text, dtype=np.uint8)
            for at in range(0, len(data) - FIRST + 1, _BLOCK):
                part = data[at : at + _BLOCK + FIRST - 1]
                where = np.arange(len(part) - FIRST + 1)
                hasher = _Hasher(part)
                rank = hasher.of(0, where, where + FIRST) ^ _mixed(hasher.of(1, where, where + FIRST))
                yield pd.DataFrame({"row": np.full(len(where), row), "p": at + where, "rank": rank.view(np.int64)})


def _reranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (rank, next) -> those whose pair occurs again, ranked by the place of the pair in the order."""
    from pyspark import TaskContext

    high, place, last, held = TaskContext.get().partitionId() << 40, 0, None, None
    for batch in batches:
        if not len(batch):
            continue
        pairs = batch[["rank", "next"]].to_numpy()
        new = np.concatenate(([last is None or tuple(pairs[0]) != last], (pairs[1:] != pairs[:-1]).any(axis=1)))
        ranks = place + np.cumsum(new)
        again = np.concatenate((~new[1:], [False])) | ~new
        if held is not None and not new[0]:
            yield held
        out = batch[["row", "p"]].assign(rank=high + ranks)
        # Whether the last row is alone shows in the next batch.
        held = None if again[-1] else out.iloc[-1:]
        place, last = int(ranks[-1]), tuple(pairs[-1])
        yield out[again]


def doubled_spans(scratch: Scratch, texts: DataFrame) -> DataFrame:
    """(row, p) of texts(row, text) where a string of LENGTH bytes starts that starts anywhere else too, by prefix doubling."""
    ranks, length = scratch.cut(texts.mapInPandas(_positions, "row long, p long, rank long"), "doubling"), FIRST
    name = "doubling"
    while length < LENGTH:
        other = ranks.select("row", (F.col("p") - length).alias("p"), F.col("rank").alias("next"))
        pairs = ranks.join(other, ["row", "p"])
        order = ("rank", "next")
        fresh = scratch.cut(pairs.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_reranked, "row long, p long, rank long"), f"doubling{length}")
        scratch.drop(name)
        ranks, length, name = fresh, 2 * length, f"doubling{length}"
    return ranks.select("row", "p")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, runs) for every row of docs(doc_id, text).

    Every byte covered by a string of LENGTH bytes that starts anywhere else as well is removed; strings never cross rows,
    repeated rows count as places of their own, and all strings are judged on the input. runs: begin and end of each
    removed run, in bytes. A null text counts as empty, texts shorter than LENGTH stay whole, a null doc_id stays null, and
    other columns are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    keyed = _keyed(docs)
    spans = repeated_spans(scratch, keyed).groupBy("k1", "k2").agg(F.collect_list("span").alias("spans"))
    joined = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    out = joined.mapInPandas(_removed, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, runs array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
