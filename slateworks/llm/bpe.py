"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised on its own, in parallel; two neighbours are
stitched where a pre-token boundary of both falls on the same place, for from there on they agree. Only boundaries that no
context can move are used: before a space and a letter, after a visible ASCII character. The pieces between the stitches are
then encoded in parallel and joined in order. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateworks.llm._common import Scratch

#: Code points of a chunk, and of what a chunk reads beyond its begin and end.
CHUNK, OVERLAP = 1 << 15, 512
#: Runs of white space this long overflow the stack of the library's regular expressions; they are matched here instead.
_LONG_SPACE = regex.compile(r"\p{White_Space}{2000}")


def read_ranks(path: str) -> bytes:
    """The rank file as it is. A vocabulary has a fixed size, about 1 MB."""
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encodes and decodes by the ranks of a tiktoken file, each match of the pattern separately."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})"))

    def encode(self, text: str) -> np.ndarray:
        if _LONG_SPACE.search(text):
            single = self.encoding._core_bpe.encode_single_piece
            ids = [i for m in self.pattern.finditer(text) for i in single(m[0].encode())]
        else:
            ids = self.encoding.encode_ordinary(text)
        return np.array(ids, dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())

    def boundaries(self, text: str) -> list[int]:
        """Ends of the pre-tokens of text that more text behind it could not move: all but the last two."""
        return [m.end() for m in self.pattern.finditer(text)][:-2]


_codecs: dict = {}


def _codec(ranks: bytes, pattern: str) -> Codec:
    """One for each Python worker and vocabulary."""
    key = hashlib.md5(ranks).digest(), pattern
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def safe_stitches(text: str, ends: list[int], first: int, last: int) -> list[int]:
    """Of these pre-token ends, those from first to last that no context can move."""
    out = []
    for p in ends:
        if first <= p <= last and 0 < p < len(text) - 1:
            a, b, c = text[p - 1], text[p], text[p + 1]
            if b == " " and "!" <= a <= "~" and c.isascii() and c.isalpha():
                out.append(p)
    return out


def stitched(chunks: list[tuple[int, list[int], list[int]]]) -> list[int]:
    """Where the pieces of a text begin. chunks, in order: number, boundaries near its begin, and near its end."""
    starts = [0]
    for (_, _, tail), (_, head, _) in zip(chunks, chunks[1:]):
        # Without a common boundary the two stay one piece.
        if common := set(tail) & set(head):
            starts.append(min(common))
    return starts


def _pieces(df: DataFrame, codec: Callable[[], Codec], chunk: int, overlap: int, scratch: Scratch) -> DataFrame:
    """df(_row, text) of long texts -> (_row, _part, text): pieces whose encodings in order are that of the text."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["_row"], batch["text"]):
                for first in range(0, (len(text) + chunk - 1) // chunk, 64):
                    parts = range(first, min(first + 64, (len(text) + chunk - 1) // chunk))
                    at = [max(0, part * chunk - overlap) for part in parts]
                    yield pd.DataFrame({"_row": row, "_part": list(parts), "_at": at, "text": [text[a : part * chunk + chunk + overlap] for part, a in zip(parts, at)]})

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec()
        for batch in batches:
            rows = []
            for row, part, at, text in zip(batch["_row"], batch["_part"], batch["_at"], batch["text"]):
                ends, start = own.boundaries(text), part * chunk - at
                head = safe_stitches(text, ends, max(0, start - overlap // 2), start + overlap // 2) if part else []
                tail = safe_stitches(text, ends, start + chunk - overlap // 2, start + chunk + overlap // 2)
                rows.append((row, part, [at + p for p in head], [at + p for p in tail]))
            yield pd.DataFrame(rows, columns=["_row", "_part", "head", "tail"])

    dealt = df.select("_row", "text").mapInPandas(windows, "_row long, _part int, _at long, text string")
    ends = dealt.repartition("_row", "_part").mapInPandas(near, "_row long, _part int, head array<long>, tail array<long>")

    @F.pandas_udf("array<long>")
    def joined(chunks: pd.Series) -> pd.Series:
        out = []
        for own in chunks:
            own = sorted((int(c["_part"]), [int(x) for x in c["head"]], [int(x) for x in c["tail"]]) for c in own)
            out.append(stitched(own))
        return pd.Series(out)

    # One list for each text, of a few hundred numbers for each of its chunks.
    starts = ends.groupBy("_row").agg(F.collect_list(F.struct("_part", "head", "tail")).alias("chunks")).select("_row", joined("chunks").alias("starts"))
    starts = scratch.cut(starts, "bpe-starts")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text, begins in zip(batch["_row"], batch["text"], batch["starts"]):
                begins = [int(b) for b in begins]
                for first in range(0, len(begins), 64):
                    own = list(zip(begins, [*begins[1:], len(text)]))[first : first + 64]
                    yield pd.DataFrame({"_row": row, "_part": range(first, first + len(own)), "text": [text[b:e] for b, e in own]})

    return df.select("_row", "text").join(starts, "_row").mapInPandas(pieces, "_row long, _part int, text string").repartition("_row", "_part")


def encoded(docs: DataFrame, ranks: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids binary) for every row of docs(doc_id, text): the ids as little-endian unsigned 32-bit integers.

    Null texts count as empty and give no ids; repeated rows give repeated results; other columns are not read. Texts of up
    to chunk code points are encoded where they are read; only longer ones are dealt out.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    codec = lambda: _codec(*shared.value)

    short, long_ = _dealt(docs, codec, chunk, overlap)
    encode = _encoder(codec)
    return short.select("doc_id", encode("text").alias("ids")).unionByName(long_) if long_ is not None else short.select("doc_id", encode("text").alias("ids"))


def _encoder(codec: Callable[[], Codec]):
    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        own = codec()
        return pd.Series([own.encode(t).tobytes() for t in texts], dtype=object)

    return encode


def _dealt(docs: DataFrame, codec: Callable[[], Codec], chunk: int, overlap: int) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) of the texts of up to chunk code points, and (doc_id, ids) of the longer ones, if there are any."""
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scratch = Scratch(docs.sparkSession)
    short = light.where(F.char_length("text") <= chunk)
    long_ = scratch.cut(light.where(F.char_length("text") > chunk).withColumn("_row", F.monotonically_increasing_id()), "bpe-long")
    if long_.isEmpty():
        return short, None
    parts = _pieces(long_, codec, chunk, overlap, scratch).select("_row", "_part", _encoder(codec)("text").alias("ids"))

    @F.pandas_udf("binary")
    def concat(parts: pd.Series) -> pd.Series:
        return pd.Series([b"".join(bytes(p["ids"]) for p in sorted(own, key=lambda p: p["_part"])) for own in parts], dtype=object)

    # The parts of one text, which was one row before.
    whole = parts.groupBy("_row").agg(F.collect_list(F.struct("_part", "ids")).alias("parts")).select("_row", concat("parts").alias("ids"))
    return short, scratch.cut(long_.select("doc_id", "_row").join(whole, "_row").select("doc_id", "ids"), "bpe-ids")


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the ids of encoded(), and the bytes that decoding them gives."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    codec = lambda: _codec(*shared.value)
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digests(own: Codec, each: Iterator[np.ndarray]) -> pd.DataFrame:
        rows = [(len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()) for ids in each]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    # Encoding, decoding and both sums in one pass, so that one Python worker serves a task.
    @F.pandas_udf(columns)
    def of_text(texts: pd.Series) -> pd.DataFrame:
        own = codec()
        return digests(own, (own.encode(t) for t in texts))

    @F.pandas_udf(columns)
    def of_ids(ids: pd.Series) -> pd.DataFrame:
        return digests(codec(), (np.frombuffer(i, dtype="<u4") for i in ids))

    short, long_ = _dealt(docs, codec, chunk, overlap)
    out = short.select("doc_id", of_text("text").alias("of"))
    out = out if long_ is None else out.unionByName(long_.select("doc_id", of_ids("ids").alias("of")))
    return out.select("doc_id", "of.*")
