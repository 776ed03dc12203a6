import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from slateworks.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.read_ranks(PATH)


def library():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def texts():
    rng = np.random.default_rng(3)
    words = ["it's", "the", " ", "\n\n", "\t", "été", "日本語", "12345", "don't", "!!", " ", "  ", "x" * 40, "Ünder", " ", "🙂", ".", ","]
    made = ["".join(rng.choice(words, n)) for n in (1, 5, 50, 500, 3000)] + [" ".join(rng.choice(words, n)) for n in (10, 1000, 4000)]
    return [None, "", " ", "a" * 5000, " " * 3000 + "x", "a\n\n\nb" * 900, "no space" + "y" * 3000 + " tail of it", *made]


def test_like_the_library(spark):
    lib = library()
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b"), (1, "again"), (1, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    expected = []
    for d, t in rows:
        ids = lib.encode_ordinary(t or "")
        expected.append((d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    for chunk, overlap in ((300, 120), (bpe.CHUNK, bpe.OVERLAP)):
        got = [tuple(r) for r in bpe.round_trip(df, RANKS, PATTERN, chunk, overlap).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
    assert bpe.round_trip(df.limit(0), RANKS, PATTERN).count() == 0


def test_white_space_that_overflows_the_library():
    codec = bpe.Codec(RANKS, PATTERN)
    text = "a" + " " * 3_000_000 + "b\x1cc\x1f d"
    assert codec.decode(codec.encode(text)).decode() == text


@pytest.mark.parametrize("text", [t for t in texts() if t])
def test_own_pre_tokens_are_the_library_s(text):
    codec, lib = bpe.Codec(RANKS, PATTERN), library()
    single = lib._core_bpe.encode_single_piece
    assert [i for m in codec.pattern.finditer(text) for i in single(m[0].encode())] == lib.encode_ordinary(text)
