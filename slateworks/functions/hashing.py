"""Randomness by hashing: a draw depends on its keys alone, so results do not depend on partitions or row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(tag: str, seed: int, *keys: str | Column) -> Column:
    """Hex digest by which rows are put in a random but reproducible order."""
    return F.md5(F.concat_ws(":", F.lit(tag), F.lit(str(seed)), *(F.col(k) if isinstance(k, str) else k for k in keys)))


def draw(tag: str, seed: int, n: str | Column, *keys: str | Column) -> Column:
    """A number from 0 to n - 1."""
    n = F.col(n) if isinstance(n, str) else n
    return F.conv(F.substring(hash_key(tag, seed, *keys), 1, 8), 16, 10).cast("long") % n
