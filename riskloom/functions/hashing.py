"""Reproducible pseudo-random order: a function of row key and seed, never of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 1 << 60


def hash_order(key: str | Column, seed: int | str) -> Column:
    """60-bit number from md5 of ``key:seed``; other engines can compute the same text rule."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(key.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_uniform(key: str | Column, seed: int | str) -> Column:
    """Number in [0, 1) from the same rule."""
    return hash_order(key, seed) / F.lit(float(HASH_SPACE))
