"""Repeatable pseudo-random columns from md5, equal on any engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from predia import constants as K
from predia.functions.text import col


def seeded_key(key: str | Column, seed: int | str = K.SEED) -> Column:
    return F.md5(F.concat_ws("_", col(key).cast("string"), F.lit(str(seed))))


def seeded_int(key: str | Column, seed: int | str = K.SEED) -> Column:
    """Uniform integer in 0..2^32-1."""
    return F.conv(F.substring(seeded_key(key, seed), 1, 8), 16, 10).cast("bigint")


def seeded_bucket(key: str | Column, buckets: int, seed: int | str = K.SEED) -> Column:
    return F.pmod(seeded_int(key, seed), F.lit(buckets).cast("bigint"))
