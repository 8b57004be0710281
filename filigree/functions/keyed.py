"""Chance that is the same on every run and in every engine: digests of a seed and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, *keys: Column) -> Column:
    """md5 of the seed and the keys, joined by '|'."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def integer(seed: int, *keys: Column) -> Column:
    """The first 32 bits of the digest, as a number."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("long")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1)."""
    return (integer(seed, *keys) + 0.5) / 4294967296.0
