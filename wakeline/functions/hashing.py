"""Stable pseudo-random numbers from SHA-256, equal in every engine and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_unit(key: Column, seed: int) -> Column:
    """A number in [0, 1): the first 8 digest bytes of ``seed:key`` as a fraction."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def stable_seed(key: Column, base: int) -> Column:
    """32 bits: the first 4 digest bytes of ``base:key``, big-endian."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(base)), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
