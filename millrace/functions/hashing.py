"""Seeded, portable pseudo-randomness: md5 of the seed and the row's key.

Equal on every engine and independent of partitioning and retries, which ``rand`` is not.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_md5(seed: int | str, *keys: Column | str) -> Column:
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def seeded_int(seed: int | str, *keys: Column | str, digits: int = 8) -> Column:
    """The first ``digits`` hex digits of the seeded md5 as bigint (at most 15)."""
    return F.conv(F.substring(seeded_md5(seed, *keys), 1, digits), 16, 10).cast("bigint")


def seeded_unit(seed: int | str, *keys: Column | str) -> Column:
    """Uniform in [0, 1)."""
    return seeded_int(seed, *keys) / F.lit(float(2**32))
