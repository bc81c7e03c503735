"""Deterministic md5 hashing used for every random choice.

A row's draw depends only on its key and the seed, never on partitioning, so a
re-run, a re-partitioned run and the DuckDB oracle all agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296  # 2**32


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def hash_key(*parts) -> Column:
    """String key ``p1:p2:...`` of the parts (columns or literals)."""
    return F.concat_ws(":", *[_as_col(p).cast("string") for p in parts])


def hash32(*parts) -> Column:
    """First 32 bits of md5 of ``p1:p2:...`` as a bigint in [0, 2**32)."""
    return F.conv(F.substring(F.md5(hash_key(*parts)), 1, 8), 16, 10).cast("bigint")


def hash_hex(*parts) -> Column:
    """Full md5 hex of ``p1:p2:...``; a total order for sampling ties."""
    return F.md5(hash_key(*parts))


def unit_draw(*parts) -> Column:
    """Uniform draw in [0, 1) from the key."""
    return hash32(*parts) / F.lit(float(TWO32))


def keep_fraction(fraction: float, *parts) -> Column:
    """Bernoulli(fraction) keep flag; nested in fraction for a fixed key."""
    return hash32(*parts) < F.lit(float(fraction) * TWO32)
