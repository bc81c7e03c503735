"""Exact top-k per key, safe when one key holds a large share of the rows.

Level 1 ranks inside (key, salt) sub-groups, where the salt is a hash of the
row, so a hot key is split over ``salt_buckets`` tasks; Spark's window group
limit keeps only k rows per sub-group on the map side. Level 2 ranks the at
most k * salt_buckets survivors of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT_BUCKETS = 64


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int,
          salt: Column | None = None, salt_buckets: int = SALT_BUCKETS,
          rank_col: str = "rank") -> DataFrame:
    """Rows with rank (1-based, by ``order``) <= k within each key; adds ``rank_col``."""
    if salt_buckets and salt_buckets > 1:
        s = salt if salt is not None else F.xxhash64(*order)
        df = df.withColumn("_salt", F.pmod(s, F.lit(salt_buckets)))
        w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
        df = df.drop("_salt", "_r1")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
