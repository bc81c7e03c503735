"""Average ranks over a whole column, from counts of its distinct values.

Rows are reduced to counts per (keys, value) first, so a value that most rows share is one
row. The distinct values are range partitioned, ranked inside each partition, and a small
table of partition offsets (one row per partition and key) makes the ranks global.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagspace.session import cut_lineage


def count_ranks(counts: DataFrame, value: str, out: str, keys: tuple[str, ...] = (),
                partitions: int | None = None) -> DataFrame:
    """Adds ``out``: the 1-based average rank of ``value`` among all rows of its keys, where
    each row of ``counts`` stands for ``c`` rows (several rows may share a value)."""
    spark = counts.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    r = cut_lineage(counts.repartitionByRange(partitions, *keys, value)
                    .withColumn("_pid", F.spark_partition_id()))
    per = r.groupBy("_pid", *keys).agg(F.sum("c").alias("_c"))
    # one row per partition and key: bounded by the number of partitions
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_pid", *keys, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    upto = Window.partitionBy("_pid", *keys).orderBy(value)  # range frame: ties included
    ties = F.sum("c").over(Window.partitionBy("_pid", *keys, value))
    r = r.withColumn("_up", F.sum("c").over(upto)).withColumn("_t", ties)
    return (r.join(F.broadcast(offsets), ["_pid", *keys])
            .withColumn(out, F.col("_off") + F.col("_up") - F.col("_t") + (F.col("_t") + 1) / 2.0)
            .drop("_pid", "_off", "_up", "_t"))


def pearson(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = (),
            weight: str | None = None) -> DataFrame:
    """Pearson's r from sums (a NULL r when a side is constant); ``weight``: rows per row."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    x, y = F.col(x), F.col(y)
    agg = df.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
        F.sum(w * x * y).alias("sxy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"))
    num = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    den = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") ** 2)
                 * (F.col("n") * F.col("syy") - F.col("sy") ** 2))
    return agg.select(*keys, F.try_divide(num, den).alias("r"))
