"""Run configurations (X2's grid), their markers (P11) and the model name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspace.functions.text import config_marker

# --- fixed values: the robustness grid of the reference's documentation -----------
GRID_SEEDS = [0, 6, 12, 24, 42]
GRID_FRACTIONS = [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]
GRID_TIME_RANGES = [(1, 9), (3, 9), (6, 9)]
GRID_SINGLE_MONTHS = [1, 2, 3, 4, 5, 6, 7, 8, 9]
GRID_ELECTION_MODES = ["elected", "incumbent", "reelected", "newly_elected", "not_reelected"]
# ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    mode: str = "full"
    seed: int = 0
    fraction: float = 1.0
    month_start: int = 1
    month_end: int = 12


def readme_grid(content: bool = True) -> list[Config]:
    """full; random seeds × fractions; time ranges and single months; election modes."""
    g = [Config("full")]
    g += [Config("random", seed=s, fraction=f) for s in GRID_SEEDS for f in GRID_FRACTIONS]
    g += [Config("time", month_start=a, month_end=b) for a, b in GRID_TIME_RANGES]
    g += [Config("time", month_start=m, month_end=m) for m in GRID_SINGLE_MONTHS]
    g += [Config(m) for m in GRID_ELECTION_MODES]
    if content:
        g.append(Config("content"))
    return g


def config_table(spark: SparkSession, configs: list[Config]) -> DataFrame:
    """(config, mode, seed, fraction, month_start, month_end, marker) — a parameter table.

    Built from literals in the JVM (no Python worker is started for it).
    """
    rows = [F.struct(F.lit(i).alias("config"), F.lit(c.mode).alias("mode"),
                     F.lit(int(c.seed)).alias("seed"), F.lit(float(c.fraction)).alias("fraction"),
                     F.lit(int(c.month_start)).alias("month_start"),
                     F.lit(int(c.month_end)).alias("month_end"))
            for i, c in enumerate(configs)]
    df = spark.range(1).select(F.inline(F.array(*rows)))
    return df.withColumn("marker", config_marker(F.col("mode"), F.col("seed"), F.col("fraction"),
                                                 F.col("month_start"), F.col("month_end")))
