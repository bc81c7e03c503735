"""Sinks (S6-S9): one partitioned writer per kind of output.

Output folders are passed in; jobs that need scratch space use a folder under
the cluster's shared checkpoint directory, never a machine-local one.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspace.session import ensure_checkpoint_dir


FILE_PAIRS = 1 << 20  # pairs of a file


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tagspace-out/{name}-{uuid.uuid4().hex[:12]}"


def safe_name(model: str) -> str:
    """Model names may hold '/', which would make a nested folder."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", model)


def write_pairs(train: DataFrame, val: DataFrame, out: str, year, suffix: str | None = None,
                quote_all: bool = False, compression: str = "gzip") -> str:
    """CSV pairs (sent1, sent2, label), partitioned by year and split; only the written
    partitions are replaced, other years stay."""
    both = (train.select("sent1", "sent2", "label").withColumn("split", F.lit("train"))
            .unionByName(val.select("sent1", "sent2", "label").withColumn("split", F.lit("val"))))
    return write_split(both, out, year, suffix, quote_all, compression)


def write_split(pairs: DataFrame, out: str, year, suffix: str | None = None, quote_all: bool = False,
                compression: str = "gzip") -> str:
    """S6 of one frame with a ``split`` column, so that what makes the pairs runs once. A compressed
    file is read by one task, so that it has ``FILE_PAIRS`` pairs at most."""
    tag = f"{year}" if not suffix else f"{year}_{suffix}"
    df = pairs.select("sent1", "sent2", "label", "split").withColumn("year", F.lit(tag))
    conf, writers = pairs.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(writers, "0")
    conf.set(writers, "2")  # a file for each split: no sort of all pairs by split, which spills
    try:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("year", "split").option("header", True).option("compression", compression)
         .option("maxRecordsPerFile", FILE_PAIRS).option("quoteAll", quote_all).option("escape", '"').csv(out))
    finally:
        conf.set(writers, before)
    return out


def write_embeddings(emb: DataFrame, out: str, model: str, year) -> str:
    """Parquet partitioned by model and year; a repeated run replaces its own partition."""
    (emb.withColumn("model", F.lit(safe_name(model))).withColumn("year", F.lit(int(year)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("model", "year").parquet(out))
    return out


def write_filtered(emb: DataFrame, out: str, mode: str, config: str) -> str:
    """Filtered embeddings partitioned by mode and configuration marker; a repeated run
    replaces its own partition."""
    (emb.withColumn("mode", F.lit(mode)).withColumn("config", F.lit(config))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("mode", "config").parquet(out))
    return out


def commit_results(results: DataFrame, out: str, run: str) -> str:
    """The result rows of one run, in place of those that it left before.

    Rows are staged in a folder of their own; a line (run, folder, number) in the list of
    commits, one file that appears whole or not at all, makes them count. A job that ends before
    that line leaves nothing that ``read_results`` reads; a repeated run has one more line,
    and the last one counts.
    """
    spark = results.sparkSession
    folder = f"{safe_name(run)}-{uuid.uuid4().hex}"
    results.write.parquet(f"{out}/data/{folder}")
    before = _commits(spark, out).where(F.col("run") == run).agg(F.max("number")).first()[0] if _has_commits(spark, out) else None
    line = spark.createDataFrame([(run, folder, (before or 0) + 1)], "run string, folder string, number long")
    line.coalesce(1).write.mode("append").parquet(f"{out}/commits")
    return out


def read_results(spark: SparkSession, out: str) -> DataFrame:
    """The committed rows of every run (its last commit)."""
    last = _commits(spark, out).groupBy("run").agg(F.max_by("folder", F.struct("number", "folder")).alias("folder"))
    folders = sorted(r["folder"] for r in last.collect())  # one per run
    return spark.read.parquet(*[f"{out}/data/{f}" for f in folders])


def _commits(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("run string, folder string, number long").parquet(f"{out}/commits")


def _has_commits(spark: SparkSession, out: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/commits")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def write_evaluation(result: DataFrame, out: str, model: str, split: str) -> str:
    """X6's result rows by model and split; a repeated evaluation replaces its own."""
    (result.withColumn("model", F.lit(safe_name(model))).withColumn("split", F.lit(split))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "split").parquet(out))
    return out


def write_results(results: DataFrame, out: str, fmt: str = "parquet") -> str:
    """Plain append of result rows; ``commit_results`` keeps each run's rows once."""
    w = results.write.mode("append")
    if fmt == "csv":
        w.option("header", True).option("quoteAll", True).csv(out)
    else:
        w.parquet(out)
    return out
