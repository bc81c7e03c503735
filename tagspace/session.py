"""Spark session helpers.

The library never creates folders of its own on a cluster: checkpoints go to the
shared folder named by ``spark.checkpoint.dir``. Only in local mode, and only when that
setting is absent, a scratch folder is made; on a cluster its absence is an error.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", app: str = "tagspace") -> SparkSession:
    """Session for local runs and tests (the cluster supplies its own)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory)
               .config("spark.sql.files.maxPartitionBytes", "16m")
               .config("spark.sql.files.openCostInBytes", "1m"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder; make a scratch one only where none is set."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # no SparkContext (remote session): the server's setting applies
        return conf_dir or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="tagspace-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Frames that a job writes for its own later steps: compressed Parquet in a folder of its own
    under the checkpoint folder, a fraction of a checkpoint's size, gone when the job says so.

    After each write the shuffles behind it are let go, so that the disk holds those of one step.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tagspace-steps/{uuid.uuid4().hex}"
        self._kept = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written once; what is returned reads the files."""
        path, self._kept = f"{self.path}/{self._kept}", self._kept + 1
        df.write.option("compression", "zstd").parquet(path)
        release_shuffles(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Removes the files; frames that read them end here."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()


def release_shuffles(spark: SparkSession) -> None:
    """Spark removes the files of a shuffle once the driver has collected its plan: collected now,
    not when the driver's memory happens to fill."""
    gc.collect()  # plans that Python still holds
    spark.sparkContext._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application, so that Python
    functions in tasks can be loaded from any working directory."""
    sc = spark.sparkContext
    if getattr(sc, "_tagspace_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tagspace-zip-"), "tagspace.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._tagspace_shipped = True
