"""Session construction and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "strandweave", cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see: spark.checkpoint.dir of the session.

    Only where the setting is absent and the master is local (tests, notebooks
    on one machine) a temporary folder is chosen and recorded in the session.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = os.path.join(tempfile.gettempdir(), "strandweave-checkpoints")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let the session hand texts to Python in batches of at most ``most`` bytes (if its own limit is higher)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower()
    size = int(now.rstrip("bkmg")) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("b")[-1:], 1)
    if size > most:
        spark.conf.set(key, str(most))


class Scratch:
    """Named Parquet tables below the shared folder; writing one cuts lineage.

    A table is complete once its write has committed, so a lost executor costs
    at most the tasks that had not committed yet.  With ``merge`` its tables
    are joined by sorting: a table of many rows that compresses well looks
    small to the optimiser, and would be broadcast through the driver.
    """

    def __init__(self, spark: SparkSession, label: str, merge: bool = False):
        self.spark, self.merge = spark, merge
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        return saved.hint("merge") if self.merge else saved

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
