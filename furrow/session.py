"""Sessions and the shared scratch folder.

Iterative operators cut their lineage by writing a table to the folder that
``spark.checkpoint.dir`` names.  It is shared by all executors, so a lost
executor loses nothing; only where the setting is missing (tests, a laptop) is
a folder of this machine used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "furrow", cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; set to a temporary one only where the cluster names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            warnings.warn("spark.checkpoint.dir is not set: a folder of this machine is used, which executors elsewhere cannot read", stacklevel=3)
        found = tempfile.mkdtemp(prefix="furrow-scratch-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


class Scratch:
    """Written tables of one operator run.

    ``save`` writes and reads a DataFrame back, so later stages (and retries
    after a lost executor) start from files.  ``drop`` deletes a table nothing
    reads any more.  What is left when the session ends is deleted then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/furrow-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(self._local_cleanup)

    def save(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{len(self.paths):04d}-{uuid.uuid4().hex[:8]}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            _, path = self.paths.get(id(df), (None, None))
            if path:
                self._delete(path)

    def release(self) -> None:
        """Let the context cleaner free shuffle files that no live plan refers to.

        It frees what the JVM has collected, so long iterations ask for that;
        only the driver pauses.
        """
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _local_cleanup(self) -> None:
        root = self.root[5:] if self.root.startswith("file:") else self.root
        if os.path.isdir(root):
            shutil.rmtree(root, ignore_errors=True)
