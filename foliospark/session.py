"""Session defaults and the shared-folder checkpoint policy."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go with the tables they stand for.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(
    app: str = "foliospark", cpus: str | int = "*", shared: str | None = None, **conf: str
) -> SparkSession:
    """A session for tests and benches, with ``shared`` as its shared folder; a cluster brings its own."""
    if shared is not None:
        conf = {**conf, "spark.checkpoint.dir": shared}
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a folder of its own, which goes with the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the executors")
    folder = os.path.join(tempfile.gettempdir(), f"foliospark-{spark.sparkContext.applicationId}")
    if not os.path.isdir(folder):
        os.makedirs(folder)
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return folder


# Rows that a task of a large table sorts or groups at once.
TASK_ROWS = 1 << 20


def tasks_for(spark: SparkSession, rows: int) -> int:
    """The session's number of shuffle tasks, or more where each would hold over ``TASK_ROWS`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder (reliable, survives executor loss)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it goes when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table once as compressed Parquet and go on from the files."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
