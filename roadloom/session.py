"""Session factory with the settings the engine expects."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster leave ``master`` to spark-submit."""
    b = SparkSession.builder.appName("roadloom")
    if master:
        b = b.master(master)
        b = b.config("spark.sql.shuffle.partitions", str(partitions or os.cpu_count() or 8))
    elif partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # else each column expression makes several calls to the JVM to note its place in the source
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for k, v in (settings | more).items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or a temporary one of a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="roadloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, for plans that read it in several branches."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)
