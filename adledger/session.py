"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a generated method over 8000 bytes is never compiled by the JVM's JIT; such a
    # stage runs faster as separate operators, whose code is split into small methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # a task that writes a few folders keeps a file open in each instead of sorting its rows by folder
    "spark.sql.maxConcurrentOutputFileWriters": "16",
    # the files of a shuffle go when the execution that wrote them ends, not when the driver collects its garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # call-site capture makes building a wide plan several times slower
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def tune(spark: SparkSession) -> None:
    """The settings a running session can still take."""
    for name in ("spark.sql.codegen.hugeMethodLimit", "spark.sql.maxConcurrentOutputFileWriters",
                 "spark.sql.classic.shuffleDependency.fileCleanup.enabled"):
        spark.conf.set(name, SETTINGS[name])


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session without the setting uses a temporary folder, one per session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_dir(spark.sparkContext.applicationId)


@functools.cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's files under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

