"""Session settings every job of this package relies on."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

SETTINGS = {
    # Instants are compared and printed in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile longer methods; shorter ones, one per operator, it does.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that can be set on a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, if it names one."""
    return spark.conf.get(CHECKPOINT_KEY, None)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder every executor can reach, removed when the driver ends; a local one only where executors are local too."""
    base = checkpoint_dir(spark)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a shared folder")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4()}"
    atexit.register(_try_remove, spark, path)
    return path


def _try_remove(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have ended before
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_scopes = threading.local()


@contextmanager
def releasing():
    """Remove, at the end of the block, what `cut` wrote inside it."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for spark, path in stack.pop():
            remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Keep a result that several jobs read: write it to the shared folder and read it back.

    The rows survive the loss of the executors that computed them, and take
    no executor memory.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "cut")
    df.write.parquet(path)
    stack = getattr(_scopes, "stack", None)
    if stack:
        stack[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
