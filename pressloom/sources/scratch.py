"""Shared scratch space and lineage cuts that survive the loss of executors.

Results that several steps read are written below the shared folder. A job run inside ``temporary`` removes
what it wrote there when it ends; otherwise the folder is as temporary as the checkpoints beside it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster. A temporary one only in local mode, where all tasks run in one
    process on one machine; on a cluster each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext._jsc.sc()
    current = context.getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pressloom-"))
    return context.getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared root."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


# Paths given out inside each open ``temporary``.
_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are removed at the end: write or collect all results before it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the shared root and read it from there on.

    A table, unlike a checkpointed RDD, keeps column pruning and tells the planner its size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
