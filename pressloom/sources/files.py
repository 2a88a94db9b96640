"""Folders of tables, on whatever file system they are."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.sources.scratch import cut_lineage


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path)
    return fs.exists(folder)


def delete(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)


def numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the folders in ``path`` whose names are ``prefix`` and a number."""
    fs, folder = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)]


def days(spark: SparkSession, path: str, column: str) -> list[date]:
    """The days that have a folder of the partition ``column`` in ``path`` or in its folders of batches, newest first.
    Only names are listed."""
    fs, root = _folder(spark, path)
    level = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    batches = [f for f in level if f.getName().startswith("batch_id=")]
    names = {f.getName() for f in level} | {s.getPath().getName() for f in batches for s in fs.listStatus(f)}
    values = [n.removeprefix(f"{column}=") for n in names if n.startswith(f"{column}=")]
    return sorted((date.fromisoformat(v) for v in values if v[:1].isdigit()), reverse=True)


def one_of(keys: list[str], values: list) -> "F.Column":
    """Whether the row is in one of the partitions ``values`` (rows of ``keys``): plain comparisons of partition
    columns, so that other folders are not read."""
    if not values:
        return F.lit(False)
    if len(keys) == 1:
        some = F.col(keys[0]).isin([v[0] for v in values if v[0] is not None])
        return some | F.col(keys[0]).isNull() if any(v[0] is None for v in values) else some
    each = {v[0] for v in values}
    out = F.lit(False)
    for first in each:
        rest = [v[1:] for v in values if v[0] == first]
        out = out | (F.col(keys[0]).eqNullSafe(F.lit(first)) & one_of(keys[1:], rest))
    return out


def partitions(df: DataFrame, keys: list[str]) -> list[tuple]:
    """The distinct keys of ``df``; as many as partitions are touched."""
    return [tuple(r) for r in df.select(*keys).distinct().collect()]


def replace_partitions(made: DataFrame, path: str, keys: list[str], force: bool = True, kept: tuple[str, ...] = ()) -> DataFrame:
    """Write the partitions ``keys`` of ``made`` to the table at ``path``; the files of all others are not touched. Returns what was written.

    Without ``force`` partitions that are stored stay as they are. With it they are replaced, but for the columns ``kept``, which
    keep their stored values (such tables have one row per partition). Only the touched partitions are read. The rows
    are fixed in the checkpoint folder before the table that they may come from is written.
    """
    spark = made.sparkSession
    if exists(spark, path):
        stored = spark.read.schema(made.schema).parquet(path).where(one_of(keys, partitions(made, keys)))
        if not force:
            made = made.join(stored.select(*keys).distinct(), keys, "left_anti")
        elif kept:
            old = stored.select(*keys, F.struct(*kept).alias("_old"))
            held = F.col("_old").isNotNull()
            joined = made.join(old, keys, "left")
            made = joined.withColumns({c: F.when(held, F.col(f"_old.{c}")).otherwise(F.col(c)) for c in kept}).select(*made.columns)
    fixed = cut_lineage(made)
    spread = fixed.hint("rebalance", *keys)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return fixed
