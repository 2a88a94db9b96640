"""Which ids and urls are stored: narrow rows in buckets of the key, so that a batch reads its own buckets only.

A row says that a key (``id`` or ``url``) belongs to a stored item. Rows lie by batch and bucket, a hash of the
key, in order of kind and key, and their files carry Parquet Bloom filters of the keys. Writing a batch again replaces what it
wrote before. The number of buckets is a choice for the life of an index: more of them read less per batch and make more files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.sources import files
from pressloom.sources.scratch import cut_lineage

BUCKETS = 32
#: Keys that a file is expected to hold; Bloom filters are made for so many. More keys only make them let more through.
KEYS_A_FILE = 20_000
KINDS = ("id", "url")
_SCHEMA = "kind string, key string, item_id string, collected_at timestamp_ntz, batch_id long, bucket int"


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def key_rows(items: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``items`` (``id``, ``url``, and ``collected_at`` if there is one)."""
    at = F.col("collected_at") if "collected_at" in items.columns else F.lit(None).cast("timestamp_ntz")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in KINDS]))
    rows = items.select(F.col("id").alias("item_id"), at.alias("collected_at"), kinds.alias("k"))
    return rows.select("k.kind", "k.key", "item_id", "collected_at", bucket_of(F.col("k.key"), buckets).alias("bucket")).where("key IS NOT NULL")


def _write(rows: DataFrame, folder: str) -> None:
    spread = rows.repartition("bucket").sortWithinPartitions("bucket", "kind", "key")
    options = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": str(KEYS_A_FILE), "partitionOverwriteMode": "static"}
    spread.write.mode("overwrite").options(**options).partitionBy("bucket").parquet(folder)


def write_keys(items: DataFrame, path: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Enter the items of a batch, in place of what the batch entered before."""
    _write(key_rows(items, buckets), f"{path}/batch_id={batch_id}")


def _read(spark: SparkSession, path: str, before: int | None) -> DataFrame:
    if not files.exists(spark, path):
        return spark.createDataFrame([], _SCHEMA)
    rows = spark.read.schema(_SCHEMA).parquet(path)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def known(batch: DataFrame, path: str, kind: str, before: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``id, url, collected_at`` of the entries in the buckets of the batch's keys, the column other than ``kind`` null unless
    it is the id; ``before``: only entries of earlier batches.

    The batch's buckets, no more than ``buckets`` numbers, are found first, so that only their folders are listed and read.
    """
    spark = batch.sparkSession
    wanted = [r[0] for r in batch.where(F.col(kind).isNotNull()).select(bucket_of(F.col(kind), buckets)).distinct().collect()]
    rows = _read(spark, path, before).where((F.col("kind") == kind) & F.col("bucket").isin(wanted))
    url = F.col("key") if kind == "url" else F.lit(None).cast("string")
    return rows.select(F.col("item_id").alias("id"), url.alias("url"), "collected_at")


def compact(spark: SparkSession, path: str, below: int, buckets: int = BUCKETS) -> None:
    """Put the entries of all batches before ``below`` into one folder, one file or so per bucket.

    The new folder is complete before the old ones go; if that is interrupted, entries are there twice, which changes no
    answer. Batches from ``below`` on are left alone. Earlier ones must not be written again afterwards.
    """
    target = -below
    old = [n for n in files.numbers(spark, path, "batch_id=") if n < below and n != target]
    if not old:
        return
    rows = spark.read.schema(_SCHEMA).parquet(path).where(F.col("batch_id").isin([*old, target]))
    merged = rows.groupBy("kind", "bucket", "key", "item_id").agg(F.min("collected_at").alias("collected_at"))
    _write(cut_lineage(merged), f"{path}/batch_id={target}")
    for n in old:
        files.delete(spark, f"{path}/batch_id={n}")
