"""The polling loop as Structured Streaming.

Event time is ``published_at``. Watermarks need a zoned type, so streams carry the same
moment as ``event_time`` next to it, whatever the session time zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StructField, StructType

from pressloom.operators import dedup, registry
from pressloom.schemas import REGISTRY_SCHEMA
from pressloom.sources import files, keyindex, tables

# Fixed value: how late an item may be, in step with the age limit of batches.
MAX_AGE = "7 days"


def with_event_time(stream: DataFrame, column: str = "published_at") -> DataFrame:
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column))
    return stream.withColumn("event_time", local.cast("timestamp"))


def unique_items(stream: DataFrame, keys: tuple[str, ...] = ("id",), max_age: str = MAX_AGE) -> DataFrame:
    """First arrival per key; state is dropped after ``max_age``, and later rows with it."""
    return with_event_time(stream).withWatermark("event_time", max_age).dropDuplicatesWithinWatermark(list(keys))


def counts_by_day(stream: DataFrame, by: str = "source", max_age: str = MAX_AGE, column: str = "published_at") -> DataFrame:
    """Items per source and day; a day is given out once the watermark has passed it.

    Rows later than ``max_age`` no longer count.
    """
    timed = with_event_time(stream, column).withWatermark("event_time", max_age)
    counted = timed.groupBy(F.window("event_time", "1 day"), by).agg(F.count(F.lit(1)).alias("n_items"))
    start = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("window.start").cast("timestamp_ntz"))
    return counted.select(F.to_date(start).alias("day"), by, "n_items")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all that has arrived and stop; parquet with exactly-once commits."""
    return (
        stream.writeStream.outputMode(mode).format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def new_in_batch(
    batch: DataFrame, stored: DataFrame, threshold: float = dedup.SIMILARITY, stored_urls: DataFrame | None = None
) -> DataFrame:
    """Rows of a batch that are no duplicates of stored items, by url and, where both sides have an
    ``embedding``, by meaning. The window of candidates ends with the newest item of the batch. Urls are looked
    for in ``stored_urls`` if it is given."""
    urls = stored if stored_urls is None else stored_urls
    if "embedding" not in batch.columns or "embedding" not in stored.columns:
        verdicts = dedup.match_url(batch.select("id", "url", "published_at"), urls)
    else:
        newest = batch.agg(F.max("published_at")).first()[0]
        flagged = stored if "is_duplicate" in stored.columns else stored.withColumn("is_duplicate", F.lit(False))
        cands = dedup.candidates(flagged, newest) if newest else flagged
        narrow = batch.select("id", "url", "published_at", "embedding")
        verdicts = dedup.dedup_batch_cascade(narrow, urls, cands, threshold)
    return batch.join(verdicts.where("is_duplicate").select("id"), "id", "left_anti")


def item_sink(
    items_path: str, registry_path: str, judge: Callable[[DataFrame, DataFrame], DataFrame] = new_in_batch,
    keys_path: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: new items to the item table, their keys to the key index, sightings to the registry log.

    All writes are keyed by the batch number and replace what an interrupted run of the same
    batch left, so a replay changes nothing. Which ids and urls are stored is read from the key index at ``keys_path``
    (beside the items unless it is named), in the buckets of the batch only. ``judge(batch, stored)`` drops duplicates before
    items are stored. Items lie by batch and day, so ``tables.read_items`` reads them and days are pruned.
    """
    keys_path = keys_path or f"{items_path.rstrip('/')}-keys"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"{items_path}/batch_id={batch_id:09d}"
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)  # read by all writes
        try:
            stored = stored_items(spark, items_path, batch.schema, before=batch_id)
            ids, urls = (keyindex.known(batch, keys_path, kind, before=batch_id) for kind in keyindex.KINDS)
            kept = new_in_batch(batch, stored, stored_urls=urls) if judge is new_in_batch else judge(batch, stored)
            if judge is new_in_batch:  # drops all rows of an id or none
                tables.write_dated(tables.new_items_by_day(batch, kept, ids, urls), folder, mode="overwrite")
            else:
                tables.write_items(tables.new_items(kept, ids, urls), folder, mode="overwrite")
            # From the files themselves, so that both tables tell the same.
            keyindex.write_keys(spark.read.schema(batch.schema).parquet(folder), keys_path, batch_id)
            sightings = registry.merge_registry(registry.registry_rows(batch))
            sightings.write.mode("overwrite").parquet(f"{registry_path}/batch_id={batch_id:09d}")
        finally:
            batch.unpersist()

    return write


def stored_items(spark, path: str, schema, before: int | None = None) -> DataFrame:
    """Items of the batches so far; with ``before`` only of earlier batches."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    numbered = StructType([*schema.fields, StructField("batch_id", LongType()), StructField("published_date", DateType())])
    out = spark.read.schema(numbered).parquet(path)
    if before is not None:
        out = out.where(F.col("batch_id") < before)
    return out.drop("batch_id", "published_date")


def registry_now(spark, path: str) -> DataFrame:
    """The registry as the sum of its per-batch sightings; empty as long as no batch has come."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    return registry.merge_registry(spark.read.parquet(path).drop("batch_id"))


def run_item_stream(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
