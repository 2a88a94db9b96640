"""The registry of what was seen, and the embedding cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import hashing
from pressloom.functions.dates import as_of_literal
from pressloom.operators.dedup import with_dedup_hashes
from pressloom.operators.skew import lookup_join
from pressloom.sources.scratch import cut_lineage

KEEP_DAYS = 30


def registry_rows(items: DataFrame, seen_at: Column | str = "collected_at") -> DataFrame:
    """Items as single sightings."""
    seen = F.col(seen_at) if isinstance(seen_at, str) else seen_at
    return with_dedup_hashes(items).select(
        "url_hash", "title_hash", "content_hash", F.col("id").alias("news_item_id"),
        seen.alias("first_seen_at"), seen.alias("last_seen_at"), F.lit(1).cast("long").alias("occurrence_count"),
    )


def merge_registry(*parts: DataFrame) -> DataFrame:
    """One row per url hash: first and last sighting, number of sightings, fields of the first.

    A pure aggregate, so partial results of hot urls are combined before the shuffle, and
    parts may be merged in any grouping.
    """
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    earliest = F.min(F.struct("first_seen_at", "news_item_id", "title_hash", "content_hash")).alias("_f")
    return rows.groupBy("url_hash").agg(
        earliest, F.max("last_seen_at").alias("last_seen_at"), F.sum("occurrence_count").alias("occurrence_count")
    ).select(
        "url_hash", "_f.title_hash", "_f.content_hash", "_f.news_item_id", "_f.first_seen_at",
        "last_seen_at", "occurrence_count",
    )


def upsert_registry(registry: DataFrame, batch: DataFrame, seen_at: Column | str = "collected_at") -> DataFrame:
    """The registry after a batch of items: known urls are counted on, new ones added."""
    return merge_registry(registry, registry_rows(batch, seen_at))


def _cutoff(as_of, days: int) -> Column:
    return as_of_literal(as_of) - F.make_dt_interval(F.lit(days))


def expire_registry(registry: DataFrame, as_of, days: int = KEEP_DAYS) -> DataFrame:
    return registry.where(F.col("last_seen_at") >= _cutoff(as_of, days))


def expired_count(table: DataFrame, as_of, days: int, seen: str = "last_seen_at") -> DataFrame:
    """How many rows a clean-up removes and how many it keeps."""
    old = F.col(seen) < _cutoff(as_of, days)
    return table.agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("kept"))


def expire_cache(cache: DataFrame, as_of, days: int) -> DataFrame:
    return cache.where(F.col("created_at") >= _cutoff(as_of, days))


def embed_with_cache(
    items: DataFrame, cache: DataFrame, embed: Callable[[Column], Column], model: str, as_of, text: str = "text",
    spread_by: tuple[str, ...] = ("id",),
) -> tuple[DataFrame, DataFrame]:
    """(items with ``embedding`` and ``from_cache``, without their text; cache rows to add).

    Equal texts are embedded once; ``spread_by`` tells items of one text apart. ``embed`` is an Arrow function from text to array<float>.
    """
    keyed = items.withColumn("cache_key", hashing.cache_key(F.col(text), model))
    distinct = keyed.groupBy("cache_key").agg(F.first(text).alias(text))
    missing = distinct.join(cache.select("cache_key"), "cache_key", "left_anti")
    # Both results read the new vectors, so they are made once and written.
    fresh = cut_lineage(missing.select(
        "cache_key", embed(F.col(text)).alias("embedding"), as_of_literal(as_of).alias("created_at")
    ))
    known = cache.select("cache_key", "embedding", F.lit(True).alias("from_cache")).unionByName(
        fresh.select("cache_key", "embedding", F.lit(False).alias("from_cache"))
    )
    return lookup_join(keyed.drop(text), known, ["cache_key"], list(spread_by)), fresh
