"""The stored embedding cache: a table in buckets of the key and folders of the day of creation.

A batch is joined to the cache bucket by bucket: its distinct keys are dealt out as the buckets are, so the stored vectors stay
where they are and only those the batch needs are moved. Expiry drops whole days and reads no file. The table is known to the catalog
of the session by a name; ``open_cache`` makes it or finds what lies at its path.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import hashing
from pressloom.functions.dates import as_of_literal
from pressloom.operators.skew import lookup_join
from pressloom.sources import files
from pressloom.sources.scratch import cut_lineage

#: A choice for the life of a table, as for any bucketed one.
BUCKETS = 32
_DAY = "created_day="


def open_cache(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Make the cache known as ``name`` with its files at ``path``."""
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (cache_key STRING, embedding ARRAY<FLOAT>, created_at TIMESTAMP_NTZ, created_day DATE) "
        f"USING parquet PARTITIONED BY (created_day) CLUSTERED BY (cache_key) SORTED BY (cache_key) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    if files.exists(spark, path):
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")


def buckets_of(spark: SparkSession, name: str) -> int:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Num Buckets'")
    return int(described.first()["data_type"])


def add(rows: DataFrame, name: str) -> None:
    """Append ``cache_key, embedding, created_at``. Rows are dealt out as the buckets are, so a bucket gets a file a day."""
    spark = rows.sparkSession
    dealt = rows.select("cache_key", "embedding", "created_at", F.to_date("created_at").alias("created_day"))
    dealt.repartition(buckets_of(spark, name), "cache_key").write.insertInto(name)


def look_up(keys: DataFrame, name: str, since: Column | None = None) -> DataFrame:
    """``keys`` (distinct ``cache_key`` and more) with ``embedding``, null where the cache has none; ``since``: only
    entries made then or later."""
    spark = keys.sparkSession
    stored = spark.table(name)
    if since is not None:
        stored = stored.where((F.col("created_day") >= F.to_date(since)) & (F.col("created_at") >= since))
    # A key is stored once but where two batches added it at the same time; any of its vectors will do.
    once = stored.groupBy("cache_key").agg(F.first("embedding").alias("embedding"))
    dealt = keys.repartition(buckets_of(spark, name), "cache_key")
    return dealt.join(once.hint("merge"), "cache_key", "left")


def embed(
    items: DataFrame, name: str, embedder: Callable[[Column], Column], model: str, as_of, text: str = "text",
    spread_by: tuple[str, ...] = ("id",), days: int | None = None,
) -> DataFrame:
    """``items`` without ``text``, with ``cache_key``, ``embedding`` and ``from_cache``; what was missing is added to the cache.

    Equal texts are embedded once. ``days``: older entries count as missing. Null texts have no key and no embedding.
    Only keys are dealt out to the buckets; the texts that are missing are then gathered in as many tasks as they need.
    """
    keyed = items.withColumn("cache_key", hashing.cache_key(F.col(text), model))
    some = keyed.where(F.col("cache_key").isNotNull())
    since = None if days is None else as_of_literal(as_of) - F.make_dt_interval(F.lit(days))
    known = cut_lineage(look_up(some.select("cache_key").distinct(), name, since))
    texts = some.groupBy("cache_key").agg(F.first(text).alias(text))
    missing = texts.join(known.where("embedding IS NULL").select("cache_key"), "cache_key", "left_semi")
    fresh = cut_lineage(missing.select(
        "cache_key", embedder(F.col(text)).alias("embedding"), as_of_literal(as_of).alias("created_at")
    ))
    add(fresh, name)
    found = known.where("embedding IS NOT NULL").select("cache_key", "embedding", F.lit(True).alias("from_cache"))
    found = found.unionByName(fresh.select("cache_key", "embedding", F.lit(False).alias("from_cache")))
    return lookup_join(keyed.drop(text), found, ["cache_key"], list(spread_by))


def expire(spark: SparkSession, name: str, path: str, as_of, days: int) -> list[date]:
    """Drop the days that lie wholly before ``as_of`` less ``days``: their entries and their folders. Returns them."""
    limit = spark.range(1).select(F.to_date(as_of_literal(as_of) - F.make_dt_interval(F.lit(days)))).first()[0]
    parts = [r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    stored = [date.fromisoformat(p.removeprefix(_DAY)) for p in parts if p.removeprefix(_DAY)[:1].isdigit()]
    old = sorted(d for d in stored if d + timedelta(days=1) <= limit)
    for d in old:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (created_day = DATE '{d}')")
        files.delete(spark, f"{path}/{_DAY}{d}")
    return old
