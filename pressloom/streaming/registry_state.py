"""The registry of what was seen as keyed state of a stream.

Every url hash has an entry: first and last sighting, number of sightings, fields of the first. Entries lie in ``BUCKETS`` state rows
by a hash of the url hash, since a call of Python for every key costs a thousand times what the key itself does. An event-time timer
of a row drops entries whose last sighting lies further back than ``days`` before the newest one, so state is bounded by the live keys
and no log of sightings is summed up. The state itself is the registry: ``live_registry`` reads it from the checkpoint.

A micro-batch first forgets what is expired by the watermark known at its start, then counts its sightings; sightings that are
older than the watermark are dropped. It reads and writes the rows that its keys fall into. Only the sightings of one micro-batch
meet per row, in Arrow batches. An entry of the very millisecond of the watermark may stay until that has moved by two.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pressloom.operators import registry
from pressloom.streaming.feeds import with_event_time

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A choice for the life of a checkpoint: more rows are narrower and take more calls when all of them are met.
BUCKETS = 4_096
_ENTRY = "url_hash string, first_us long, last_us long, occurrence_count long, news_item_id string, title_hash string, content_hash string"
_CHANGE = f"{_ENTRY}, removed boolean"
_NAMES = [c.split()[0] for c in _CHANGE.split(", ")]
# The entries of a row, column by column.
_STATE = ", ".join("{} array<{}>".format(*c.split()) for c in _ENTRY.split(", "))


def _order(seen: int, fields) -> tuple:
    """Earlier sightings first, then by their fields, nulls first."""
    return (seen, *[(f is not None, f or "") for f in fields])


def _sightings(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    mark = state.getCurrentWatermarkMs()
    entries = {url: rest for url, *rest in zip(*state.get)} if state.exists else {}
    live = {url: entry for url, entry in entries.items() if entry[1] >= mark * 1000}
    seen = set()
    for frame in () if state.hasTimedOut else frames:
        for url, at, *fields in zip(*(frame[c].tolist() for c in ("url_hash", "seen_us", "news_item_id", "title_hash", "content_hash"))):
            first, last, count, *known = live.get(url, (at, at, 0, *fields))
            if _order(at, fields) < _order(first, known):
                first, known = at, fields
            live[url] = [first, max(last, at), count + 1, *known]
            seen.add(url)
    if live:
        state.update(tuple(map(list, zip(*((url, *entry) for url, entry in live.items())))))
        state.setTimeoutTimestamp(max(min(entry[1] for entry in live.values()) // 1000, mark + 1))
    else:
        state.remove()
    changes = [(url, *live[url], False) for url in seen] + [(url, *entry, True) for url, entry in entries.items() if url not in live]
    yield pd.DataFrame(changes, columns=_NAMES)


def registry_changes(items: DataFrame, days: int = registry.KEEP_DAYS) -> DataFrame:
    """The stream of registry rows that a stream of items changes, and with ``removed`` those that expire.

    ``items`` as for ``registry.registry_rows``; all rows need ``collected_at``. Items without it are left out.
    """
    sightings = registry.registry_rows(items).select("url_hash", "news_item_id", "title_hash", "content_hash", "first_seen_at")
    timed = with_event_time(sightings.where("first_seen_at IS NOT NULL"), "first_seen_at").withWatermark("event_time", f"{days} days")
    rows = timed.withColumn("seen_us", F.unix_micros("event_time")).drop("first_seen_at")
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("url_hash"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").applyInPandasWithState(_sightings, _CHANGE, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def keep_registry(items: DataFrame, checkpoint: str, days: int = registry.KEEP_DAYS, sink=None) -> StreamingQuery:
    """Bring the registry at ``checkpoint`` up to date with all that has arrived. ``sink(changes, batch_id)`` may take the changes."""
    spark = items.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)  # keyed state with timers needs it; a query keeps what holds at its start
    try:
        changes = registry_changes(items, days).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        written = changes.foreachBatch(sink) if sink else changes.format("noop")
        return written.trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def live_registry(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The registry as the state of the last finished micro-batch, one row per live key."""
    state = spark.read.format("statestore").option("path", checkpoint).load()
    entry = F.arrays_zip(*[F.col(f"value.groupState.{c}") for c in _NAMES[:-1]])
    state = state.select(F.explode(entry).alias("entry"))
    moment = lambda c: F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), F.timestamp_micros(c).cast("timestamp_ntz")
    )
    return state.select(
        "entry.url_hash", "entry.title_hash", "entry.content_hash", "entry.news_item_id",
        moment(F.col("entry.first_us")).alias("first_seen_at"), moment(F.col("entry.last_us")).alias("last_seen_at"),
        "entry.occurrence_count",
    )
