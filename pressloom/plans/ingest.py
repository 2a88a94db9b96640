"""From feed entries to stored items: the batch that runs on every poll."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.operators import dedup, filters, registry, stats, validate
from pressloom.operators.skew import first_per
from pressloom.sources import feeds, tables
from pressloom.sources.scratch import cut_lineage

MAX_AGE_DAYS = 7


@dataclass(frozen=True)
class Outcome:
    """What one batch adds to the tables."""

    verdicts: DataFrame
    added: DataFrame
    links: DataFrame
    registry_rows: DataFrame
    counters: DataFrame
    run: DataFrame
    run_sources: DataFrame | None = None


def collect(entries: DataFrame, as_of, max_age_days: int = MAX_AGE_DAYS) -> tuple[DataFrame, DataFrame]:
    """(items of a batch: valid, one per id, young enough; refused items).

    Ids are those of the entries as they came. The age filter comes after the deduplication, so an old first copy hides a younger one.
    """
    good, refused = validate.validate_items(feeds.normalise(entries, as_of))
    unique = dedup.dedup_batch(good)
    return filters.younger_than(unique, as_of, max_age_days), refused


def same_url_in_batch(verdicts: DataFrame) -> DataFrame:
    """Among new items of one url only the first stays new; the others become ``exact_url``.

    The firsts, one per url, are found with a partial aggregate; only items that are not a
    first need a join, and they look up one row per url.
    """
    fresh = verdicts.where("not is_duplicate")
    order = [F.asc("published_at"), F.asc("id")]
    firsts = first_per(fresh.select("url", "published_at", "id"), ["url"], order)
    firsts = firsts.select("url", F.col("id").alias("_first"))
    judged = dedup.lookup_join(verdicts, firsts, ["url"], ["id"])
    later = ~F.col("is_duplicate") & (F.col("id") != F.col("_first"))
    return judged.withColumns({
        "original_id": F.when(later, F.col("_first")).otherwise(F.col("original_id")),
        "similarity_score": F.when(later, 1.0).otherwise(F.col("similarity_score")),
        "match_type": F.when(later, "exact_url").otherwise(F.col("match_type")),
        "is_duplicate": later | F.col("is_duplicate"),
    }).drop("_first")


def ingest(
    batch: DataFrame, stored: DataFrame, cands: DataFrame, run_id: str, as_of,
    failed: DataFrame | None = None, feed_log: DataFrame | None = None,
    threshold: float = dedup.SIMILARITY, gate: str = "after_best", cap: int | None = None,
    collector_type: str = "rss", completed_at=None,
) -> Outcome:
    """Judge a batch (one row per id, with ``embedding``) against stored items; describe what it adds.

    Verdicts are reached on narrow rows and written once to the checkpoint folder, since five
    results read them; the texts move only when the new items are picked out. Nothing is stored
    here; the caller writes the parts.
    """
    narrow = batch.select("id", "url", "published_at", "embedding")
    judged = cut_lineage(dedup.dedup_batch_cascade(narrow, stored, cands, threshold, gate, cap).drop("embedding"))
    verdicts = cut_lineage(same_url_in_batch(judged))
    keys = cut_lineage(tables.new_keys(verdicts.where("not is_duplicate"), stored))
    added = batch.join(keys.select("id"), "id", "left_semi").withColumns({
        "is_duplicate": F.lit(False), "duplicate_of": F.lit(None).cast("string"),
    })
    counters = stats.ingest_counters(verdicts, failed)
    log = stats.feed_stats(feed_log) if feed_log is not None else None
    return Outcome(
        verdicts=verdicts.select("id", *dedup.VERDICT),
        added=added,
        links=tables.link_items(run_id, keys),
        registry_rows=registry.registry_rows(added),
        counters=counters,
        run=tables.run_record(run_id, collector_type, as_of, completed_at or as_of, counters, log),
        run_sources=None if log is None else tables.run_sources(run_id, log, failed),
    )
