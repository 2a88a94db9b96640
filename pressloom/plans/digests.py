"""Daily digests and weekly summaries of many periods in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions.dates import as_of_literal
from pressloom.functions.scoring import Weights
from pressloom.functions.text import preview
from pressloom.operators import ranking, stats
from pressloom.operators.filters import in_period
from pressloom.plans import render
from pressloom.sources import files
from pressloom.sources.scratch import cut_lineage

# Fixed value: topics listed in a weekly summary.
WEEKLY_TOPICS = 10


@dataclass(frozen=True)
class Digests:
    """Digest rows and the entries that link them to items."""

    records: DataFrame
    entries: DataFrame


def originals(items: DataFrame) -> DataFrame:
    return items.where(~F.col("is_duplicate"))


def _ranked(items: DataFrame, kind: str, first, last, weights: Weights, limits: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items of all periods, their counts per source, ranked narrow rows)."""
    pool = in_period(originals(items), kind, first, last)
    counts = cut_lineage(ranking.source_counts(pool))
    return pool, counts, ranking.rank_items(pool, kind, weights=weights, counts=counts, **limits)


def _wide(ranked: DataFrame, pool: DataFrame) -> DataFrame:
    """Texts for the ranked rows, fetched in one scan of their periods and fixed for the two renderings.

    The rows are already fixed, so their number is checked, not guessed.
    """
    shown = pool.withColumn("preview", preview(F.col("content"), 200))
    columns = ["title", "url", "summary", "preview"]
    return cut_lineage(ranking.attach_columns(ranked, shown, columns, row_bound=ranked.count()))


_TEXTS = ("content_markdown", "content_html")


def _new_record(facts: DataFrame, pool: DataFrame, ranked: DataFrame, write: Callable, as_of, texts: bool) -> DataFrame:
    """Facts of the periods as records, with their rendered texts if asked for."""
    made = facts
    if texts:
        wide = _wide(ranked, pool)
        for name, html in zip(_TEXTS, (False, True)):
            made = made.join(write(wide, facts, html=html).withColumnRenamed("content", name), "period")
    return made.withColumns({
        "is_sent": F.lit(False),
        "sent_at": F.lit(None).cast("timestamp_ntz"),
        "created_at": as_of_literal(as_of),
    })


def daily_digests(items: DataFrame, as_of, first=None, last=None, weights: Weights = Weights(), texts: bool = True, **limits) -> Digests:
    """One digest per day that has items. ``first`` and ``last`` bound the days.

    Without ``texts`` no item text is read and the records have no rendered columns.
    """
    pool, counts, best = _ranked(items, "daily", first, last, weights, limits)
    ranked = cut_lineage(ranking.with_category(best))
    totals = stats.period_facts(counts).drop("sources_count")
    facts = cut_lineage(stats.digest_facts(ranked).join(totals, "period"))
    records = _new_record(facts, pool, ranked, render.render_daily, as_of, texts)
    return Digests(
        records.select(F.col("period").alias("digest_date"), "item_count", "total_collected", "sources",
                       "categories", *(_TEXTS if texts else ()), "is_sent", "sent_at", "created_at"),
        ranking.digest_entries(ranked, "daily"),
    )


def weekly_facts(pool: DataFrame, counts: DataFrame, ranked: DataFrame, topics: int = WEEKLY_TOPICS) -> DataFrame:
    """Per week: selected and collected items, sources, and the top topics over all its items."""
    selected = ranked.groupBy("period").agg(F.count(F.lit(1)).alias("item_count"))
    best = stats.top_topics(pool, topics, by="period")
    inorder = F.array_sort(F.collect_list(F.struct("topic_rank", "topic", "n_items")))
    listed = best.groupBy("period").agg(inorder.alias("topics"))
    none = F.array().cast("array<struct<topic_rank:int,topic:string,n_items:bigint>>")
    return (
        selected.join(stats.period_facts(counts), "period")
        .join(listed, "period", "left")
        .withColumn("topics", F.coalesce("topics", none))
    )


def weekly_summaries(items: DataFrame, as_of, first=None, last=None, weights: Weights = Weights(), texts: bool = True, **limits) -> Digests:
    """One summary per week that has items; ``period`` is its Monday. ``texts`` as in ``daily_digests``."""
    pool, counts, best = _ranked(items, "weekly", first, last, weights, limits)
    ranked = cut_lineage(ranking.with_day(best))
    facts = cut_lineage(weekly_facts(pool, counts, ranked))
    records = _new_record(facts, pool, ranked, render.render_weekly, as_of, texts)
    return Digests(
        records.select(
            F.col("period").alias("week_start"), F.date_add("period", 7).alias("week_end"),
            "item_count", "total_collected", "sources_count",
            F.transform("topics", lambda t: t["topic"]).alias("top_topics"),
            *(_TEXTS if texts else ()), "is_sent", "sent_at", "created_at",
        ),
        ranking.digest_entries(ranked, "weekly"),
    )


# What a regenerated digest keeps from the stored one.
_KEPT = ("is_sent", "sent_at", "created_at")


def merge_digests(stored: DataFrame, made: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Stored and new digests by period.

    A stored period stays as it is; with ``force`` its content is replaced and only the sent
    mark and the creation time stay.
    """
    old, new = stored.alias("old"), made.alias("new")
    both = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    was, now = F.col(f"old.{key}").isNotNull(), F.col(f"new.{key}").isNotNull()

    def pick(c: str):
        keep_old = was if not force or c in _KEPT else was & ~now
        return F.when(keep_old, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c)

    return both.select(*[pick(c) for c in stored.columns])


def merge_entries(stored: DataFrame, made: DataFrame, force: bool = False) -> DataFrame:
    """Entries that go with ``merge_digests``: those of a replaced period are replaced too."""
    key = ["digest_kind", "period_start"]
    if force:
        return stored.join(made.select(*key).distinct(), key, "left_anti").unionByName(made)
    return stored.unionByName(made.join(stored.select(*key).distinct(), key, "left_anti"))


def store_digests(made: Digests, root: str, kind: str, force: bool = False) -> DataFrame:
    """Write digests of ``kind`` (daily, weekly) and their entries to the tables below ``root``, period by period: the files of
    periods that ``made`` does not have are neither read nor written. Same outcome as ``merge_digests`` and ``merge_entries``.
    Returns the records that were written."""
    key = "digest_date" if kind == "daily" else "week_start"
    written = files.replace_partitions(made.records, f"{root}/{kind}", [key], force, _KEPT)
    entries = made.entries.join(written.select(F.col(key).alias("period_start")), "period_start", "left_semi")
    files.replace_partitions(entries.select(*made.entries.columns), f"{root}/entries", ["digest_kind", "period_start"])
    return written


def mark_sent(digests: DataFrame, sent: DataFrame, key: str, as_of) -> DataFrame:
    """Digests whose ``key`` is in ``sent`` marked as sent at ``as_of``."""
    marks = sent.select(key).distinct().withColumn("_now", F.lit(True))
    hit = F.col("_now").isNotNull()
    return (
        digests.join(marks, key, "left")
        .withColumn("sent_at", F.when(hit, as_of_literal(as_of)).otherwise(F.col("sent_at")))
        .withColumn("is_sent", hit | F.col("is_sent"))
        .select(*digests.columns)
    )
