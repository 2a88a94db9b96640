"""Operational and editorial roll-ups. All are aggregates with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions.dates import as_of_literal, day_of, seconds_between, week_of
from pressloom.operators import filters

# Success rates from which a feed counts as healthy or degraded.
HEALTHY = 0.9
DEGRADED = 0.7


def count_by_source(items: DataFrame, start=None) -> DataFrame:
    """Original items per source, optionally only those collected since ``start``."""
    kept = items.where(~F.col("is_duplicate"))
    if start is not None:
        kept = kept.where(F.col("collected_at") >= as_of_literal(start))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n_items"))


def topic_counts(items: DataFrame, *by: str) -> DataFrame:
    """Items per tag, optionally per further columns such as ``period``."""
    return items.select(*by, F.explode("tags").alias("topic")).groupBy(*by, "topic").agg(
        F.count(F.lit(1)).alias("n_items")
    )


def top_topics(items: DataFrame, limit: int = 5, by: str | None = None) -> DataFrame:
    """The most frequent tags, overall or per group, most frequent first, then by name."""
    if by is None:
        return topic_counts(items).orderBy(F.desc("n_items"), "topic").limit(limit)
    return best_topics(topic_counts(items, by), limit, by)


def best_topics(counted: DataFrame, limit: int, by: str) -> DataFrame:
    """The first ``limit`` of counted topics (``topic, n_items``) per group, with ``topic_rank``."""
    w = Window.partitionBy(by).orderBy(F.desc("n_items"), F.asc("topic"))
    return counted.withColumn("topic_rank", F.row_number().over(w)).where(F.col("topic_rank") <= limit)


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _health(rate: Column) -> Column:
    return F.when(rate >= HEALTHY, "healthy").when(rate >= DEGRADED, "degraded").otherwise("unhealthy")


def run_stats(runs: DataFrame, as_of, days: int = 7, types: DataFrame | None = None) -> DataFrame:
    """Per collector type over the last ``days``.

    ``types(collector_type)`` adds zero rows for types without runs.
    """
    since = as_of_literal(as_of) - F.make_dt_interval(F.lit(days))
    done = F.col("completed_at").isNotNull()
    took = seconds_between(F.col("completed_at"), F.col("started_at"))
    stats = runs.where(F.col("started_at") >= since).groupBy("collector_type").agg(
        F.count_if(done).alias("success_count"),
        F.count_if(~done).alias("failure_count"),
        F.max("started_at").alias("_latest"),
        F.avg("total_items").alias("average_items"),
        F.avg(F.when(done, took)).alias("average_response_time"),
    )
    if types is not None:
        stats = types.select("collector_type").join(stats, "collector_type", "left")
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    ok, bad = F.coalesce("success_count", F.lit(0)), F.coalesce("failure_count", F.lit(0))
    return stats.select(
        "collector_type", zero("success_count", 0), zero("failure_count", 0),
        F.when(ok > 0, F.col("_latest")).alias("last_success"),
        zero("average_items", 0.0), zero("average_response_time", 0.0),
        _rate(ok, ok + bad).alias("success_rate"),
    )


def feed_stats(fetch_log: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Per feed: counts, last times, averages over successes, success rate and health."""
    ok = F.col("ok")
    stats = fetch_log.groupBy("source").agg(
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("failure_count"),
        F.max(F.when(ok, F.col("started_at"))).alias("last_success"),
        F.max(F.when(~ok, F.col("started_at"))).alias("last_failure"),
        F.avg(F.when(ok, F.col("items"))).alias("average_items"),
        F.avg(F.when(ok, F.col("elapsed_s"))).alias("average_response_time"),
    )
    if feeds is not None:
        stats = feeds.select("source").join(stats, "source", "left")
    stats = stats.fillna(
        {"success_count": 0, "failure_count": 0, "average_items": 0.0, "average_response_time": 0.0}
    )
    rate = _rate(F.col("success_count"), F.col("success_count") + F.col("failure_count"))
    return stats.withColumn("success_rate", rate).withColumn("health_status", _health(F.col("success_rate")))


def collection_sources(items: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Original items per source collected in the last ``days``, a row per source."""
    since = as_of_literal(as_of) - F.make_dt_interval(F.lit(days))
    return count_by_source(items.where(F.col("collected_at") >= since))


def collection_summary(items: DataFrame, runs: DataFrame, as_of, days: int = 7, collector_type: str = "rss") -> DataFrame:
    """One row: items per source, total, run statistics, the last ten runs.

    Each part is aggregated on its own before the one-row results meet. The map has an entry for every source; where
    they are too many for a row, read ``collection_sources``, ``run_stats`` and ``filters.recent_runs``.
    """
    sources = collection_sources(items, as_of, days).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n_items")))).alias("sources"),
        F.coalesce(F.sum("n_items"), F.lit(0)).alias("total_items"),
    )
    own = runs.where(F.col("collector_type") == collector_type)
    stats = run_stats(own, as_of, days).agg(F.first(F.struct(
        "success_count", "failure_count", "success_rate", "average_items", "average_response_time"
    )).alias("collector_stats"))
    fields = [c for c in ("started_at", "completed_at", "total_items", "new_items", "duplicate_items") if c in runs.columns]
    last = filters.recent_runs(own).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct(*fields)))).alias("recent_runs")
    )
    one = lambda df: df.withColumn("_one", F.lit(1))
    return (
        one(sources).join(one(stats), "_one").join(one(last), "_one")
        .select(F.lit(days).alias("period_days"), "sources", "total_items", "collector_stats", "recent_runs")
    )


def batch_counts(verdicts: DataFrame) -> DataFrame:
    """Total, new and duplicates of a batch in one row."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(~F.col("is_duplicate")).alias("new_items"),
        F.count_if("is_duplicate").alias("duplicate_items"),
    )


def failed_sources(failed: DataFrame) -> DataFrame:
    """Failed fetches per source, a row per source that failed."""
    return failed.groupBy("source").agg(F.count(F.lit(1)).alias("failed_fetches"))


def ingest_counters(verdicts: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """``batch_counts`` with the names of ``failed_sources`` as a list."""
    counts = batch_counts(verdicts)
    if failed is None:
        return counts.withColumn("failed_sources", F.array().cast("array<string>"))
    names = failed_sources(failed).agg(F.array_sort(F.collect_list("source")).alias("failed_sources"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(counts).join(one(names), "_one").drop("_one")


def _totals(items: DataFrame, key: str, sources: str) -> DataFrame:
    """Counts per group and its map source -> items, from one scan counted per source first.

    The map has one entry per source, that is per feed that is read.
    """
    per_source = items.groupBy(key, "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_duplicate").alias("copies")
    )
    return per_source.groupBy(key).agg(
        F.sum("n").alias("total_collected"),
        F.sum("copies").alias("duplicates_found"),
        F.sum(F.col("n") - F.col("copies")).alias("unique_items"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias(sources),
    )


def _topic_list(items: DataFrame, key: str, limit: int, name: str) -> DataFrame:
    ranked = top_topics(items, limit, by=key)
    inorder = F.array_sort(F.collect_list(F.struct("topic_rank", "topic", "n_items")))
    pairs = F.transform(inorder, lambda t: F.struct(t["topic"].alias("topic"), t["n_items"].alias("n_items")))
    return ranked.groupBy(key).agg(pairs.alias(name))


def daily_rollup(items: DataFrame, topics: int = 5) -> DataFrame:
    """Per day: totals, items per source, top tags."""
    by_day = items.withColumn("digest_date", day_of(F.col("published_at")))
    return (
        _totals(by_day, "digest_date", "sources_summary")
        .join(_topic_list(by_day, "digest_date", topics, "top_tags"), "digest_date", "left")
    )


def weekly_rollup(items: DataFrame, topics: int = 10) -> DataFrame:
    """Per week: ISO week and year, bounds, totals, trending tags, busiest day, sources."""
    by_week = items.withColumn("week_start", week_of(F.col("published_at")))
    days = by_week.groupBy("week_start", F.to_date("published_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # Most items first, the earlier day on a tie.
    busiest = days.groupBy("week_start").agg(F.max(F.struct("n", -F.datediff("day", "week_start"), "day")).alias("_b"))
    return as_weeks(
        _totals(by_week, "week_start", "sources_breakdown")
        .join(_topic_list(by_week, "week_start", topics, "trending_topics"), "week_start", "left")
        .join(busiest, "week_start")
    )


def as_weeks(totals: DataFrame) -> DataFrame:
    """Totals per ``week_start`` in the columns of a weekly rollup; ``_b`` is the busiest day."""
    start = F.col("week_start")
    return totals.select(
        "week_start",
        F.date_add(start, 7).alias("week_end"),
        F.weekofyear(start).alias("week_number"),
        F.extract(F.lit("YEAROFWEEK"), start).alias("year"),
        F.col("total_collected").alias("total_items"),
        F.col("unique_items").alias("unique_stories"),
        "duplicates_found", "trending_topics",
        F.col("_b.day").alias("most_active_day"),
        F.col("_b.n").alias("most_active_day_items"),
        "sources_breakdown",
    )


def period_facts(source_counts: DataFrame) -> DataFrame:
    """Per period: items collected and number of distinct sources, from counts per source."""
    return source_counts.groupBy("period").agg(
        F.sum("source_items").alias("total_collected"), F.count(F.lit(1)).alias("sources_count")
    )


def digest_facts(ranked: DataFrame) -> DataFrame:
    """Per digest: item count, its sources and categories. Bounded by the items of a digest."""
    order = F.array_sort(F.collect_set(F.struct("category_first_rank", "category")))
    return ranked.groupBy("period").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.transform(order, lambda c: c["category"]).alias("categories"),
    )


def task_status(task_runs: DataFrame) -> DataFrame:
    """Per task: last successful start, successes, errors, error of the latest run if it failed."""
    latest = F.max(F.struct("started_at", "run_id", "error")).alias("_latest")
    return task_runs.groupBy("task").agg(
        F.max(F.when(F.col("ok"), F.col("started_at"))).alias("last_run"),
        F.count_if("ok").alias("run_count"),
        F.count_if(~F.col("ok")).alias("error_count"),
        latest,
    ).withColumn("last_error", F.col("_latest.error")).drop("_latest")
