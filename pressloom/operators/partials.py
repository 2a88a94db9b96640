"""Day and week statistics that follow the stored items batch by batch.

Every batch leaves its counts per (day, source) and (day, tag). They are sums, so they merge in any order, and a batch that
comes again replaces its own. The statistics of a day, and of its week, are made from the counts of that day or week
alone, and only those of days that the batch has items of are made anew.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.operators import stats
from pressloom.sources import files

_COUNTS = "kind string, key string, n long, copies long, batch_id long, day date"


def day_counts(items: DataFrame) -> DataFrame:
    """``day, kind, key, n, copies``: items, and duplicates among them, per day and source (kind ``source``) and per day and
    tag (kind ``tag``), in one pass. Items without a publication time belong to no day."""
    named = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: named("tag", t))
    each = F.explode(F.concat(F.array(named("source", F.col("source"))), tags)).alias("k")
    rows = items.select(F.to_date("published_at").alias("day"), "is_duplicate", each).where("day IS NOT NULL")
    return rows.groupBy("day", "k.kind", "k.key").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_duplicate").alias("copies"))


def _totals(counts: DataFrame, period: str, sources: str) -> DataFrame:
    per_source = counts.where("kind = 'source'").groupBy(period, "key").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"))
    return per_source.groupBy(period).agg(
        F.sum("n").alias("total_collected"), F.sum("copies").alias("duplicates_found"), F.sum(F.col("n") - F.col("copies")).alias("unique_items"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(sources),
    )


def _topics(counts: DataFrame, period: str, limit: int, name: str) -> DataFrame:
    per_tag = counts.where("kind = 'tag'").groupBy(period, F.col("key").alias("topic")).agg(F.sum("n").alias("n_items"))
    best = stats.best_topics(per_tag, limit, period)
    inorder = F.array_sort(F.collect_list(F.struct("topic_rank", "topic", "n_items")))
    pairs = F.transform(inorder, lambda t: F.struct(t["topic"].alias("topic"), t["n_items"].alias("n_items")))
    return best.groupBy(period).agg(pairs.alias(name))


def daily_from(counts: DataFrame, topics: int = 5) -> DataFrame:
    """``stats.daily_rollup`` from counts."""
    counts = counts.withColumnRenamed("day", "digest_date")
    return _totals(counts, "digest_date", "sources_summary").join(_topics(counts, "digest_date", topics, "top_tags"), "digest_date", "left")


def weekly_from(counts: DataFrame, topics: int = 10) -> DataFrame:
    """``stats.weekly_rollup`` from counts of days."""
    counts = counts.withColumn("week_start", _week(F.col("day")))
    days = counts.where("kind = 'source'").groupBy("week_start", "day").agg(F.sum("n").alias("n"))
    busiest = days.groupBy("week_start").agg(F.max(F.struct("n", -F.datediff("day", "week_start"), "day")).alias("_b"))
    both = _totals(counts, "week_start", "sources_breakdown").join(_topics(counts, "week_start", topics, "trending_topics"), "week_start", "left")
    return stats.as_weeks(both.join(busiest, "week_start"))


def _week(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def read_counts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_COUNTS).parquet(f"{root}/counts")


def roll(items: DataFrame, root: str, batch_id: int, topics: int = 5, weekly_topics: int = 10) -> None:
    """Enter a batch of stored items and bring ``root/daily`` and ``root/weekly`` up to date.

    May be repeated for the same batch; batches may come in any order. Reads the counts of the touched days and weeks only.
    """
    spark = items.sparkSession
    folder = f"{root}/counts/batch_id={batch_id}"
    counted = day_counts(items).hint("rebalance", "day")
    # What this batch held before counts as touched too: a day it no longer has is to lose those items.
    before = spark.read.schema("n long, day date").parquet(folder).select("day") if files.exists(spark, folder) else None
    touched = set(files.partitions(before, ["day"])) if before is not None else set()
    counted.write.mode("overwrite").partitionBy("day").parquet(folder)
    touched |= set(files.partitions(spark.read.schema("n long, day date").parquet(folder), ["day"]))
    if not touched:
        return
    counts = read_counts(spark, root)
    days = files.one_of(["day"], sorted(touched))
    _renew(daily_from(counts.where(days), topics), f"{root}/daily", "digest_date", touched)
    weeks = {(d - timedelta(days=d.weekday()),) for (d,) in touched}
    whole = files.one_of(["day"], sorted((w + timedelta(days=i),) for (w,) in weeks for i in range(7)))
    _renew(weekly_from(counts.where(whole), weekly_topics), f"{root}/weekly", "week_start", weeks)


def _renew(made: DataFrame, path: str, key: str, touched: set[tuple]) -> None:
    """Replace the touched periods; those that have no items any more go."""
    written = files.replace_partitions(made, path, [key])
    for (gone,) in touched - set(files.partitions(written, [key])):
        files.delete(made.sparkSession, f"{path}/{key}={gone}")
