"""Row filters over items, runs and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions.dates import as_of_literal, period_days, period_of
from pressloom.functions.text import strip
from pressloom.operators.skew import lookup_join


def _ago(as_of, days: int):
    return as_of_literal(as_of) - F.make_dt_interval(F.lit(days))


def _days_from(items: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    """Skip whole days of a stored table that cannot hold rows from ``start`` (until ``end``)."""
    if "published_date" not in items.columns:
        return items
    out = items.where(F.col("published_date") >= F.to_date(start))
    return out if end is None else out.where(F.col("published_date") <= F.to_date(end))


def require_title_link(df: DataFrame, title: str = "title", link: str = "link") -> DataFrame:
    """Drop entries whose title or link is missing or blank."""
    return df.where((F.length(strip(F.col(title))) > 0) & (F.length(strip(F.col(link))) > 0))


def younger_than(items: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Items published strictly after the cut-off."""
    return _days_from(items, _ago(as_of, days)).where(F.col("published_at") > _ago(as_of, days))


def recent(items: DataFrame, as_of, days: int = 7, source: str | None = None, limit: int | None = None) -> DataFrame:
    """Original items since the cut-off (inclusive). With ``limit``: the newest ones, in order."""
    since = _ago(as_of, days)
    out = _days_from(items, since).where((F.col("published_at") >= since) & ~F.col("is_duplicate"))
    if source:
        out = out.where(F.col("source") == source)
    if limit:
        out = out.orderBy(F.desc("published_at"), "id").limit(limit)
    return out


def collected_since(items: DataFrame, as_of, days: int) -> DataFrame:
    return items.where(F.col("collected_at") >= _ago(as_of, days))


def lookup(items: DataFrame, wanted: DataFrame, on: str, spread_by: list[str] | None = None) -> DataFrame:
    """Items whose ``id`` or ``url`` is in ``wanted``. Broadcast if small, else joined with hot keys spread."""
    spread = spread_by or [c for c in ("id", "url", "published_at", "collected_at") if c in items.columns]
    return lookup_join(items, wanted.select(on).distinct(), [on], spread, "left_semi")


def in_period(items: DataFrame, kind: str, first=None, last=None) -> DataFrame:
    """Add the ``period`` (day, or Monday of the week) of each item.

    ``first`` and ``last`` bound the periods kept, as dates: the periods that hold these days are the
    first and the last, and they are whole. The bound is also stated on ``published_at`` so that it
    reaches the scan.
    """
    ts = F.col("published_at")
    midnight = lambda day: period_of(F.lit(str(day)).cast("date"), kind).cast("timestamp_ntz")
    start = midnight(first) if first is not None else F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    if first is not None:
        items = _days_from(items, start).where(ts >= start)
    if last is not None:
        past = midnight(last) + F.make_dt_interval(F.lit(period_days(kind)))
        items = _days_from(items, start, past).where(ts < past)
    return items.withColumn("period", period_of(ts, kind))


def unsent(daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """Digests of both kinds that were not sent yet."""
    open_ones = lambda df, kind, key: df.where(~F.col("is_sent")).select(
        F.lit(kind).alias("digest_kind"), F.col(key).alias("period_start"), "item_count"
    )
    return open_ones(daily, "daily", "digest_date").unionByName(open_ones(weekly, "weekly", "week_start"))


def recent_runs(runs: DataFrame, collector_type: str | None = None, limit: int = 10) -> DataFrame:
    if collector_type:
        runs = runs.where(F.col("collector_type") == collector_type)
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def digest_for(digests: DataFrame, key: str, day) -> DataFrame:
    return digests.where(F.col(key) == F.lit(str(day)).cast("date"))
