"""Scoring, capped ranking, categories and day groups, for all periods at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import scoring
from pressloom.functions.dates import period_days
from pressloom.functions.scoring import Weights
from pressloom.operators.skew import lookup_join

# Fixed values: (items, items per source) in a daily and in a weekly digest.
LIMITS = {"daily": (20, 3), "weekly": (50, 5)}

# A broadcast of ranked keys must be known to stay under this many rows.
BROADCAST_ROWS = 200_000


def reference_time(period: Column, kind: str) -> Column:
    """Days are scored against their start, weeks against their end."""
    start = period.cast("timestamp_ntz")
    return start if kind == "daily" else start + F.make_dt_interval(F.lit(period_days(kind)))


def source_counts(items: DataFrame) -> DataFrame:
    """Pool size per period and source; partial counts are made before the shuffle."""
    return items.groupBy("period", "source").agg(F.count(F.lit(1)).alias("source_items"))


def _signals(items: DataFrame, reference: Column, weights: Weights, important) -> DataFrame:
    w = weights.shares()
    chars = F.col("content_length") if "content_length" in items.columns else F.length("content")
    return items.withColumns({
        "recency": scoring.recency(F.col("published_at"), reference),
        "relevance": scoring.relevance(F.col("tags"), important),
        "length_score": scoring.length_score(chars),
    }).withColumn(
        "base",
        w.recency * F.col("recency") + w.relevance * F.col("relevance") + w.length * F.col("length_score"),
    )


def score_items(
    items: DataFrame, kind: str, weights: Weights = Weights(), important=scoring.IMPORTANT_TAGS
) -> DataFrame:
    """Every item of every period with its signals and total score.

    The pool sizes are looked up with hot sources spread over several tasks.
    """
    scored = _signals(items, reference_time(F.col("period"), kind), weights, important)
    key = ["period", "source"]
    return _total(lookup_join(scored, source_counts(items), key, ["id"], "inner", counted=items), weights)


def _total(counted: DataFrame, weights: Weights) -> DataFrame:
    return counted.withColumn("diversity", scoring.diversity(F.col("source_items"))).withColumn(
        "score", F.col("base") + weights.shares().diversity * F.col("diversity")
    )


def _best_first(*first: str) -> list[Column]:
    return [F.desc(c) for c in (*first, "published_at")] + [F.asc("id")]


def rank_items(
    items: DataFrame,
    kind: str,
    max_items: int | None = None,
    per_source: int | None = None,
    weights: Weights = Weights(),
    important=scoring.IMPORTANT_TAGS,
    keep: tuple[str, ...] = (),
    counts: DataFrame | None = None,
) -> DataFrame:
    """The best ``max_items`` of each period with at most ``per_source`` from one source.

    Diversity is the same for all items of a source in a period, so the order inside a
    source is known from the other signals alone. The per-source cap is therefore applied
    first, as a group limit before the shuffle, and pool sizes are counted separately and
    joined to the few rows left: no task ever holds a whole source or a whole period.
    Order: score, then score without diversity, then newest, then id.

    ``counts`` may pass the result of ``source_counts`` where it is at hand.
    Only narrow columns travel; name more with ``keep`` or attach them afterwards with
    ``attach_columns``.
    """
    default_items, default_cap = LIMITS[kind]
    max_items = default_items if max_items is None else max_items
    per_source = default_cap if per_source is None else per_source
    reference = reference_time(F.col("period"), kind)
    narrow = _signals(items, reference, weights, important).select(
        "period", "source", "id", "published_at", "tags", "base", *keep
    )
    in_source = Window.partitionBy("period", "source").orderBy(*_best_first("base"))
    capped = narrow.withColumn("source_rank", F.row_number().over(in_source)).where(
        F.col("source_rank") <= per_source
    )
    pool = source_counts(items) if counts is None else counts
    scored = _total(capped.join(pool, ["period", "source"]), weights)
    in_period = Window.partitionBy("period").orderBy(*_best_first("score", "base"))
    return (
        scored.withColumn("rank", F.row_number().over(in_period))
        .where(F.col("rank") <= max_items)
        .drop("source_rank", "diversity", "base", "source_items")
    )


def attach_columns(ranked: DataFrame, items: DataFrame, columns: list[str], row_bound: int | None = None) -> DataFrame:
    """Bring wide columns to ranked rows by id.

    ``row_bound`` is the most rows ``ranked`` can have (periods x items per period). When it
    is small enough the ranked side is broadcast, so the wide table is read once and never
    shuffled; otherwise the planner decides.
    """
    wide = items.select("id", *columns)
    small = F.broadcast(ranked) if row_bound is not None and row_bound <= BROADCAST_ROWS else ranked
    return wide.join(small, "id")


def with_category(ranked: DataFrame) -> DataFrame:
    """Category of each ranked item and the place of the category among those of its period."""
    named = ranked.withColumn("category", scoring.category(F.col("tags")))
    per_category = Window.partitionBy("period", "category")
    return named.withColumn("category_first_rank", F.min("rank").over(per_category))


def with_day(ranked: DataFrame, shown: int = 5) -> DataFrame:
    """Day label of each ranked item, its place within the day, and the place of the day.

    Days follow the order in which they first appear in the ranking.
    """
    day = F.to_date("published_at")
    per_day = Window.partitionBy("period", "day")
    return (
        ranked.withColumn("day", day)
        .withColumn("day_label", F.date_format("day", "EEEE, MMMM dd"))
        .withColumn("day_first_rank", F.min("rank").over(per_day))
        .withColumn("day_rank", F.row_number().over(per_day.orderBy("rank")))
        .withColumn("shown", F.col("day_rank") <= shown)
    )


def digest_entries(ranked: DataFrame, kind: str) -> DataFrame:
    """Link rows; the entry score counts down from the list length to 1."""
    size = F.count(F.lit(1)).over(Window.partitionBy("period"))
    return ranked.select(
        F.lit(kind).alias("digest_kind"),
        F.col("period").alias("period_start"),
        F.col("id").alias("item_id"),
        (size - F.col("rank") + 1).cast("double").alias("ranking_score"),
    )
