"""Deduplication: inside a batch, against history, against the registry, by meaning.

Verdict columns: ``is_duplicate, original_id, similarity_score, match_type``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import hashing
from pressloom.functions.dates import seconds_between
from pressloom.operators import filters, similarity
from pressloom.operators.skew import HOT_ROWS, first_per, fits, lookup_join, only_keys_of
from pressloom.sources.scratch import cut_lineage

# History window, similarity and time gate.
CANDIDATE_DAYS = 30
SIMILARITY = 0.90
GATE_DAYS = 7

VERDICT = ("is_duplicate", "original_id", "similarity_score", "match_type")


def with_item_id(items: DataFrame) -> DataFrame:
    """Fill in missing ids."""
    made = hashing.item_id(F.col("url"), F.col("title"))
    given = F.col("id") if "id" in items.columns else F.lit(None).cast("string")
    return items.withColumn("id", F.when(given.isNull() | (given == ""), made).otherwise(given))


def with_dedup_hashes(items: DataFrame) -> DataFrame:
    return items.withColumns({
        "url_hash": hashing.url_hash(F.col("url")),
        "title_hash": hashing.title_hash(F.col("title")),
        "content_hash": hashing.content_hash(F.col("content")),
    })


def dedup_batch(items: DataFrame, order: tuple[str, ...] = ("feed_pos", "entry_pos")) -> DataFrame:
    """First item per id, in feed order then entry order."""
    return first_per(items, ["id"], [F.asc(c) for c in order])


def _settle(df: DataFrame, match_type: str, original: Column, score: Column | None = None) -> DataFrame:
    """Add a verdict. Rows that an earlier step judged duplicates keep theirs."""
    found = original.isNotNull()
    new = {
        "is_duplicate": found,
        "original_id": original,
        "similarity_score": F.when(found, F.lit(1.0) if score is None else score).otherwise(0.0),
        "match_type": F.when(found, F.lit(match_type)).otherwise("none"),
    }
    if "match_type" not in df.columns:
        return df.withColumns(new)
    return df.withColumns({n: F.when(F.col("is_duplicate"), F.col(n)).otherwise(c) for n, c in new.items()})


def _earliest_per(df: DataFrame, keys: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """Per key the ``value`` of the earliest row, by a partial aggregate."""
    at = F.struct(*order, value)
    return df.groupBy(*keys).agg(F.min(at).alias("_at")).select(
        *keys, F.col(f"_at.{value}").alias(name), *[F.col(f"_at.{c}").alias(f"_{name}_{c}") for c in order]
    )


def find_duplicates(new: DataFrame, history: DataFrame, as_of, days: int = 7, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per new item: how many history rows share its url or its title, and the earliest of them.

    History is grouped by url, by lower-cased title and by both before anything is joined, so
    the work is linear even when one title is everywhere: the number of matches of an item is
    n(url) + n(title) - n(url and title). For the rows themselves see ``matching_history``.
    """
    past = filters.collected_since(history, as_of, days).select(
        "url", F.lower("title").alias("title_key"), "collected_at", "id"
    )
    out = asked = cut_lineage(new.select("id", "url", F.lower("title").alias("title_key")))
    small, earliest = fits(asked), F.min(F.struct("collected_at", "id"))
    grouped = lambda keys, name: only_keys_of(past, asked, keys, small).groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"n_{name}"), earliest.alias(f"first_{name}")
    )
    for keys, name in ((["url"], "url"), (["title_key"], "title"), (["url", "title_key"], "both")):
        out = lookup_join(out, grouped(keys, name), keys, ["id"], hot_rows=hot_rows, counted=asked)
    n = lambda name: F.coalesce(f"n_{name}", F.lit(0))
    first = F.least("first_url", "first_title")
    return out.select(
        "id",
        (n("url") + n("title") - n("both")).alias("n_matches"),
        n("url").alias("n_url_matches"),
        n("title").alias("n_title_matches"),
        first["id"].alias("first_match_id"),
    )


def matching_history(
    new: DataFrame, history: DataFrame, as_of, days: int = 7, spread_by: tuple[str, ...] = ("id",)
) -> DataFrame:
    """History rows that share the url or the title with any new item, with what they share.

    An OR of two equalities as two semi-joins against distinct keys, not as a nested loop.
    """
    past = filters.collected_since(history, as_of, days)
    urls = new.select("url").distinct().withColumn("same_url", F.lit(True))
    titles = new.select(F.lower("title").alias("_title_key")).distinct().withColumn("same_title", F.lit(True))
    # Distinct keys on the right: each history row meets at most one row on either join.
    past = past.withColumn("_title_key", F.lower("title"))
    by_url = lookup_join(past, urls, ["url"], list(spread_by))
    both = lookup_join(by_url, titles, ["_title_key"], list(spread_by), counted=past)
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = both.withColumns({"same_url": yes("same_url"), "same_title": yes("same_title")})
    return out.where(F.col("same_url") | F.col("same_title")).drop("_title_key")


def match_url(new: DataFrame, history: DataFrame, hot_rows: int = HOT_ROWS, fixed: bool = False) -> DataFrame:
    """Add the verdict of an exact url match against history (earliest collected wins).

    ``new`` is counted, sketched and joined, so it is written once, unless it is ``fixed`` already.
    """
    new = new if fixed else cut_lineage(new)
    past = only_keys_of(history.select("url", "collected_at", "id"), new, ["url"], fits(new))
    known = _earliest_per(past, ["url"], "id", ["collected_at"], "_original")
    known = known.select("url", "_original")
    out = lookup_join(new, known, ["url"], ["id"], hot_rows=hot_rows)
    return _settle(out, "exact_url", F.col("_original")).drop("_original")


def match_registry(
    new: DataFrame, registry: DataFrame, hot_rows: int = HOT_ROWS, counted: DataFrame | None = None
) -> DataFrame:
    """Add the verdict of the registry: same url hash, or same title hash and content hash.

    The earliest entry wins when several match. ``counted`` may name a cheaper table with the
    same rows as ``new``, to count hot keys on.
    """
    fields = ["url_hash", "title_hash", "content_hash"]
    hashed = lambda df: df if set(fields) <= set(df.columns) else with_dedup_hashes(df)
    if counted is None:
        new = counted = cut_lineage(hashed(new))
    new, counted = hashed(new), hashed(counted)
    small = fits(counted)
    entry = lambda keys, name: only_keys_of(registry, counted, keys, small).groupBy(*keys).agg(
        F.min(F.struct("first_seen_at", "news_item_id")).alias(name)
    )
    pair = ["title_hash", "content_hash"]
    out = lookup_join(new, entry(["url_hash"], "_by_url"), ["url_hash"], ["id"], hot_rows=hot_rows, counted=counted)
    out = lookup_join(out, entry(pair, "_by_text"), pair, ["id"], hot_rows=hot_rows, counted=counted)
    first = F.least("_by_url", "_by_text")["news_item_id"]
    return _settle(out, "exact_title", first).drop("_by_url", "_by_text")


def candidates(history: DataFrame, as_of, days: int = CANDIDATE_DAYS, cap: int | None = None) -> DataFrame:
    """The original items of the last ``days``; with ``cap`` only the newest."""
    return filters.recent(history, as_of, days, limit=cap)


def _age_us(published: Column) -> Column:
    """Microseconds from publication to a far day: the newer, the smaller."""
    return F.round(seconds_between(F.lit("2100-01-01 00:00:00").cast("timestamp_ntz"), published) * 1e6).cast("long")


def _as_candidates(cands: DataFrame) -> DataFrame:
    """Similarity input; equal scores go to the newer candidate."""
    age = _age_us(F.col("published_at"))
    return cands.select(F.col("id").alias("cand_id"), age.alias("cand_pos"), "embedding", "published_at")


def match_semantic(
    new: DataFrame, cands: DataFrame, threshold: float = SIMILARITY, gate: str = "after_best",
    gate_days: int = GATE_DAYS, cap: int | None = None,
) -> DataFrame:
    """Add the semantic verdict: only the best candidate counts, and only if it is near in time.

    A worse candidate that is near in time is not tried, unless ``gate='before_best'``, which
    lets only candidates near in time compete. ``cap`` states the most rows ``cands`` can have; few
    candidates are then compared in place instead of in the block join, with the same verdicts.
    Rows without a vector find nothing; rows that are already judged are not compared.
    """
    unjudged = ~F.col("is_duplicate") if "match_type" in new.columns else F.lit(True)
    if gate == "after_best" and cap is not None and cap <= similarity.SMALL_CANDIDATES:
        nearest = similarity.nearest_small(_as_candidates(cands), threshold, cap)
        out = new.withColumn("_best", nearest(F.when(unjudged, F.col("embedding"))))
    else:
        asked = new.where(unjudged).select(F.col("id").alias("query_id"), "embedding", "published_at")
        within = gate_days if gate == "before_best" else None
        found = similarity.top_similar_large(asked, _as_candidates(cands), threshold, 1, within_days=within)
        best = F.struct("cand_id", "cand_pos", "score").alias("_best")
        out = new.join(found.select(F.col("query_id").alias("id"), best), "id", "left")
    gap = F.abs(_age_us(F.col("published_at")) - F.col("_best.cand_pos"))
    original = F.when(gap <= gate_days * 86_400_000_000, F.col("_best.cand_id"))
    return _settle(out, "similar_content", original, F.col("_best.score")).drop("_best")


def dedup_cascade(
    new: DataFrame, history: DataFrame, registry: DataFrame, cands: DataFrame,
    threshold: float = SIMILARITY, gate: str = "after_best", cap: int | None = None,
) -> DataFrame:
    """Url, then registry, then meaning; the first that finds something decides.

    ``new`` is read by every step, so it is fixed first; give it without wide columns.
    """
    new = cut_lineage(with_dedup_hashes(new) if "content_hash" not in new.columns else new)
    by_url = match_url(new, history, fixed=True)
    by_registry = match_registry(by_url, registry, counted=new)
    return match_semantic(by_registry, cands, threshold, gate, cap=cap)


def dedup_batch_cascade(
    new: DataFrame, history: DataFrame, cands: DataFrame,
    threshold: float = SIMILARITY, gate: str = "after_best", cap: int | None = None,
) -> DataFrame:
    """Url, then meaning. The form that ingestion runs; the registry is not asked.

    ``new`` is read several times, so it is fixed first; give it without wide columns.
    """
    new = cut_lineage(new)
    return match_semantic(match_url(new, history, fixed=True), cands, threshold, gate, cap=cap)


def flag_duplicates(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items with ``is_duplicate`` and ``duplicate_of`` set from verdicts (unique ids)."""
    found = verdicts.where("is_duplicate").select("id", F.col("original_id").alias("_of"))
    old = F.col("duplicate_of") if "duplicate_of" in items.columns else F.lit(None).cast("string")
    return (
        lookup_join(items, found, ["id"], ["id"])
        .withColumn("is_duplicate", F.col("_of").isNotNull() | F.col("is_duplicate"))
        .withColumn("duplicate_of", F.coalesce("_of", old))
        .drop("_of")
    )
