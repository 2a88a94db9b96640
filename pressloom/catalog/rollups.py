"""Statistics, ranking and digests."""

from pyspark.sql import functions as F

from pressloom.catalog.registry import query
from pressloom.catalog.views_sql import BY_DAY, CATEGORISED, DAILY, FETCH_LOG, ITEMS, RUNS, TASK_RUNS, WEEKLY
from pressloom.functions import scoring
from pressloom.functions.text import preview
from pressloom.operators import filters, partials, ranking, stats
from pressloom.plans import digests, render
from pressloom.sources import sample_tables as st
from pressloom.sources.scratch import scratch_path

AS_OF = st.AS_OF


def all_items(spark, sf):
    return st.items(spark, sf, tags=True, duplicates=True)


def narrow(spark, sf):
    """Items without their texts: what scoring needs."""
    return all_items(spark, sf).select("doc_id", "id", "source", "published_at", "tags", "content_length", "is_duplicate")


def pool(spark, sf, kind):
    return filters.in_period(digests.originals(all_items(spark, sf)), kind, st.FIRST_DAY, st.LAST_DAY)


# --- statistics -----------------------------------------------------------------------------

@query("agg1_count_by_source", f"""
WITH {ITEMS} SELECT source, count(*) AS n_items FROM items
WHERE NOT is_duplicate AND collected_at >= TIMESTAMP '2024-01-10' GROUP BY source""")
def _(spark, sf):
    return stats.count_by_source(st.items(spark, sf, duplicates=True), "2024-01-10 00:00:00")


@query("agg2_top_topics", f"""
WITH {ITEMS} SELECT topic, count(*) AS n_items FROM (SELECT unnest(tags) AS topic FROM items) GROUP BY topic
ORDER BY n_items DESC, topic LIMIT 5""")
def _(spark, sf):
    return stats.top_topics(st.items(spark, sf, tags=True))


@query("agg2_top_topics_by_week", f"""
WITH {ITEMS} SELECT period, topic, n_items, topic_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY period ORDER BY n_items DESC, topic) AS topic_rank FROM (
    SELECT CAST(CAST(date_trunc('week', published_at) AS DATE) AS VARCHAR) AS period, topic, count(*) AS n_items
    FROM (SELECT published_at, unnest(tags) AS topic FROM items) GROUP BY 1, 2))
WHERE topic_rank <= 3""")
def _(spark, sf):
    weekly = filters.in_period(st.items(spark, sf, tags=True), "weekly")
    return stats.top_topics(weekly, 3, by="period")


@query("agg3_run_stats", f"""
WITH {RUNS} SELECT collector_type, count(completed_at) AS success_count, count(*) - count(completed_at) AS failure_count,
  CAST(CASE WHEN count(completed_at) > 0 THEN max(started_at) END AS VARCHAR) AS last_success,
  round(avg(total_items), 6) AS average_items,
  round(coalesce(avg(epoch(completed_at) - epoch(started_at)), 0.0), 6) AS average_response_time,
  round(count(completed_at) / count(*), 6) AS success_rate
FROM runs WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY collector_type""")
def _(spark, sf):
    return stats.run_stats(st.runs(spark, sf), AS_OF, 7)


# Feeds are the users of the log and as many again that never ran.
@query("agg4_feed_stats", f"""
WITH {FETCH_LOG}, feeds AS (
  SELECT DISTINCT source FROM fetch_log UNION ALL SELECT DISTINCT 'idle' || source FROM fetch_log),
s AS (SELECT f.source, count(*) FILTER (l.ok) AS success_count, count(*) FILTER (NOT l.ok) AS failure_count,
        max(started_at) FILTER (l.ok) AS last_success, max(started_at) FILTER (NOT l.ok) AS last_failure,
        avg(items) FILTER (l.ok) AS average_items, avg(elapsed_s) FILTER (l.ok) AS average_response_time
      FROM feeds f LEFT JOIN fetch_log l ON l.source = f.source GROUP BY f.source),
r AS (SELECT *, CASE WHEN success_count + failure_count > 0 THEN success_count / (success_count + failure_count) ELSE 0.0 END AS rate FROM s)
SELECT source, success_count, failure_count, CAST(last_success AS VARCHAR) AS last_success, CAST(last_failure AS VARCHAR) AS last_failure,
  round(coalesce(average_items, 0.0), 6) AS average_items, round(coalesce(average_response_time, 0.0), 6) AS average_response_time,
  round(rate, 6) AS success_rate,
  CASE WHEN rate >= 0.9 THEN 'healthy' WHEN rate >= 0.7 THEN 'degraded' ELSE 'unhealthy' END AS health_status
FROM r""")
def _(spark, sf):
    log = st.fetch_log(spark, sf)
    seen = log.select("source").distinct()
    idle = seen.select(F.concat(F.lit("idle"), "source").alias("source"))
    return stats.feed_stats(log, seen.unionByName(idle))


@query("agg5_collection_sources", f"""
WITH {ITEMS} SELECT source, count(*) AS n_items FROM items
WHERE NOT is_duplicate AND collected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY source""")
def _(spark, sf):
    return stats.collection_sources(st.items(spark, sf, duplicates=True), AS_OF, 7)


@query("agg5_collection_summary", f"""
WITH {ITEMS}, {RUNS}, c AS (
  SELECT source, count(*) AS n FROM items WHERE NOT is_duplicate AND collected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY source),
r AS (SELECT * FROM runs WHERE collector_type = 'view'),
w AS (SELECT * FROM r WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY),
l AS (SELECT * FROM r ORDER BY started_at DESC LIMIT 10)
SELECT 7::BIGINT AS period_days,
  (SELECT string_agg(source || '=' || n, '|' ORDER BY source) FROM c) AS sources,
  (SELECT CAST(sum(n) AS BIGINT) FROM c) AS total_items,
  (SELECT count(completed_at) FROM w) AS success_count, (SELECT count(*) - count(completed_at) FROM w) AS failure_count,
  (SELECT round(count(completed_at) / count(*), 6) FROM w) AS success_rate,
  (SELECT round(avg(total_items), 6) FROM w) AS average_items,
  (SELECT round(avg(epoch(completed_at) - epoch(started_at)), 6) FROM w) AS average_response_time,
  (SELECT string_agg(CAST(started_at AS VARCHAR), '|' ORDER BY started_at DESC) FROM l) AS recent_starts""")
def _(spark, sf):
    summary = stats.collection_summary(st.items(spark, sf, duplicates=True), st.runs(spark, sf), AS_OF, 7, "view")
    pairs = F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return summary.select(
        "period_days", pairs.alias("sources"), "total_items", "collector_stats.*",
        F.transform("recent_runs", lambda r: r["started_at"].cast("string")).alias("recent_starts"),
    )


_DAILY_SQL = f"""
WITH {ITEMS}, d AS (SELECT *, CAST(published_at AS DATE) AS day FROM items),
s AS (SELECT day, string_agg(source || '=' || n, '|' ORDER BY source) AS sources_summary FROM (
        SELECT day, source, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY day),
t AS (SELECT day, string_agg(topic || '=' || n, '|' ORDER BY n DESC, topic) AS top_tags FROM (
        SELECT day, topic, count(*) AS n FROM (SELECT day, unnest(tags) AS topic FROM d) GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY day ORDER BY count(*) DESC, topic) <= 5) GROUP BY day)
SELECT CAST(d.day AS VARCHAR) AS digest_date, count(*) AS total_collected, count(*) FILTER (is_duplicate) AS duplicates_found,
  count(*) FILTER (NOT is_duplicate) AS unique_items, any_value(sources_summary) AS sources_summary, any_value(top_tags) AS top_tags
FROM d JOIN s ON s.day = d.day LEFT JOIN t ON t.day = d.day GROUP BY d.day"""


@query("agg7_daily_rollup", _DAILY_SQL)
def _(spark, sf):
    out = stats.daily_rollup(narrow(spark, sf))
    return _listed(out, "sources_summary", "top_tags")


def _listed(df, source_map, topics):
    pair = lambda k, v: F.concat(k, F.lit("="), v.cast("string"))
    return df.withColumns({
        source_map: F.transform(F.map_entries(source_map), lambda e: pair(e["key"], e["value"])),
        topics: F.transform(topics, lambda t: pair(t["topic"], t["n_items"])),
    })


_WEEKLY_SQL = f"""
WITH {ITEMS}, d AS (SELECT *, CAST(date_trunc('week', published_at) AS DATE) AS week, CAST(published_at AS DATE) AS day FROM items),
s AS (SELECT week, string_agg(source || '=' || n, '|' ORDER BY source) AS sources_breakdown FROM (
        SELECT week, source, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY week),
t AS (SELECT week, string_agg(topic || '=' || n, '|' ORDER BY n DESC, topic) AS trending_topics FROM (
        SELECT week, topic, count(*) AS n FROM (SELECT week, unnest(tags) AS topic FROM d) GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY week ORDER BY count(*) DESC, topic) <= 10) GROUP BY week),
b AS (SELECT week, day, count(*) AS n FROM d GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY week ORDER BY count(*) DESC, day) = 1)
SELECT CAST(d.week AS VARCHAR) AS week_start, CAST(CAST(d.week + INTERVAL 7 DAY AS DATE) AS VARCHAR) AS week_end,
  weekofyear(d.week) AS week_number, isoyear(d.week) AS year, count(*) AS total_items,
  count(*) FILTER (NOT is_duplicate) AS unique_stories, count(*) FILTER (is_duplicate) AS duplicates_found,
  any_value(trending_topics) AS trending_topics, CAST(any_value(b.day) AS VARCHAR) AS most_active_day,
  any_value(b.n) AS most_active_day_items, any_value(sources_breakdown) AS sources_breakdown
FROM d JOIN s ON s.week = d.week JOIN b ON b.week = d.week LEFT JOIN t ON t.week = d.week GROUP BY d.week"""


@query("agg8_weekly_rollup", _WEEKLY_SQL)
def _(spark, sf):
    return _listed(stats.weekly_rollup(narrow(spark, sf)), "sources_breakdown", "trending_topics")


def _rolled(spark, sf, kind):
    """The rollups after three batches that came out of order, one of them twice."""
    root, items = scratch_path(spark, "rollups"), narrow(spark, sf)
    for part in (2, 0, 1, 0):
        partials.roll(items.where(F.pmod("doc_id", F.lit(3)) == part), root, part)
    return spark.read.parquet(f"{root}/{kind}")


@query("agg7_daily_incremental", _DAILY_SQL)
def _(spark, sf):
    return _listed(_rolled(spark, sf, "daily"), "sources_summary", "top_tags")


@query("agg8_weekly_incremental", _WEEKLY_SQL)
def _(spark, sf):
    return _listed(_rolled(spark, sf, "weekly"), "sources_breakdown", "trending_topics")


@query("agg9_period_facts", f"""
WITH {ITEMS} SELECT CAST(CAST(date_trunc('week', published_at) AS DATE) AS VARCHAR) AS period,
  count(*) AS total_collected, count(DISTINCT source) AS sources_count FROM items WHERE NOT is_duplicate GROUP BY 1""")
def _(spark, sf):
    return stats.period_facts(ranking.source_counts(pool(spark, sf, "weekly")))


@query("agg9_digest_facts", f"""
WITH {CATEGORISED}, c AS (SELECT period, string_agg(category, '|' ORDER BY f) AS categories FROM (
  SELECT period, category, min(rank) AS f FROM categorised GROUP BY 1, 2) GROUP BY period),
s AS (SELECT period, string_agg(source, '|' ORDER BY source) AS sources FROM (SELECT DISTINCT period, source FROM ranked) GROUP BY period)
SELECT CAST(r.period AS VARCHAR) AS period, count(*) AS item_count, any_value(sources) AS sources, any_value(categories) AS categories
FROM ranked r JOIN c ON c.period = r.period JOIN s ON s.period = r.period GROUP BY r.period""")
def _(spark, sf):
    return stats.digest_facts(ranking.with_category(ranking.rank_items(pool(spark, sf, "daily"), "daily")))


@query("agg10_task_status", f"""
WITH {TASK_RUNS} SELECT task, CAST(max(started_at) FILTER (ok) AS VARCHAR) AS last_run, count(*) FILTER (ok) AS run_count,
  count(*) FILTER (NOT ok) AS error_count,
  (SELECT error FROM task_runs x WHERE x.task = t.task ORDER BY started_at DESC, run_id DESC LIMIT 1) AS last_error
FROM task_runs t GROUP BY task""")
def _(spark, sf):
    return stats.task_status(st.task_runs(spark, sf))


# --- ranking --------------------------------------------------------------------------------

_SIGNALS = "round(recency, 6) AS recency, round(CAST(relevance AS DOUBLE), 6) AS relevance, CAST(length_score AS DOUBLE) AS length_score"


@query("rnk1_recency", f"""
WITH {DAILY}, w AS (SELECT id, exp(-((epoch(CAST(date_trunc('week', published_at) AS TIMESTAMP) + INTERVAL 7 DAY) - epoch(published_at)) / 3600.0) / 24.0) AS weekly FROM pool)
SELECT p.id, round(recency, 6) AS daily, round(weekly, 6) AS weekly FROM parts p JOIN w ON w.id = p.id""")
def _(spark, sf):
    at = F.col("published_at")
    both = pool(spark, sf, "daily").withColumn("week", F.trunc(F.to_date(at), "week"))
    return both.select(
        "id",
        scoring.recency(at, ranking.reference_time(F.col("period"), "daily")).alias("daily"),
        scoring.recency(at, ranking.reference_time(F.col("week"), "weekly")).alias("weekly"),
    )


@query("rnk2_relevance", f"WITH {DAILY} SELECT id, CAST(relevance AS DOUBLE) AS relevance FROM signals")
def _(spark, sf):
    return digests.originals(narrow(spark, sf)).select("id", scoring.relevance(F.col("tags")).alias("relevance"))


@query("rnk3_length_score", f"WITH {DAILY} SELECT id, CAST(length_score AS DOUBLE) AS length_score FROM signals")
def _(spark, sf):
    items = digests.originals(st.items(spark, sf, duplicates=True))
    return items.select("id", scoring.length_score(F.col("content_length")).alias("length_score"))


@query("rnk4_diversity", f"""
WITH {WEEKLY} SELECT DISTINCT CAST(period AS VARCHAR) AS period, source, source_items, round(diversity, 6) AS diversity FROM parts""")
def _(spark, sf):
    counts = ranking.source_counts(pool(spark, sf, "weekly"))
    return counts.withColumn("diversity", scoring.diversity(F.col("source_items")))


@query("rnk5_score_items", f"""
WITH {WEEKLY} SELECT CAST(period AS VARCHAR) AS period, id, {_SIGNALS}, round(diversity, 6) AS diversity, round(score, 6) AS score FROM scored""")
def _(spark, sf):
    scored = ranking.score_items(pool(spark, sf, "weekly"), "weekly")
    return scored.select("period", "id", "recency", "relevance", "length_score", "diversity", "score")


_RANKED_SQL = "SELECT CAST(period AS VARCHAR) AS period, rank, id, source, round(score, 6) AS score FROM ranked"


@query("rnk6_daily", f"WITH {DAILY} {_RANKED_SQL}")
def _(spark, sf):
    ranked = ranking.rank_items(pool(spark, sf, "daily"), "daily")
    return ranked.select("period", "rank", "id", "source", "score")


@query("rnk6_weekly", f"WITH {WEEKLY} {_RANKED_SQL}")
def _(spark, sf):
    ranked = ranking.rank_items(pool(spark, sf, "weekly"), "weekly")
    return ranked.select("period", "rank", "id", "source", "score")


@query("rnk7_category", f"""
WITH {CATEGORISED} SELECT CAST(period AS VARCHAR) AS period, rank, id, category FROM categorised""")
def _(spark, sf):
    ranked = ranking.rank_items(pool(spark, sf, "daily"), "daily")
    return ranked.select("period", "rank", "id", scoring.category(F.col("tags")).alias("category"))


@query("rnk8_by_category", f"""
WITH {CATEGORISED} SELECT CAST(period AS VARCHAR) AS period, category, category_first_rank,
       row_number() OVER (PARTITION BY period, category ORDER BY rank) AS place, id FROM categorised""")
def _(spark, sf):
    from pyspark.sql import Window

    grouped = ranking.with_category(ranking.rank_items(pool(spark, sf, "daily"), "daily"))
    place = F.row_number().over(Window.partitionBy("period", "category").orderBy("rank"))
    return grouped.select("period", "category", "category_first_rank", place.alias("place"), "id")


@query("rnk9_by_day", f"""
WITH {BY_DAY} SELECT CAST(period AS VARCHAR) AS period, day_label, day_first_rank, day_rank, id, day_rank <= 5 AS shown FROM by_day""")
def _(spark, sf):
    ranked = ranking.with_day(ranking.rank_items(pool(spark, sf, "weekly"), "weekly"))
    return ranked.select("period", "day_label", "day_first_rank", "day_rank", "id", "shown")


_ENTRIES_SQL = """SELECT '{kind}' AS digest_kind, CAST(period AS VARCHAR) AS period_start, id AS item_id,
  CAST(count(*) OVER (PARTITION BY period) - rank + 1 AS DOUBLE) AS ranking_score FROM ranked"""


@query("rnk10_digest_entries", f"WITH {DAILY} {_ENTRIES_SQL.format(kind='daily')}")
def _(spark, sf):
    return ranking.digest_entries(ranking.rank_items(pool(spark, sf, "daily"), "daily"), "daily")


# --- digests --------------------------------------------------------------------------------

def daily(spark, sf, **kw):
    return digests.daily_digests(all_items(spark, sf), AS_OF, st.FIRST_DAY, st.LAST_DAY, **kw)


def weekly(spark, sf, **kw):
    return digests.weekly_summaries(all_items(spark, sf), AS_OF, st.FIRST_DAY, st.LAST_DAY, **kw)


_FACTS = f"""{CATEGORISED},
cats AS (SELECT period, string_agg(category, '|' ORDER BY f) AS categories FROM (
  SELECT period, category, min(rank) AS f FROM categorised GROUP BY 1, 2) GROUP BY period),
srcs AS (SELECT period, string_agg(source, '|' ORDER BY source) AS sources FROM (SELECT DISTINCT period, source FROM ranked) GROUP BY period),
totals AS (SELECT period, count(*) AS total_collected FROM pool GROUP BY period),
sizes AS (SELECT period, count(*) AS item_count FROM ranked GROUP BY period),
facts AS (SELECT s.period, item_count, total_collected, sources, categories FROM sizes s
  JOIN cats USING (period) JOIN srcs USING (period) JOIN totals USING (period))"""

_NL = "chr(10)"
_MD_SCORE = "printf('%.2f', score)"
_SHOWN = "CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END"


def _md_item(compact: bool) -> str:
    score = "" if compact else f" || ' | **Relevance:** ' || {_MD_SCORE}"
    body = "''" if compact else f"{_SHOWN} || {_NL}"
    return (
        f"'### [' || title || '](' || url || ')' || {_NL} || '**Source:** ' || source || ' | **Published:** ' "
        f"|| strftime(published_at, '%Y-%m-%d %H:%M') || CASE WHEN len(tags) > 0 THEN ' | **Tags:** ' || array_to_string(tags, ', ') ELSE '' END"
        f"{score} || {_NL} || {_NL} || {body}"
    )


_TITLED = "upper(category[1]) || substr(category, 2)"
_DAILY_MD = f"""{_FACTS},
blocks AS (SELECT period, category_first_rank AS g, rank,
    CASE WHEN rank = category_first_rank THEN '## ' || {_TITLED} || {_NL} || {_NL} ELSE '' END || {_md_item(False)} AS t FROM categorised),
bodies AS (SELECT period, string_agg(t, {_NL} ORDER BY g, rank) AS body FROM blocks GROUP BY period),
texts AS (SELECT f.*, '# Daily News Digest - ' || strftime(f.period, '%Y-%m-%d') || {_NL} || {_NL} || '**Total items:** ' || item_count || {_NL}
    || '**Sources:** ' || replace(sources, '|', ', ') || {_NL} || '**Categories:** ' || replace(categories, '|', ', ') || {_NL} || {_NL}
    || '---' || {_NL} || {_NL} || body || {_NL} || '---' || {_NL} || {_NL} || '*Generated automatically*' AS content_markdown
  FROM facts f JOIN bodies b ON b.period = f.period)"""


@query("dig1_daily_digests", f"""
WITH {_FACTS} SELECT CAST(period AS VARCHAR) AS digest_date, item_count, total_collected, sources, categories,
  FALSE AS is_sent, CAST(NULL AS VARCHAR) AS sent_at, '{AS_OF}' AS created_at FROM facts""")
def _(spark, sf):
    return daily(spark, sf, texts=False).records


@query("dig2_weekly_summaries", f"""
WITH {WEEKLY}, sizes AS (SELECT period, count(*) AS item_count FROM ranked GROUP BY period),
totals AS (SELECT period, count(*) AS total_collected, count(DISTINCT source) AS sources_count FROM pool GROUP BY period),
topics AS (SELECT period, string_agg(topic, '|' ORDER BY n DESC, topic) AS top_topics FROM (
  SELECT period, topic, count(*) AS n FROM (SELECT period, unnest(tags) AS topic FROM pool) GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY period ORDER BY count(*) DESC, topic) <= 10) GROUP BY period)
SELECT CAST(s.period AS VARCHAR) AS week_start, CAST(CAST(s.period + INTERVAL 7 DAY AS DATE) AS VARCHAR) AS week_end, item_count,
  total_collected, sources_count, top_topics, FALSE AS is_sent, CAST(NULL AS VARCHAR) AS sent_at, '{AS_OF}' AS created_at
FROM sizes s JOIN totals t ON t.period = s.period LEFT JOIN topics p ON p.period = s.period""")
def _(spark, sf):
    return weekly(spark, sf, texts=False).records


@query("dig3_digest_entries", f"WITH {WEEKLY} {_ENTRIES_SQL.format(kind='weekly')}")
def _(spark, sf):
    return weekly(spark, sf, texts=False).entries


# Stored: digests of three items for the first half of the month, already sent.
def stored_daily(spark, sf):
    few = digests.daily_digests(all_items(spark, sf), "2024-01-16 00:00:00", st.FIRST_DAY, "2024-01-15", max_items=3, texts=False)
    return few.records.withColumns({"is_sent": F.lit(True), "sent_at": F.lit("2024-01-17 00:00:00").cast("timestamp_ntz")})


def _merged_sql(force: bool) -> str:
    kept = "period <= DATE '2024-01-15'"
    few = "item_count" if force else f"CASE WHEN {kept} THEN least(item_count, 3) ELSE item_count END"
    return f"""
WITH {_FACTS} SELECT CAST(period AS VARCHAR) AS digest_date, {few} AS item_count, total_collected, {kept} AS is_sent,
  CASE WHEN {kept} THEN '2024-01-17 00:00:00' END AS sent_at,
  CASE WHEN {kept} THEN '2024-01-16 00:00:00' ELSE '{AS_OF}' END AS created_at FROM facts"""


_MERGED = ("digest_date", "item_count", "total_collected", "is_sent", "sent_at", "created_at")


@query("dig4_merge_digests", _merged_sql(False))
def _(spark, sf):
    return digests.merge_digests(stored_daily(spark, sf), daily(spark, sf, texts=False).records, "digest_date").select(*_MERGED)


@query("dig4_merge_digests_forced", _merged_sql(True))
def _(spark, sf):
    merged = digests.merge_digests(stored_daily(spark, sf), daily(spark, sf, texts=False).records, "digest_date", force=True)
    return merged.select(*_MERGED)


def _replaced(spark, sf, force):
    root = scratch_path(spark, "digests")
    few = digests.Digests(stored_daily(spark, sf), daily(spark, sf, texts=False).entries.where("period_start <= DATE'2024-01-15'"))
    digests.store_digests(few, root, "daily")
    made = daily(spark, sf, texts=False)
    digests.store_digests(made, root, "daily", force)
    return spark.read.schema(made.records.schema).parquet(f"{root}/daily").select(*_MERGED)


@query("dig4_store_digests", _merged_sql(False))
def _(spark, sf):
    return _replaced(spark, sf, False)


@query("dig4_store_digests_forced", _merged_sql(True))
def _(spark, sf):
    return _replaced(spark, sf, True)


def marked(spark, sf):
    records = daily(spark, sf, texts=False).records
    even = records.where(F.dayofmonth("digest_date") % 2 == 0).select("digest_date")
    return digests.mark_sent(records, even, "digest_date", "2024-02-01 00:00:00")


@query("dig5_mark_sent", f"""
WITH {DAILY} SELECT DISTINCT CAST(period AS VARCHAR) AS digest_date, day(period) % 2 = 0 AS is_sent,
  CASE WHEN day(period) % 2 = 0 THEN '2024-02-01 00:00:00' END AS sent_at FROM ranked""")
def _(spark, sf):
    return marked(spark, sf).select("digest_date", "is_sent", "sent_at")


@query("flt5_unsent", f"""
WITH {DAILY}, weeks AS (SELECT CAST(date_trunc('week', published_at) AS DATE) AS period,
    row_number() OVER (PARTITION BY date_trunc('week', published_at), source) AS n FROM pool)
SELECT 'daily' AS digest_kind, CAST(period AS VARCHAR) AS period_start, count(*) AS item_count FROM ranked
WHERE day(period) % 2 = 1 GROUP BY period
UNION ALL SELECT 'weekly', CAST(period AS VARCHAR), least(50, count(*)) FROM weeks WHERE n <= 5 GROUP BY period""")
def _(spark, sf):
    return filters.unsent(marked(spark, sf), weekly(spark, sf, texts=False).records)


@query("flt7_digest_for", f"""
WITH {_FACTS} SELECT CAST(period AS VARCHAR) AS digest_date, item_count, total_collected FROM facts WHERE period = DATE '2024-01-17'""")
def _(spark, sf):
    found = filters.digest_for(daily(spark, sf, texts=False).records, "digest_date", "2024-01-17")
    return found.select("digest_date", "item_count", "total_collected")


@query("dig6_markdown_items", f"""
WITH {CATEGORISED} SELECT CAST(period AS VARCHAR) AS period, rank, {_md_item(False)} AS block FROM categorised""")
def _(spark, sf):
    items = all_items(spark, sf).withColumn("preview", preview(F.col("content")))
    ranked = ranking.rank_items(pool(spark, sf, "daily"), "daily")
    wide = ranking.attach_columns(ranked, items, ["title", "url", "summary", "preview"], row_bound=31 * 20)
    return wide.select("period", "rank", render.item_markdown().alias("block"))


@query("dig6_daily_markdown", f"WITH {_DAILY_MD} SELECT CAST(period AS VARCHAR) AS digest_date, content_markdown FROM texts")
def _(spark, sf):
    return daily(spark, sf).records.select("digest_date", "content_markdown")


_WEEK_PARTS = f"""{BY_DAY},
sizes AS (SELECT period, count(*) AS item_count FROM ranked GROUP BY period),
totals AS (SELECT period, count(*) AS total_collected, count(DISTINCT source) AS sources_count FROM pool GROUP BY period),
counted AS (SELECT period, topic, count(*) AS n FROM (SELECT period, unnest(tags) AS topic FROM pool) GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY period ORDER BY count(*) DESC, topic) <= 10)"""


@query("dig6_weekly_markdown", f"""
WITH {_WEEK_PARTS},
topics AS (SELECT period, string_agg('- **' || topic || '**: ' || n || ' articles', {_NL} ORDER BY n DESC, topic) AS listed FROM counted GROUP BY period),
blocks AS (SELECT period, day_first_rank AS g, rank,
    CASE WHEN day_rank = 1 THEN '### ' || day_label || {_NL} || {_NL} ELSE '' END || {_md_item(True)} AS t FROM by_day WHERE day_rank <= 5),
bodies AS (SELECT period, string_agg(t, {_NL} ORDER BY g, rank) AS body FROM blocks GROUP BY period)
SELECT CAST(s.period AS VARCHAR) AS week_start, '# Weekly News Summary' || {_NL} || '**Period:** ' || strftime(s.period, '%Y-%m-%d') || ' to '
  || strftime(s.period + INTERVAL 7 DAY, '%Y-%m-%d') || {_NL} || {_NL} || '## Overview' || {_NL} || '- **Total items:** ' || item_count || {_NL}
  || '- **Total collected this week:** ' || total_collected || {_NL} || '- **Active sources:** ' || sources_count || {_NL} || {_NL}
  || '## Top Topics This Week' || {_NL} || listed || {_NL} || {_NL} || '## Top Stories' || {_NL} || {_NL} || body || {_NL}
  || '---' || {_NL} || {_NL} || '*Generated automatically*' AS content_markdown
FROM sizes s JOIN totals t ON t.period = s.period JOIN topics p ON p.period = s.period JOIN bodies b ON b.period = s.period""")
def _(spark, sf):
    return weekly(spark, sf).records.select("week_start", "content_markdown")


def _esc(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _html_item(compact: bool) -> str:
    score = "" if compact else f" || '<span><strong>Relevance:</strong> ' || {_MD_SCORE} || '</span>'"
    body = "" if compact else f" || '<p>' || {_esc(_SHOWN)} || '</p>'"
    return (
        f"'<div class=\"article\"><h3><a href=\"' || {_esc('url')} || '\">' || {_esc('title')} || '</a></h3><div class=\"meta\">' "
        f"|| '<span><strong>Source:</strong> ' || {_esc('source')} || '</span><span><strong>Published:</strong> ' "
        f"|| strftime(published_at, '%Y-%m-%d %H:%M') || '</span>'{score} || '</div>' "
        f"|| CASE WHEN len(tags) > 0 THEN '<div class=\"tags\">' || array_to_string(list_transform(tags, lambda t: "
        f"'<span class=\"tag\">' || t || '</span>'), '') || '</div>' ELSE '' END{body} || '</div>'"
    )


_HTML_END = "'<div class=\"footer\"><p>Generated automatically</p></div></body></html>'"


@query("dig7_daily_html", f"""
WITH {_FACTS},
blocks AS (SELECT period, category_first_rank AS g, rank,
    CASE WHEN rank = category_first_rank THEN '<h2>' || {_TITLED} || '</h2>' ELSE '' END || {_html_item(False)} AS t FROM categorised),
bodies AS (SELECT period, string_agg(t, '' ORDER BY g, rank) AS body FROM blocks GROUP BY period)
SELECT CAST(f.period AS VARCHAR) AS digest_date, '<!DOCTYPE html><html><head><meta charset="UTF-8"><title>Daily News Digest - '
  || strftime(f.period, '%Y-%m-%d') || '</title></head><body><h1>Daily News Digest - ' || strftime(f.period, '%Y-%m-%d')
  || '</h1><div class="summary"><strong>Total items:</strong> ' || item_count || '<br><strong>Sources:</strong> ' || replace(sources, '|', ', ')
  || '<br><strong>Categories:</strong> ' || replace(categories, '|', ', ') || '</div>' || body || {_HTML_END} AS content_html
FROM facts f JOIN bodies b ON b.period = f.period""")
def _(spark, sf):
    return daily(spark, sf).records.select("digest_date", "content_html")


@query("dig7_weekly_html", f"""
WITH {_WEEK_PARTS},
topics AS (SELECT period, string_agg('<div class="topic-item">' || upper(topic[1]) || substr(topic, 2) || '<span class="topic-count">' || n || '</span></div>', ''
    ORDER BY n DESC, topic) AS listed FROM counted GROUP BY period),
blocks AS (SELECT period, day_first_rank AS g, rank,
    CASE WHEN day_rank = 1 THEN '<h3>' || day_label || '</h3>' ELSE '' END || {_html_item(True)} AS t FROM by_day WHERE day_rank <= 5),
bodies AS (SELECT period, string_agg(t, '' ORDER BY g, rank) AS body FROM blocks GROUP BY period)
SELECT CAST(s.period AS VARCHAR) AS week_start,
  '<!DOCTYPE html><html><head><meta charset="UTF-8"><title>Weekly News Summary</title></head><body><h1>Weekly News Summary</h1><div class="period">Period: '
  || strftime(s.period, '%Y-%m-%d') || ' to ' || strftime(s.period + INTERVAL 7 DAY, '%Y-%m-%d')
  || '</div><h2>Overview</h2><div class="overview"><strong>Selected stories:</strong> ' || item_count
  || '<br><strong>Total collected:</strong> ' || total_collected || '<br><strong>Active sources:</strong> ' || sources_count
  || '</div><h2>Top Topics This Week</h2><div class="topics">' || listed || '</div><h2>Top Stories</h2>' || body || {_HTML_END} AS content_html
FROM sizes s JOIN totals t ON t.period = s.period JOIN topics p ON p.period = s.period JOIN bodies b ON b.period = s.period""")
def _(spark, sf):
    return weekly(spark, sf).records.select("week_start", "content_html")
