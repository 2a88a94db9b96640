"""Sources, sinks, ingestion and streams.

Feeds are not among the sample tables, so Spark first writes the documents as feed files
into its scratch folder and the queries read those.
"""

from pyspark.sql import functions as F

from pressloom.catalog.duplicates import _CASCADE, _verdicts_sql, cascade_parts, history
from pressloom.catalog.registry import query
from pressloom.catalog.views_sql import BATCH, ITEMS, SYND
from pressloom.functions.markup import escape_markup
from pressloom.operators import dedup, stats
from pressloom.plans import ingest
from pressloom.sources import feeds, sample_tables as st, tables
from pressloom.sources.scratch import scratch_path
from pressloom.streaming import feeds as streams, registry_state

AS_OF = st.AS_OF
_LINK = "https://arxiv.org/abs/"


def write_feeds(spark, sf, path=None):
    """Documents as RSS files, one folder per source; odd sources are preprint feeds."""
    path = path or scratch_path(spark, "feeds")
    docs = st.items(spark, sf)
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    preprint = n % 2 == 1
    stamp = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    # Control characters are not allowed in XML.
    plain = lambda c: F.regexp_replace(c, r"[\x00-\x1F\x7F]+", " ")
    number = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("math/"), F.col("doc_id").cast("string"))).otherwise(
        F.concat(F.lit("2401."), F.col("doc_id").cast("string"))
    )
    # Feed elements with their texts; null elements are left out.
    elements = {
        "title": F.concat(F.lit("T"), plain(F.col("title"))),
        "link": F.when(F.col("doc_id") % 13 == 0, F.lit(None)).when(preprint, F.concat(F.lit(_LINK), number)).otherwise(F.col("url")),
        "description": F.concat(F.lit("D"), plain(F.col("content")), F.lit("E")),
        "pubDate": F.when(~preprint, stamp),
        "dc:date": F.when(preprint, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'+01:00'")),
        "dc:creator": F.when(preprint, F.lit("Ann Lee, , Bo Ray ")),
        "author": F.when(~preprint, F.concat(F.lit("desk@"), "source")),
        "guid": F.when(~preprint, F.col("id")),
    }
    texts = [F.concat(F.lit(f"<{n}>"), escape_markup(c), F.lit(f"</{n}>")) for n, c in elements.items()]
    labels = [F.concat(F.lit("<category>"), c, F.lit("</category>")) for c in (F.lit("News"), F.col("source"), F.lit("news"))]
    item = F.concat_ws("", F.lit("<item>"), *texts, *labels, F.lit("</item>"))
    name = F.when(preprint, F.concat(F.lit("arxiv-"), "source")).otherwise(F.col("source"))
    # A feed file holds at most a thousand entries under one root.
    feed_file = docs.select(name.alias("source"), F.floor(F.col("doc_id") / 1000).alias("part"), item.alias("item"))
    whole = F.concat(F.lit("<rss version=\"2.0\"><channel>"), F.array_join(F.collect_list("item"), ""), F.lit("</channel></rss>"))
    feed_file.groupBy("source", "part").agg(whole.alias("value")).write.partitionBy("source", "part").text(path)
    return path


_NOT_XML = r"[\x00-\x1F\x7F]+"
_FEED = f"""{ITEMS},
raw AS (SELECT doc_id, id, source AS s, url, title AS title0, content, published_at, CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 2 = 1 AS preprint FROM items
        WHERE doc_id % 13 <> 0),
feed AS (
  SELECT *, trim('T' || regexp_replace(title0, '{_NOT_XML}', ' ', 'g')) AS title,
         'D' || regexp_replace(content, '{_NOT_XML}', ' ', 'g') || 'E' AS text,
         CASE WHEN preprint THEN 'arxiv-' || s ELSE s END AS source,
         CASE WHEN preprint THEN '{_LINK}' || CASE WHEN doc_id % 4 = 1 THEN 'math/' ELSE '2401.' END || doc_id ELSE url END AS link,
         CASE WHEN preprint THEN published_at - INTERVAL 1 HOUR ELSE published_at END AS pub,
         CASE WHEN NOT preprint THEN 'news|' || s WHEN doc_id % 4 = 1 THEN 'math|arxiv' ELSE 'arxiv|cs.ai' END AS tags
  FROM raw)"""


def entries(spark, sf):
    return feeds.read_feeds(spark, write_feeds(spark, sf))


@query("src1_feed_scan", f"""
WITH {ITEMS} SELECT CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 2 = 1 THEN 'arxiv-' || source ELSE source END AS source,
  count(*) AS n_entries, count(*) FILTER (doc_id % 13 <> 0) AS n_links FROM items GROUP BY 1""")
def _(spark, sf):
    return entries(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n_entries"), F.count("link").alias("n_links"))


@query("src1_fetch_log", f"""
WITH {ITEMS} SELECT CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 2 = 1 THEN 'arxiv-' || source ELSE source END AS source,
  count(DISTINCT doc_id // 1000) AS success_count, 0 AS failure_count, count(*) AS items, count(*) FILTER (doc_id % 13 = 0) AS refused, 0 AS malformed
FROM items GROUP BY 1""")
def _(spark, sf):
    """What one collection of all feeds met, and the statistics per feed that follow from its log."""
    log = feeds.collect_feeds(spark, write_feeds(spark, sf), AS_OF).log
    sums = log.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("items", "refused", "malformed")])
    return stats.feed_stats(log).select("source", "success_count", "failure_count").join(sums, "source")


@query("src2_normalise_standard", f"""
WITH {_FEED} SELECT sha256(link || title) AS id, link AS url, title, source, CAST(pub AS VARCHAR) AS published_at, tags,
  'desk@' || s AS author, id AS guid, text AS content, text AS summary FROM feed WHERE NOT preprint""")
def _(spark, sf):
    items = feeds.normalise_standard(entries(spark, sf).where(~feeds.is_preprint_source()), AS_OF)
    return items.select("id", "url", "title", "source", "published_at", "tags", F.col("metadata")["author"].alias("author"),
                        F.col("metadata")["guid"].alias("guid"), "content", "summary")


@query("src3_normalise_preprint", f"""
WITH {_FEED} SELECT sha256(link || title) AS id, link AS url, title, source, CAST(pub AS VARCHAR) AS published_at, tags,
  'Ann Lee, Bo Ray' AS authors, regexp_extract(link, '/abs/(.*)$', 1) AS arxiv_id,
  CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS summary, sha256(text) AS content_hash FROM feed WHERE preprint""")
def _(spark, sf):
    items = feeds.normalise_preprint(entries(spark, sf).where(feeds.is_preprint_source()), AS_OF)
    return items.select("id", "url", "title", "source", "published_at", "tags", F.col("metadata")["authors"].alias("authors"),
                        F.col("metadata")["arxiv_id"].alias("arxiv_id"), "summary", F.sha2("content", 256).alias("content_hash"))


@query("src4_routing", f"""
WITH {_FEED} SELECT sha256(link || title) AS id, source, CASE WHEN preprint THEN 'preprint' END AS source_type, tags FROM feed""")
def _(spark, sf):
    items = feeds.normalise(entries(spark, sf), AS_OF)
    return items.select("id", "source", F.col("metadata")["source_type"].alias("source_type"), "tags")


@query("src6_append_items", f"""
WITH {BATCH}, one AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY url ORDER BY published_at, id) = 1)
SELECT id, url FROM one WHERE id NOT IN (SELECT id FROM hist) AND url NOT IN (SELECT url FROM hist)""")
def _(spark, sf):
    path = scratch_path(spark, "items")
    old = dedup.dedup_batch(history(spark, sf, tags=True, duplicates=True))
    tables.write_items(tables.as_items(old), path)
    stored = tables.read_items(spark, path)
    new = tables.as_items(st.from_split(st.items_synd(spark, sf, tags=True, duplicates=True)))
    tables.append_items(new, stored, path)
    # What the table now holds beyond the history.
    earlier = tables.as_items(old).select("id")
    return tables.read_items(spark, path).join(earlier, "id", "left_anti").select("id", "url")


@query("src7_reload", f"""
WITH {ITEMS} SELECT id, url, title, content, source, CAST(published_at AS VARCHAR) AS published_at,
  CAST(collected_at AS VARCHAR) AS collected_at, array_to_string(tags, '|') AS tags, is_duplicate, doc_id FROM items""")
def _(spark, sf):
    path = scratch_path(spark, "items")
    key = F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"))
    rows = st.items(spark, sf, tags=True, duplicates=True).withColumn("extra_metadata", key)
    tables.write_items(tables.as_items(rows), path)
    back = tables.as_items(tables.read_items(spark, path))
    return back.select("id", "url", "title", "content", "source", "published_at", "collected_at", "tags", "is_duplicate",
                       F.col("metadata")["doc_id"].cast("long").alias("doc_id"))


def _stored_path(spark, sf):
    path = scratch_path(spark, "items")
    tables.write_items(tables.as_items(st.items(spark, sf, duplicates=True)), path)
    return path


@query("flt2_newest_stored", f"""
WITH {ITEMS} SELECT id, CAST(published_at AS VARCHAR) AS published_at FROM items
WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY AND NOT is_duplicate AND source = 'src3'
ORDER BY items.published_at DESC, id LIMIT 10""")
def _(spark, sf):
    return tables.newest_items(spark, _stored_path(spark, sf), AS_OF, 10, 20, "src3").select("id", "published_at")


@query("ded7_newest_candidates", f"""
WITH {ITEMS} SELECT id, CAST(published_at AS VARCHAR) AS published_at FROM items
WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND NOT is_duplicate ORDER BY items.published_at DESC, id LIMIT 1000""")
def _(spark, sf):
    """The cap of 1,000 newest candidates."""
    return tables.newest_items(spark, _stored_path(spark, sf), AS_OF, 1000, dedup.CANDIDATE_DAYS).select("id", "published_at")


# The whole batch judged, stored items and all that follows from it.
_INGEST = f"""{_CASCADE},
v AS ({_verdicts_sql(False)}),
firsts AS (SELECT n.id, n.url, row_number() OVER (PARTITION BY n.url ORDER BY n.published_at, n.id) AS place
           FROM v JOIN new n ON n.id = v.id WHERE NOT v.is_duplicate),
added AS (SELECT id FROM firsts WHERE place = 1)"""


def outcome(spark, sf):
    new, old, _, cands = cascade_parts(spark, sf, texts=True)
    feed = F.concat(F.lit("src"), (F.col("source").cast("long") % 20).cast("string"))
    log = st.fetch_log(spark, sf).withColumn("source", feed)
    return ingest.ingest(new, old, cands, "run-1", AS_OF, failed=log.where("not ok"), feed_log=log, threshold=0.60)


@query("src8_link_items", f"WITH {_INGEST} SELECT 'run-1' AS run_id, id AS item_id FROM added")
def _(spark, sf):
    return outcome(spark, sf).links


_COUNTS = """(SELECT count(*) FROM new) AS total_items, (SELECT count(*) FROM added) AS new_items,
  (SELECT count(*) FROM new) - (SELECT count(*) FROM added) AS duplicate_items,
  (SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT DISTINCT 'src' || user_id % 20 AS s FROM events WHERE event_type = 'error')) AS failed_sources"""


@query("src9_run_record", f"""
WITH {_INGEST} SELECT 'run-1' AS run_id, 'rss' AS collector_type, '{AS_OF}' AS started_at, '{AS_OF}' AS completed_at, {_COUNTS},
  (SELECT count(DISTINCT user_id % 20) FROM events) AS n_feeds""")
def _(spark, sf):
    run = outcome(spark, sf).run
    feeds_seen = F.size(F.from_json("statistics", "map<string,string>"))
    return run.withColumn("n_feeds", feeds_seen).drop("statistics")


@query("ingest_added_items", f"WITH {_INGEST} SELECT id, n.url, n.title, sha256(n.content) AS content_hash, NULL::VARCHAR AS duplicate_of FROM added JOIN new n USING (id)")
def _(spark, sf):
    added = outcome(spark, sf).added
    return added.select("id", "url", "title", F.sha2("content", 256).alias("content_hash"), "duplicate_of")


@query("ingest_registry_rows", f"""
WITH {_INGEST} SELECT sha256(n.url) AS url_hash, sha256(lower(n.title)) AS title_hash, sha256(lower(n.content)) AS content_hash,
  id AS news_item_id, CAST(n.collected_at AS VARCHAR) AS first_seen_at FROM added JOIN new n USING (id)""")
def _(spark, sf):
    rows = outcome(spark, sf).registry_rows
    return rows.select("url_hash", "title_hash", "content_hash", "news_item_id", "first_seen_at")


@query("src9_run_statistics", """
SELECT 'src' || user_id % 20 AS source, round(count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE, 6) AS success_rate FROM events GROUP BY 1""")
def _(spark, sf):
    run = outcome(spark, sf).run
    per_feed = F.explode(F.from_json("statistics", "map<string,struct<success_rate:double>>")).alias("source", "s")
    return run.select(per_feed).select("source", F.col("s.success_rate").alias("success_rate"))


@query("src9_run_sources", """
SELECT 'run-1' AS run_id, 'src' || user_id % 20 AS source,
  round(count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE, 6) AS success_rate,
  round(coalesce(avg(value) FILTER (event_type <> 'error'), 0.0), 6) AS average_response_time,
  CAST(max(ts) FILTER (event_type <> 'error') AS VARCHAR) AS last_success,
  count(*) FILTER (event_type = 'error') AS failed_fetches FROM events GROUP BY 2""")
def _(spark, sf):
    """Sources of a run as rows, written twice and read back."""
    path, made = scratch_path(spark, "run-sources"), outcome(spark, sf).run_sources
    tables.write_run_sources(tables.write_run_sources(made, path), path)
    return spark.read.schema(made.schema).parquet(path).select(*made.columns)


@query("agg6_failed_sources", """
SELECT CAST(user_id AS VARCHAR) AS source, count(*) AS failed_fetches FROM events WHERE event_type = 'error' GROUP BY 1""")
def _(spark, sf):
    return stats.failed_sources(st.fetch_log(spark, sf).where("not ok"))


@query("agg6_ingest_counters", f"WITH {_INGEST} SELECT {_COUNTS}")
def _(spark, sf):
    return outcome(spark, sf).counters


@query("ingest_verdicts", f"""
WITH {_INGEST} SELECT v.id, v.is_duplicate OR coalesce(f.place, 1) > 1 AS is_duplicate,
  CASE WHEN f.place > 1 THEN 'exact_url' ELSE v.match_type END AS match_type
FROM v LEFT JOIN firsts f ON f.id = v.id""")
def _(spark, sf):
    return outcome(spark, sf).verdicts.select("id", "is_duplicate", "match_type")


@query("collect_from_feeds", f"""
WITH {_FEED}, ids AS (SELECT *, sha256(link || title) AS item_id FROM feed)
SELECT DISTINCT item_id AS id, link AS url, CAST(pub AS VARCHAR) AS published_at FROM ids
WHERE pub > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def _(spark, sf):
    items, _ = ingest.collect(entries(spark, sf), AS_OF)
    return items.select("id", "url", "published_at")


# --- streams --------------------------------------------------------------------------------

def _stream(spark, sf, name):
    # Braces, since a stream takes a file for its source only where it is found by a pattern; the table may be a folder too.
    schema = st.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{name}.parquet}}")


def _run(stream, mode="append"):
    spark = stream.sparkSession
    out = scratch_path(spark, "stream-out")
    streams.run_to_table(stream, out, scratch_path(spark, "stream-state"), mode).awaitTermination()
    return spark.read.parquet(out)


@query("str1_feed_stream", f"""
WITH {_FEED} SELECT sha256(link || title) AS id, source, CAST(pub AS VARCHAR) AS published_at FROM feed""")
def _(spark, sf):
    arriving = feeds.read_feed_stream(spark, write_feeds(spark, sf))
    return _run(feeds.normalise(arriving, AS_OF).select("id", "source", "published_at"))


def synd_stream(spark, sf):
    return synd_items(spark, sf, _stream(spark, sf, "documents"))


def synd_items(spark, sf, docs):
    """Documents as items; exact copies share their id."""
    title = F.substring_index("text", "\n", 1)
    url = F.concat(F.lit("https://example.com/a/"), F.left(F.sha2("text", 256), F.lit(16)))
    at = st.published_at(F.col("doc_id"))
    return docs.select(
        F.sha2(F.concat(url, title), 256).alias("id"), url.alias("url"), title.alias("title"), F.col("text").alias("content"),
        "source", at.alias("published_at"), (at + F.expr("interval 1 hour")).alias("collected_at"),
    )


@query("str2_unique_items", f"WITH {SYND} SELECT DISTINCT id FROM synd")
def _(spark, sf):
    return _run(streams.unique_items(synd_stream(spark, sf).select("id", "published_at")).select("id"))


@query("str3_late_items", f"""
WITH {SYND}, newer AS (SELECT * FROM synd WHERE published_at >= TIMESTAMP '2024-01-24')
SELECT DISTINCT id FROM newer UNION
SELECT DISTINCT id FROM synd WHERE published_at > (SELECT max(published_at) FROM newer) - INTERVAL 14 DAY""")
def _(spark, sf):
    """The newer items arrive first; of the older ones what lies behind the watermark is dropped."""
    items = st.items_synd(spark, sf).select("id", "published_at")
    path, out, state = (scratch_path(spark, n) for n in ("arrivals", "stream-out", "stream-state"))
    for part in (st.from_split(items), st.before_split(items)):
        part.write.mode("append").parquet(path)
        arriving = spark.readStream.schema("id string, published_at timestamp_ntz").parquet(path)
        unique = streams.unique_items(arriving, max_age="14 days").select("id")
        streams.run_to_table(unique, out, state).awaitTermination()
    return spark.read.parquet(out)


@query("str4_item_sink", f"""
WITH {SYND}, f AS (SELECT id, url FROM synd QUALIFY row_number() OVER (PARTITION BY url ORDER BY published_at, id) = 1)
SELECT f.id, f.url, count(*) AS occurrence_count FROM f JOIN synd s ON s.url = f.url GROUP BY 1, 2""")
def _(spark, sf):
    root = scratch_path(spark, "sink")
    sink = streams.item_sink(f"{root}/items", f"{root}/registry")
    stream = synd_stream(spark, sf)
    streams.run_item_stream(stream, sink, f"{root}/state").awaitTermination()
    stored = streams.stored_items(spark, f"{root}/items", stream.schema)
    counts = streams.registry_now(spark, f"{root}/registry").select("url_hash", "occurrence_count")
    return stored.withColumn("url_hash", F.sha2("url", 256)).join(counts, "url_hash").select("id", "url", "occurrence_count")


@query("ded13_registry_stream", f"""
WITH {SYND}, l AS (SELECT max(collected_at) FILTER (published_at < TIMESTAMP '2024-01-24') - INTERVAL 10 DAY AS between_runs,
                          max(collected_at) - INTERVAL 10 DAY AS at_end FROM synd),
old AS (SELECT url, max(collected_at) AS seen FROM synd WHERE published_at < TIMESTAMP '2024-01-24' GROUP BY 1),
live AS (SELECT s.* FROM synd s LEFT JOIN old USING (url) CROSS JOIN l
         WHERE s.published_at >= TIMESTAMP '2024-01-24' OR old.seen >= l.between_runs)
SELECT sha256(url) AS url_hash, arg_min(id, {{'c': collected_at, 'i': id}}) AS news_item_id, CAST(min(collected_at) AS VARCHAR) AS first_seen_at,
       CAST(max(collected_at) AS VARCHAR) AS last_seen_at, count(*) AS occurrence_count
FROM live GROUP BY url HAVING max(collected_at) >= (SELECT at_end FROM l)""")
def _(spark, sf):
    """Older items arrive first, then the newer ones in a new run from the same checkpoint; keys live ten days."""
    items = synd_items(spark, sf, st.table(spark, sf, "documents"))
    path, state = (scratch_path(spark, n) for n in ("arrivals", "stream-state"))
    for part in (st.before_split(items), st.from_split(items)):
        part.write.mode("append").parquet(path)
        arriving = spark.readStream.schema(items.schema).parquet(path)
        registry_state.keep_registry(arriving, state, 10).awaitTermination()
    return registry_state.live_registry(spark, state).select(
        "url_hash", "news_item_id", "first_seen_at", "last_seen_at", "occurrence_count"
    )


@query("str5_counts_by_day", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n_items FROM events
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""")
def _(spark, sf):
    return _run(streams.counts_by_day(_stream(spark, sf, "events"), "event_type", "1 day", "ts"))
