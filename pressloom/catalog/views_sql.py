"""The sample views as SQL, for the counterparts that run outside Spark."""

_PUBLISHED = "TIMESTAMP '2024-01-01' + to_minutes(CAST((d.doc_id * 7919) % 43200 AS BIGINT))"
_TAGS = (
    "list_filter([CASE WHEN l.quality = 1 THEN 'ai' END, CASE WHEN l.toxic = 1 THEN 'security' END, d.lang], "
    "lambda x: x IS NOT NULL)"
)


def _items(name: str, url: str) -> str:
    return f"""{name} AS (
  SELECT doc_id, url, title, sha256(url || title) AS id, content, '' AS summary, source, published_at,
         published_at + INTERVAL 1 HOUR AS collected_at, tags, is_duplicate,
         source AS feed_pos, doc_id AS entry_pos
  FROM (SELECT d.doc_id, {url} AS url, split_part(d.text, chr(10), 1) AS title,
               d.text AS content, d.source, {_PUBLISHED} AS published_at, {_TAGS} AS tags,
               row_number() OVER (PARTITION BY d.text ORDER BY d.doc_id) > 1 AS is_duplicate
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id))"""


ITEMS = _items("items", "'https://' || d.source || '.example.com/a/' || CAST(d.doc_id AS VARCHAR)")
SYND = _items("synd", "'https://example.com/a/' || substr(sha256(d.text), 1, 16)")

# The batch holds one row per id; the history holds all rows before the split.
BATCH = f"""{SYND},
batch AS (SELECT * FROM synd WHERE published_at >= TIMESTAMP '2024-01-24'
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY feed_pos, entry_pos) = 1),
hist AS (SELECT * FROM synd WHERE published_at < TIMESTAMP '2024-01-24')"""

RUNS = """runs AS (
  SELECT event_id AS run_id, event_type AS collector_type, ts AS started_at,
         CASE WHEN event_id % 10 <> 0 THEN ts + to_seconds(CAST(floor(value) AS BIGINT)) END AS completed_at,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS total_items
  FROM events)"""

FETCH_LOG = """fetch_log AS (
  SELECT CAST(user_id AS VARCHAR) AS source, ts AS started_at, event_type <> 'error' AS ok,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS items, value AS elapsed_s
  FROM events)"""

TASK_RUNS = """task_runs AS (
  SELECT 'task' || CAST(user_id % 4 AS VARCHAR) AS task, ts AS started_at, event_id AS run_id,
         event_type <> 'error' AS ok,
         CASE WHEN event_type = 'error' THEN 'err ' || json_extract_string(props, '$.k') END AS error
  FROM events)"""

SETTINGS = """settings_kv AS (
  SELECT doc_id AS row_id,
         CASE doc_id % 3 WHEN 0 THEN 'cfg.api_key' WHEN 1 THEN 'cfg.auth.token' ELSE 'cfg.endpoint' END AS path,
         CASE WHEN doc_id % 7 = 0 THEN '${ENV}' ELSE substr(sha256(text), 1, CAST(20 + doc_id % 40 AS INT)) END AS value
  FROM documents)"""

VECS = f"""{ITEMS},
vecs AS (SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS v, i.id, i.url, i.source, i.published_at
         FROM embeddings e LEFT JOIN items i ON i.doc_id = e.vec_id)"""

# Pool of a period, its scores, and the capped ranking.
_HOURS = "(epoch(ref) - epoch(published_at)) / 3600.0"


def ranked(kind: str, limit: int, cap: int) -> str:
    period = "CAST(published_at AS DATE)" if kind == "daily" else "CAST(date_trunc('week', published_at) AS DATE)"
    days = 0 if kind == "daily" else 7
    return f"""{ITEMS},
pool AS (SELECT *, {period} AS period FROM items WHERE NOT is_duplicate),
signals AS (
  SELECT *, CAST(period AS TIMESTAMP) + to_days({days}) AS ref,
         least(1.0, len(list_filter(tags, lambda t: t IN ('breaking','important','security','ai','technology'))) / 2.0) AS relevance,
         CASE WHEN length(content) < 100 THEN 0.1 WHEN length(content) < 500 THEN 0.5
              WHEN length(content) < 2000 THEN 1.0 ELSE 0.8 END AS length_score,
         count(*) OVER (PARTITION BY period, source) AS source_items
  FROM pool),
parts AS (
  SELECT *, exp(-({_HOURS}) / 24.0) AS recency, 1.0 / (1.0 + ln(CAST(source_items AS DOUBLE))) AS diversity FROM signals),
scored AS (
  SELECT *, CAST(0.3 AS DOUBLE) * recency + CAST(0.3 AS DOUBLE) * relevance
            + CAST(0.2 AS DOUBLE) * length_score + CAST(0.2 AS DOUBLE) * diversity AS score FROM parts),
capped AS (
  SELECT *, row_number() OVER (PARTITION BY period, source ORDER BY score DESC, published_at DESC, id) AS source_rank
  FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, published_at DESC, id) AS rank
  FROM capped WHERE source_rank <= {cap} QUALIFY rank <= {limit})"""


DAILY = ranked("daily", 20, 3)
WEEKLY = ranked("weekly", 50, 5)

CATEGORY = """CASE
  WHEN len(tags) = 0 THEN 'general'
  WHEN tags[1] IN ('ai','ml','machine-learning','artificial-intelligence') THEN 'ai'
  WHEN tags[1] IN ('security','cybersecurity','vulnerability') THEN 'security'
  WHEN tags[1] IN ('tech','technology','software','hardware') THEN 'technology'
  WHEN tags[1] IN ('science','research','study') THEN 'science'
  WHEN tags[1] IN ('business','finance','economy') THEN 'business'
  ELSE tags[1] END"""

CATEGORISED = f"""{DAILY},
categorised AS (SELECT *, {CATEGORY} AS category, min(rank) OVER (PARTITION BY period, {CATEGORY}) AS category_first_rank FROM ranked)"""

BY_DAY = f"""{WEEKLY},
by_day AS (
  SELECT *, CAST(published_at AS DATE) AS day, strftime(published_at, '%A, %B %d') AS day_label,
         min(rank) OVER (PARTITION BY period, CAST(published_at AS DATE)) AS day_first_rank,
         row_number() OVER (PARTITION BY period, CAST(published_at AS DATE) ORDER BY rank) AS day_rank
  FROM ranked)"""
