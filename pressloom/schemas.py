"""Schemas of the persisted tables. Timestamps are zone-free and always UTC."""

from pyspark.sql import types as T

_NTZ = T.TimestampNTZType()
_TEXT = T.StringType()
_TAGS = T.ArrayType(_TEXT)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


ITEM_SCHEMA = _struct(
    id=_TEXT, url=_TEXT, title=_TEXT, content=_TEXT, summary=_TEXT, source=_TEXT,
    published_at=_NTZ, collected_at=_NTZ, tags=_TAGS, metadata=T.MapType(_TEXT, _TEXT),
    is_duplicate=T.BooleanType(), duplicate_of=_TEXT,
)

RUN_SCHEMA = _struct(
    run_id=_TEXT, collector_type=_TEXT, started_at=_NTZ, completed_at=_NTZ,
    total_items=T.LongType(), new_items=T.LongType(), duplicate_items=T.LongType(),
    failed_sources=_TAGS, statistics=_TEXT,
)

RUN_ITEM_SCHEMA = _struct(run_id=_TEXT, item_id=_TEXT)

DAILY_SCHEMA = _struct(
    digest_date=T.DateType(), item_count=T.LongType(), total_collected=T.LongType(),
    sources=_TAGS, categories=_TAGS, content_markdown=_TEXT, content_html=_TEXT,
    is_sent=T.BooleanType(), sent_at=_NTZ, created_at=_NTZ,
)

WEEKLY_SCHEMA = _struct(
    week_start=T.DateType(), week_end=T.DateType(), item_count=T.LongType(),
    total_collected=T.LongType(), sources_count=T.LongType(), top_topics=_TAGS,
    content_markdown=_TEXT, content_html=_TEXT,
    is_sent=T.BooleanType(), sent_at=_NTZ, created_at=_NTZ,
)

ENTRY_SCHEMA = _struct(
    digest_kind=_TEXT, period_start=T.DateType(), item_id=_TEXT, ranking_score=T.DoubleType(),
)

REGISTRY_SCHEMA = _struct(
    url_hash=_TEXT, title_hash=_TEXT, content_hash=_TEXT, news_item_id=_TEXT,
    first_seen_at=_NTZ, last_seen_at=_NTZ, occurrence_count=T.LongType(),
)

EMBEDDING_CACHE_SCHEMA = _struct(
    cache_key=_TEXT, embedding=T.ArrayType(T.FloatType()), created_at=_NTZ,
)

# The status words an item may carry.
ITEM_STATUSES = ("new", "duplicate", "processed", "failed")
