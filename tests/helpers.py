"""Small tables for tests."""

from datetime import datetime, timedelta

AS_OF = "2024-01-31 00:00:00"
ITEM = (
    "id string, url string, title string, content string, summary string, source string, "
    "published_at timestamp_ntz, collected_at timestamp_ntz, tags array<string>, metadata map<string,string>, "
    "is_duplicate boolean, duplicate_of string"
)


def when(text: str) -> datetime:
    return datetime.fromisoformat(text)


def item(key: str, **over):
    row = dict(
        id=key, url=f"https://x.org/{key}", title=f"Title {key}", content="c" * 600, summary="", source="s",
        published_at=when("2024-01-30 10:00:00"), collected_at=when("2024-01-30 11:00:00"), tags=["ai"], metadata={},
        is_duplicate=False, duplicate_of=None,
    )
    return {**row, **over}


def items(spark, *rows):
    from pyspark.sql.types import Row

    names = [c.strip().split(" ")[0] for c in ITEM.replace("map<string,string>", "m").split(",")]
    return spark.createDataFrame([Row(**{n: r[n] for n in names}) for r in rows], ITEM)


def days_before(n: float) -> datetime:
    return when(AS_OF) - timedelta(days=n)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]
