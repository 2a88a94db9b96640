"""Identity and lookup hashes (hex SHA-256)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def item_id(url: Column, title: Column) -> Column:
    return F.sha2(F.concat(url, title), 256)


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def title_hash(title: Column) -> Column:
    return F.sha2(F.lower(title), 256)


def content_hash(content: Column, prefix: int | None = None) -> Column:
    """Of the whole content, or of its first ``prefix`` characters."""
    return F.sha2(F.lower(content if prefix is None else F.substring(content, 1, prefix)), 256)


def cache_key(text: Column, model: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}:"), text), 256)
