"""Item validation: clean what can be cleaned, set aside what cannot be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import text, urls
from pressloom.schemas import ITEM_STATUSES


def audit_urls(df: DataFrame, url: str = "url") -> DataFrame:
    reason = urls.url_reject_reason(F.col(url))
    return df.withColumns({"reject_reason": reason, "is_valid": reason.isNull()})


TEXTS = ("title", "content", "summary")


def checked_items(items: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Sanitised url, cleaned text columns where present, and the audit columns.

    Texts stay whole; ``limits`` may name the length at which to cut a column.
    """
    out = items.withColumn("url", urls.sanitize_url(F.col("url")))
    cleaned = {n: text.clean_text(F.col(n), (limits or {}).get(n)) for n in TEXTS if n in items.columns}
    return audit_urls(out.withColumns(cleaned))


def validate_items(items: DataFrame, limits: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable items, refused items with ``reject_reason``)."""
    checked = checked_items(items, limits)
    good = checked.where("is_valid").drop("is_valid", "reject_reason")
    return good, checked.where("not is_valid").drop("is_valid")


def is_status(c: Column) -> Column:
    """Whether a text is one of the known item statuses."""
    return F.coalesce(c.isin(*ITEM_STATUSES), F.lit(False))
