"""Ranking signals and categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.functions.dates import seconds_between

# Tags that raise relevance.
IMPORTANT_TAGS = ("breaking", "important", "security", "ai", "technology")

# First tag -> category; any other tag is its own category.
CATEGORY_OF_TAG = {
    "ai": "ai", "ml": "ai", "machine-learning": "ai", "artificial-intelligence": "ai",
    "security": "security", "cybersecurity": "security", "vulnerability": "security",
    "tech": "technology", "technology": "technology", "software": "technology",
    "hardware": "technology",
    "science": "science", "research": "science", "study": "science",
    "business": "business", "finance": "business", "economy": "business",
}
UNTAGGED = "general"


@dataclass(frozen=True)
class Weights:
    """Relative weights of the four signals; used in proportion to their sum."""

    recency: float = 0.3
    diversity: float = 0.2
    relevance: float = 0.3
    length: float = 0.2

    def shares(self) -> "Weights":
        total = self.recency + self.diversity + self.relevance + self.length
        return Weights(
            self.recency / total, self.diversity / total, self.relevance / total, self.length / total
        )


def recency(published: Column, reference: Column) -> Column:
    """Exponential decay by age with a time constant of one day; not clamped."""
    hours = seconds_between(reference, published) / 3600
    return F.exp(-hours / 24)


def relevance(tags: Column, important: tuple[str, ...] = IMPORTANT_TAGS) -> Column:
    """Half a point per important tag, at most one."""
    wanted = F.array(*[F.lit(t) for t in important])
    hits = F.coalesce(F.size(F.array_intersect(tags, wanted)), F.lit(0))
    return F.least(F.lit(1.0), hits / F.lit(2))


def length_score(chars: Column) -> Column:
    """Prefer texts of 500 to 1999 characters."""
    return F.when(chars < 100, 0.1).when(chars < 500, 0.5).when(chars < 2000, 1.0).otherwise(0.8)


def diversity(items_of_source: Column) -> Column:
    return 1.0 / (1 + F.log(items_of_source.cast("double")))


def category(tags: Column) -> Column:
    first = F.lower(F.try_element_at(tags, F.lit(1)))
    pairs = [F.lit(x) for kv in CATEGORY_OF_TAG.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), first), first, F.lit(UNTAGGED))
