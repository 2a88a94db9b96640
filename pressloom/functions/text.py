"""Text columns: cleaning, previews, masking, tag normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four separator controls that str.strip() also removes.
_SPACE = r"[\s\x1C-\x1F]"
# The look-behind starts a match only where a run starts, which keeps long runs linear.
_EDGES = rf"(?U)^{_SPACE}+|(?<!{_SPACE}){_SPACE}+$"
_CONTROLS = r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]"

# Lengths at which a caller may cut titles, contents and summaries.
MAX_TITLE = 500
MAX_CONTENT = 50_000
MAX_SUMMARY = 1_000


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, _EDGES, "")


def truncated(c: Column, limit: int) -> Column:
    """First ``limit`` characters, with an ellipsis when something was cut."""
    return F.concat(F.substring(c, 1, limit), F.when(F.length(c) > limit, "...").otherwise(""))


def clean_text(c: Column, limit: int | None = None) -> Column:
    """Drop control characters, collapse white space, cut to ``limit`` if there is one; null becomes ''."""
    visible = F.regexp_replace(F.coalesce(c, F.lit("")), _CONTROLS, "")
    clean = F.trim(F.regexp_replace(visible, r"(?U)\s+", " "))
    return clean if limit is None else truncated(clean, limit)


def preview(c: Column, limit: int = 200) -> Column:
    return truncated(F.coalesce(c, F.lit("")), limit)


def mask(c: Column, shown: int = 4) -> Column:
    """Show the first characters of a secret and star out the rest."""
    hidden = F.repeat(F.lit("*"), (F.length(c) - shown).cast("int"))
    return F.when(F.length(c) > shown, F.concat(F.substring(c, 1, shown), hidden)).otherwise(F.lit("***"))


def clean_tags(c: Column) -> Column:
    """Lower-case, trim, drop blanks, keep first occurrences; null becomes []."""
    tidy = F.transform(F.filter(c, lambda t: t.isNotNull()), lambda t: strip(F.lower(t)))
    return F.coalesce(F.array_distinct(F.filter(tidy, lambda t: t != "")), F.array().cast("array<string>"))


def title_case(c: Column) -> Column:
    """Capitalise every run of letters, also after '-' or '.'."""
    runs = F.split(c, r"(?<=\P{L})")
    capital = F.transform(
        runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.right(r, F.length(r) - 1)))
    )
    return F.array_join(capital, "")


def similarity_text(title: Column, content: Column, domain: Column, limit: int | None = None) -> Column:
    """The text that represents an item for semantic comparison; ``limit`` cuts the content."""
    return F.concat(
        F.lit("Title: "), title,
        F.lit("\n\nContent: "), content if limit is None else truncated(content, limit),
        F.lit("\n\nSource: "), domain,
    )
