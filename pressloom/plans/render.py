"""Digest texts. One row per period, put together from at most a few dozen item blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions.markup import escape_markup
from pressloom.functions.text import title_case

FOOTER = "Generated automatically"


def _lines(*parts: Column | str) -> Column:
    """Join by line breaks; null parts are left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _published() -> Column:
    return F.date_format("published_at", "yyyy-MM-dd HH:mm")


def _score() -> Column:
    return F.format_string("%.2f", F.col("score"))


def item_markdown(compact: bool = False) -> Column:
    """Title with link, a line of facts, then the summary or a preview."""
    facts = F.concat_ws(
        " | ",
        F.concat(F.lit("**Source:** "), F.col("source")),
        F.concat(F.lit("**Published:** "), _published()),
        F.when(F.size("tags") > 0, F.concat(F.lit("**Tags:** "), F.array_join("tags", ", "))),
        *([] if compact else [F.concat(F.lit("**Relevance:** "), _score())]),
    )
    body = F.when(F.col("summary") != "", F.col("summary"))
    if not compact:
        body = F.coalesce(body, F.col("preview"))
    title = F.concat(F.lit("### ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")"))
    return _lines(title, facts, "", body, "")


def item_html(compact: bool = False) -> Column:
    """The same content as markup, with all texts escaped."""
    esc = lambda c: escape_markup(F.col(c) if isinstance(c, str) else c)
    span = lambda name, v: F.concat(F.lit(f"<span><strong>{name}:</strong> "), v, F.lit("</span>"))
    parts = [
        F.lit('<div class="article"><h3><a href="'), esc("url"), F.lit('">'), esc("title"), F.lit("</a></h3>"),
        F.lit('<div class="meta">'), span("Source", esc("source")), span("Published", _published()),
    ]
    if not compact:
        parts.append(span("Relevance", _score()))
    tag_spans = F.array_join(
        F.transform("tags", lambda t: F.concat(F.lit('<span class="tag">'), escape_markup(t), F.lit("</span>"))), ""
    )
    parts += [
        F.lit("</div>"),
        F.when(F.size("tags") > 0, F.concat(F.lit('<div class="tags">'), tag_spans, F.lit("</div>"))).otherwise(""),
    ]
    if not compact:
        text = F.when(F.col("summary") != "", F.col("summary")).otherwise(F.col("preview"))
        parts.append(F.when(text != "", F.concat(F.lit("<p>"), escape_markup(text), F.lit("</p>"))).otherwise(""))
    return F.concat(*parts, F.lit("</div>"))


def _sections(ranked: DataFrame, place: Column, heading: Column, first: Column, block: Column, sep: str) -> DataFrame:
    """Item blocks of a period in order, each section opened by its heading."""
    text = F.when(first, F.concat(heading, F.lit(sep), block)).otherwise(block)
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("g"), F.col("rank"), text.alias("t"))))
    return ranked.groupBy("period").agg(
        F.array_join(F.transform(ordered, lambda s: s["t"]), sep).alias("sections"),
    )


def render_daily(ranked: DataFrame, facts: DataFrame, html: bool = False, footer: str = FOOTER) -> DataFrame:
    """``period, content`` from ranked items with categories and the facts of each digest."""
    first = F.col("rank") == F.col("category_first_rank")
    place, name = F.col("category_first_rank"), title_case(F.col("category"))
    day = F.date_format("period", "yyyy-MM-dd")
    count = F.col("item_count").cast("string")
    if html:
        heading = F.concat(F.lit("<h2>"), escape_markup(name), F.lit("</h2>"))
        body = _sections(ranked, place, heading, first, item_html(), "")
        listed = lambda c: escape_markup(F.array_join(c, ", "))
        head = F.concat(
            F.lit('<!DOCTYPE html><html><head><meta charset="UTF-8"><title>Daily News Digest - '), day,
            F.lit("</title></head><body><h1>Daily News Digest - "), day, F.lit("</h1>"),
            F.lit('<div class="summary"><strong>Total items:</strong> '), count,
            F.lit("<br><strong>Sources:</strong> "), listed("sources"),
            F.lit("<br><strong>Categories:</strong> "), listed("categories"), F.lit("</div>"),
        )
        content = F.concat(head, F.col("sections"), _html_end(footer))
    else:
        body = _sections(ranked, place, F.concat(F.lit("## "), name, F.lit("\n")), first, item_markdown(), "\n")
        content = _lines(
            F.concat(F.lit("# Daily News Digest - "), day), "",
            F.concat(F.lit("**Total items:** "), count),
            F.concat(F.lit("**Sources:** "), F.array_join("sources", ", ")),
            F.concat(F.lit("**Categories:** "), F.array_join("categories", ", ")),
            "", "---", "", F.col("sections"), *_markdown_end(footer),
        )
    return facts.join(body, "period").select("period", content.alias("content"))


def render_weekly(
    ranked: DataFrame, facts: DataFrame, html: bool = False, footer: str = FOOTER
) -> DataFrame:
    """``period, content`` from ranked items with days and the facts of each week.

    ``facts`` carries ``item_count``, ``total_collected``, ``sources_count`` and
    ``topics`` (list of topic and count).
    """
    shown = ranked.where("shown")
    first, place = F.col("day_rank") == 1, F.col("day_first_rank")
    start = F.date_format("period", "yyyy-MM-dd")
    end = F.date_format(F.date_add("period", 7), "yyyy-MM-dd")
    number = lambda c: F.col(c).cast("string")
    has_topics = F.size("topics") > 0
    if html:
        heading = F.concat(F.lit("<h3>"), F.col("day_label"), F.lit("</h3>"))
        body = _sections(shown, place, heading, first, item_html(compact=True), "")
        rows = F.array_join(F.transform("topics", lambda t: F.concat(
            F.lit('<div class="topic-item">'), escape_markup(title_case(t["topic"])),
            F.lit('<span class="topic-count">'), t["n_items"].cast("string"), F.lit("</span></div>"),
        )), "")
        content = F.concat(
            F.lit('<!DOCTYPE html><html><head><meta charset="UTF-8"><title>Weekly News Summary</title></head><body>'),
            F.lit('<h1>Weekly News Summary</h1><div class="period">Period: '), start, F.lit(" to "), end, F.lit("</div>"),
            F.lit('<h2>Overview</h2><div class="overview"><strong>Selected stories:</strong> '), number("item_count"),
            F.lit("<br><strong>Total collected:</strong> "), number("total_collected"),
            F.lit("<br><strong>Active sources:</strong> "), number("sources_count"), F.lit("</div>"),
            F.when(has_topics, F.concat(F.lit('<h2>Top Topics This Week</h2><div class="topics">'), rows, F.lit("</div>"))).otherwise(""),
            F.lit("<h2>Top Stories</h2>"), F.col("sections"), _html_end(footer),
        )
    else:
        heading = F.concat(F.lit("### "), F.col("day_label"), F.lit("\n"))
        body = _sections(shown, place, heading, first, item_markdown(compact=True), "\n")
        rows = F.array_join(F.transform("topics", lambda t: F.concat(
            F.lit("- **"), t["topic"], F.lit("**: "), t["n_items"].cast("string"), F.lit(" articles"))), "\n")
        content = _lines(
            "# Weekly News Summary",
            F.concat(F.lit("**Period:** "), start, F.lit(" to "), end), "",
            "## Overview",
            F.concat(F.lit("- **Total items:** "), number("item_count")),
            F.concat(F.lit("- **Total collected this week:** "), number("total_collected")),
            F.concat(F.lit("- **Active sources:** "), number("sources_count")), "",
            F.when(has_topics, _lines("## Top Topics This Week", rows, "")),
            "## Top Stories", "", F.col("sections"), *_markdown_end(footer),
        )
    return facts.join(body, "period").select("period", content.alias("content"))


def _markdown_end(footer: str) -> list[str]:
    return ["---", "", f"*{footer}*"]


def _html_end(footer: str) -> Column:
    return F.lit(f'<div class="footer"><p>{footer}</p></div></body></html>')
