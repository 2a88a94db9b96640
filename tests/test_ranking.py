"""Ranking against a plain Python ranking, and the digest products."""

import math
import random
from collections import Counter
from datetime import timedelta

import pytest
from helpers import AS_OF, item, items, rows, when
from pyspark.sql import functions as F

from pressloom.functions.scoring import IMPORTANT_TAGS, Weights
from pressloom.operators import filters, ranking, stats
from pressloom.plans import digests


def plain_ranking(all_items, reference, limit, cap, w=Weights()):
    w = w.shares()
    sizes = Counter(i["source"] for i in all_items)
    scored = []
    for i in all_items:
        n = len(i["content"])
        base = (w.recency * math.exp(-((reference - i["published_at"]).total_seconds() / 3600) / 24)
                + w.relevance * min(1.0, len(set(i["tags"]) & set(IMPORTANT_TAGS)) / 2)
                + w.length * (0.1 if n < 100 else 0.5 if n < 500 else 1.0 if n < 2000 else 0.8))
        total = base + w.diversity * (1.0 / (1 + math.log(sizes[i["source"]])))
        scored.append((-total, -base, -i["published_at"].timestamp(), i["id"], i["source"]))
    taken, out = Counter(), []
    for s in sorted(scored):
        if taken[s[4]] < cap and len(out) < limit:
            taken[s[4]] += 1
            out.append((s[3], round(-s[0], 9)))
    return out


def random_items(n, seed, hot=0.34):
    rnd = random.Random(seed)
    return [item(
        f"i{j:03d}", source="hot" if rnd.random() < hot else f"s{rnd.randrange(6)}",
        content="c" * rnd.choice([50, 300, 900, 3000]), tags=rnd.sample(["ai", "security", "en", "x"], rnd.randrange(4)),
        published_at=when("2024-01-15 00:00:00") + timedelta(minutes=rnd.randrange(14 * 1440)),
    ) for j in range(n)]


@pytest.mark.parametrize("limit, cap", [(20, 3), (5, 1), (7, 100), (0, 3), (5, 0)])
@pytest.mark.parametrize("kind", ["daily", "weekly"])
def test_rank_like_the_plain_ranking(spark, kind, limit, cap):
    data = random_items(200, seed=limit * 7 + cap)
    df = filters.in_period(items(spark, *data), kind)
    got = {}
    for r in ranking.rank_items(df, kind, limit, cap).orderBy("period", "rank").collect():
        got.setdefault(r.period, []).append((r.id, round(r.score, 9)))
    expected = {}
    for i in data:
        day = i["published_at"].date()
        expected.setdefault(day if kind == "daily" else day - timedelta(days=day.weekday()), []).append(i)
    for period, members in expected.items():
        start = when(f"{period} 00:00:00")
        reference = start if kind == "daily" else start + timedelta(days=7)
        assert got.get(period, []) == plain_ranking(members, reference, limit, cap)


def test_rank_sends_no_whole_source_through_a_shuffle(spark):
    df = filters.in_period(items(spark, *random_items(20, 1)), "daily")
    plan = ranking.rank_items(df, "daily")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and "content" not in "".join(exchanged)


def test_custom_weights_and_tags(spark):
    data = [item("a", tags=["zebra"], published_at=when("2024-01-15 01:00:00")), item("b", tags=["ai"], published_at=when("2024-01-15 02:00:00"))]
    df = filters.in_period(items(spark, *data), "daily")
    only = ranking.rank_items(df, "daily", weights=Weights(0, 0, 1, 0), important=("zebra",)).orderBy("rank")
    assert [(r.id, r.score) for r in only.collect()] == [("a", 0.5), ("b", 0.0)]


def test_score_items_covers_everything(spark):
    df = filters.in_period(items(spark, *random_items(50, 3)), "weekly")
    assert ranking.score_items(df, "weekly").count() == 50


def test_categories_follow_first_appearance(spark):
    ranked = spark.createDataFrame([(1, 1, "a", ["security"]), (1, 2, "b", []), (1, 3, "c", ["vulnerability"])],
                                   "period int, rank int, id string, tags array<string>")
    got = rows(ranking.with_category(ranked).select("id", "category", "category_first_rank"), "id")
    assert got == [("a", "security", 1), ("b", "general", 2), ("c", "security", 1)]


def test_days_in_order_of_first_appearance_five_shown(spark):
    data = [(1, n, f"i{n}", when("2024-01-16 10:00:00") if n != 1 else when("2024-01-18 00:00:00")) for n in range(1, 9)]
    df = spark.createDataFrame(data, "period int, rank int, id string, published_at timestamp_ntz")
    got = ranking.with_day(df).orderBy("rank").collect()
    assert [r.day_first_rank for r in got][:3] == [1, 2, 2]
    assert got[0].day_label == "Thursday, January 18"
    assert [r.shown for r in got] == [True] * 6 + [False] * 2


def test_entry_scores_count_down(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "period int, rank int, id string")
    assert rows(ranking.digest_entries(ranked, "daily").select("item_id", "ranking_score"), "item_id") == [("a", 2.0), ("b", 1.0), ("c", 1.0)]


def test_top_topics(spark):
    df = items(spark, item("a", tags=["x", "y"]), item("b", tags=["y", "z"]), item("c", tags=[]))
    assert rows(stats.top_topics(df, 2)) == [("y", 2), ("x", 1)]


# --- digests --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def two_days(spark):
    at = lambda t: when(f"2024-01-{t}:00")
    return items(
        spark,
        item("a", title="A & B", source="s1", tags=["ai", "en"], published_at=at("16 09:00"), summary="Short <b>."),
        item("b", title="Bees", source="s2", tags=["machine-learning.x"], published_at=at("16 08:00"), content="b" * 250),
        item("c", title="Cats", source="s1", tags=["ai"], published_at=at("17 07:00"), content="short"),
        item("d", title="Dup", source="s1", published_at=at("17 08:00"), is_duplicate=True),
    ).cache()


def test_daily_markdown(spark, two_days):
    made = digests.daily_digests(two_days, AS_OF)
    got = {str(r.digest_date): r for r in made.records.collect()}
    assert list(sorted(got)) == ["2024-01-16", "2024-01-17"]
    first = got["2024-01-16"]
    lines = first.content_markdown.split("\n")
    assert lines[:8] == ["# Daily News Digest - 2024-01-16", "", "**Total items:** 2", "**Sources:** s1, s2",
                         "**Categories:** ai, machine-learning.x", "", "---", ""]
    assert lines[8:14] == ["## Ai", "", "### [A & B](https://x.org/a)",
                           lines[11], "", "Short <b>."]
    assert lines[11].startswith("**Source:** s1 | **Published:** 2024-01-16 09:00 | **Tags:** ai, en | **Relevance:** ")
    assert lines[14:17] == ["", "## Machine-Learning.X", ""]
    assert lines[20] == "b" * 200 + "..."
    assert lines[-3:] == ["---", "", "*Generated automatically*"]
    assert "A &amp; B" in first.content_html and "Short &lt;b&gt;." in first.content_html
    assert (got["2024-01-17"].item_count, got["2024-01-17"].total_collected) == (1, 1)
    assert (first.is_sent, first.sent_at, first.created_at) == (False, None, when(AS_OF))
    assert rows(made.entries.select("item_id", "ranking_score"), "item_id") == [("a", 2.0), ("b", 1.0), ("c", 1.0)]


def test_weekly_markdown(spark, two_days):
    made = digests.weekly_summaries(two_days, AS_OF)
    (week,) = made.records.collect()
    assert (str(week.week_start), str(week.week_end), week.item_count, week.total_collected, week.sources_count) == (
        "2024-01-15", "2024-01-22", 3, 3, 2)
    assert week.top_topics == ["ai", "en", "machine-learning.x"]
    lines = week.content_markdown.split("\n")
    assert lines[:8] == ["# Weekly News Summary", "**Period:** 2024-01-15 to 2024-01-22", "", "## Overview", "- **Total items:** 3",
                         "- **Total collected this week:** 3", "- **Active sources:** 2", ""]
    assert lines[8:13] == ["## Top Topics This Week", "- **ai**: 2 articles", "- **en**: 1 articles", "- **machine-learning.x**: 1 articles", ""]
    assert lines[13:15] == ["## Top Stories", ""]
    assert "Relevance" not in week.content_markdown and "b" * 100 not in week.content_markdown
    assert week.content_html.count("<h3>") == 2 + 3


def test_bounds_select_periods(spark, two_days):
    only = digests.daily_digests(two_days, AS_OF, "2024-01-17", "2024-01-17")
    assert [str(r.digest_date) for r in only.records.collect()] == ["2024-01-17"]


def test_no_items_no_digest(spark, two_days):
    none = two_days.where("false")
    assert digests.daily_digests(none, AS_OF).records.count() == 0
    assert digests.weekly_summaries(none, AS_OF).records.count() == 0


def test_merge_mark_and_unsent(spark, two_days):
    made = digests.daily_digests(two_days, AS_OF)
    old = digests.mark_sent(
        made.records.where("digest_date = '2024-01-16'").withColumn("item_count", F.lit(99).cast("long")),
        made.records.where("digest_date = '2024-01-16'"), "digest_date", "2024-02-01 00:00:00")
    kept = digests.merge_digests(old, made.records, "digest_date")
    assert rows(kept.select("item_count", "is_sent"), "digest_date") == [(99, True), (1, False)]
    forced = digests.merge_digests(old, made.records, "digest_date", force=True)
    assert rows(forced.select("item_count", "is_sent", "sent_at"), "digest_date") == [(2, True, when("2024-02-01 00:00:00")), (1, False, None)]
    weekly = digests.weekly_summaries(two_days, AS_OF).records
    open_ones = filters.unsent(forced, weekly)
    assert [(k, str(p)) for k, p, _ in rows(open_ones, "digest_kind")] == [("daily", "2024-01-17"), ("weekly", "2024-01-15")]
    assert filters.digest_for(forced, "digest_date", "2024-01-16").count() == 1


def test_merge_entries(spark):
    schema = "digest_kind string, period_start date, item_id string, ranking_score double"
    make = lambda *ids: spark.createDataFrame([("daily", when(f"2024-01-{d}").date(), i, 1.0) for d, i in ids], schema)
    stored, made = make(("16", "old")), make(("16", "new"), ("17", "x"))
    assert [r.item_id for r in digests.merge_entries(stored, made).orderBy("item_id").collect()] == ["old", "x"]
    assert [r.item_id for r in digests.merge_entries(stored, made, force=True).orderBy("item_id").collect()] == ["new", "x"]
