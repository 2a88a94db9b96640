"""Column functions on literal values: nulls, boundaries, odd characters."""

import hashlib
import html
import math
from datetime import datetime
from urllib.parse import urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressloom.functions import dates, hashing, markup, scoring, text, urls, vectors


def test_clean_text(one):
    cases = {
        None: "", "": "", "  a \n\t b  ": "a b", "Hello\x00World\x01Test\x7fEnd": "HelloWorldTestEnd",
        "a  b": "a b", "x" * 100: "x" * 100, "x" * 150: "x" * 100 + "...",
    }
    assert one(lambda c: text.clean_text(c, 100), list(cases)) == list(cases.values())


def test_clean_text_counts_characters_not_units(one):
    assert one(lambda c: text.clean_text(c, 2), ["😀😀", "😀😀😀"]) == ["😀😀", "😀😀..."]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=40, max_size=60))
def test_clean_text_like_python(one, values):
    import re

    def expected(v):
        v = " ".join(re.sub(r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]", "", v).split())
        return v if len(v) <= 10 else v[:10] + "..."

    values = [v for v in values if not any(0xD800 <= ord(ch) < 0xE000 for ch in v)]
    assert one(lambda c: text.clean_text(c, 10), values) == [expected(v) for v in values]


def test_strip_is_linear_on_long_runs(one):
    long = "a" + " " * 200_000 + "b" + " " * 200_000
    assert one(text.strip, [long]) == [long.strip()]


def test_mask(one):
    assert one(text.mask, [None, "", "abcd", "abcde"]) == ["***", "***", "***", "abcd*"]
    assert one(lambda c: text.mask(c, 6), ["my_secret_token"]) == ["my_sec*********"]


def test_clean_tags(one):
    got = one(text.clean_tags, [[" AI ", "ml", "ai", "", None, "  "], [], None], "array<string>")
    assert got == [["ai", "ml"], [], []]


def test_title_case(one):
    assert one(text.title_case, ["machine-learning", "cs.ai", "über uns", "AI", ""]) == [
        "Machine-Learning", "Cs.Ai", "Über Uns", "Ai", ""]


def test_similarity_text(one):
    got = one(lambda c: text.similarity_text(F.lit("T"), c, F.lit("d.org"), 500), ["b" * 500, "b" * 501])
    assert got == [f"Title: T\n\nContent: {'b' * 500}\n\nSource: d.org", f"Title: T\n\nContent: {'b' * 500}...\n\nSource: d.org"]


def test_sanitize_url(one):
    cases = {
        "  http://a.org//x///y ": "http://a.org/x/y", "http:////a": "http:///a", "a//b": "a/b", None: "", "": "",
        "http://a/http://b//c": "http://a/http:/b/c", "x\x00y": "xy", "https://a.org": "https://a.org", "//a//b": "/a/b",
    }
    assert one(urls.sanitize_url, list(cases)) == list(cases.values())


def test_url_audit(one):
    cases = {
        "https://a.org/x": None, "http://a.org:80": None, "HTTP://a.org": None, "http://[::1]/": None,
        None: "empty", "": "empty", "ftp://a.org": "scheme", "a.org": "scheme", "//a.org": "scheme",
        "https://a.org/?q=JavaScript:1": "suspicious", "https://a.org/%0D%0Ax": "suspicious", "https://a.org/../x": "suspicious",
        "https:///x": "hostname", "https://user@/x": "hostname", "https://:80/x": "hostname", "http:a.org": "hostname",
        "https://[a/x": "malformed", "https://a]/x": "malformed",
        "https://a.org/" + "x" * 2034: None, "https://a.org/" + "x" * 2035: "length",
    }
    assert one(urls.url_reject_reason, list(cases)) == list(cases.values())


def test_domain_like_the_standard_library(one):
    values = ["https://A.org:8080/x?y", "http://u:p@h.de#f", "ftp://x", "//a.b/c", "a.org/x", "mailto:a@b.c", ""]
    assert one(urls.domain, values) == [urlparse(v).netloc for v in values]
    assert one(lambda c: urls.domain(c, "unknown"), ["nothing"]) == ["unknown"]


def test_hashes(one):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert one(lambda c: hashing.item_id(c, F.lit("T")), ["http://a/"]) == [sha("http://a/T")]
    assert one(hashing.title_hash, ["ÄB"]) == [sha("äb")]
    assert one(hashing.content_hash, ["X" * 600]) == [sha("x" * 600)]
    assert one(lambda c: hashing.content_hash(c, 500), ["X" * 600]) == [sha("x" * 500)]
    assert one(lambda c: hashing.cache_key(c, "m"), ["t"]) == [sha("m:t")]


def test_markup_to_text(one):
    cases = {
        "<p>x</p><p> y </p>": "xy", None: "", "plain": "plain", "a<!-- no -->b": "ab",
        "<script>var a='<p>';</script>t<style>p{}</style>": "t", "Fish &amp; chips &lt;b&gt;": "Fish & chips <b>",
        "&amp;lt;": "&lt;", "a<br/>b": "ab", "one  two": "one  two",
        "cut off &amp": "cut off &",
    }
    assert one(markup.markup_to_text, list(cases)) == list(cases.values())
    assert one(lambda c: markup.markup_to_text(c, " "), ["<p>x</p><p>y</p>"]) == ["x y"]
    assert one(markup.markup_to_text, ["&#x41;&eacute;<a title='>'>z</a>"]) == ["Aéz"]
    assert one(markup.markup_to_text, ["<p>a < b and c > d</p>", "1 <2 <i>x</i>"]) == ["a < b and c > d", "1 <2x"]


def test_entities_as_the_standard_library_reads_them(one):
    written = [
        "&#8217;&rsquo;&euro;&#146;&#x2019;", "&notit; &notin; &not", "&ampamp;&amp;lt;", "a & b &; &# &#x; &unknown; &copy2", "&#0;&#xD800;&#99999999;",
        "&NotEqualTilde;&Eacute&eacute", "&amp", "no references", "", "x&lt;y&gt;&nbsp;z",
    ]
    assert one(markup.decode_entities, written) == [html.unescape(t) for t in written]


def test_escape_markup(one):
    assert one(markup.escape_markup, ['<a href="x">&amp;</a>']) == ["&lt;a href=&quot;x&quot;&gt;&amp;amp;&lt;/a&gt;"]


@pytest.mark.parametrize("written, expected", [
    ("Mon, 15 Jan 2024 10:00:00 GMT", "2024-01-15 10:00:00"),
    ("Mon, 15 Jan 2024 10:00:00 +0200", "2024-01-15 08:00:00"),
    ("Monday, 15 January 2024 10:00:00 EST", "2024-01-15 15:00:00"),
    ("15 Jan 2024 10:00 GMT", "2024-01-15 10:00:00"),
    ("2024-01-15T10:00:00Z", "2024-01-15 10:00:00"),
    ("2024-01-15T10:00:00.250-05:00", "2024-01-15 15:00:00.250000"),
    ("2024-01-15T10:00:00.123456789+00:00", "2024-01-15 10:00:00.123456"),
    ("2024-01-15T10:00", "2024-01-15 10:00:00"),
    ("2024-01-15 10:00:00", "2024-01-15 10:00:00"),
    ("2024-01-15", "2024-01-15 00:00:00"),
    ("2024/1/5", "2024-01-05 00:00:00"),
    ("Jan 15, 2024", "2024-01-15 00:00:00"),
    ("January 15, 2024 10:30", "2024-01-15 10:30:00"),
    ("Sept. 5, 2024", "2024-09-05 00:00:00"),
    ("Mon, 29 Jan 2024 10:00:00 CET", "2024-01-29 09:00:00"),
    ("29/01/2024 10:00", "2024-01-29 10:00:00"),
    ("01/29/2024 10:00", "2024-01-29 10:00:00"),
    ("29.01.2024 10:00", "2024-01-29 10:00:00"),
    ("Jan 29, 2024 10:00 AM", "2024-01-29 10:00:00"),
    ("Jan 29, 2024 10:00:05 p.m. GMT", "2024-01-29 22:00:05"),
    ("Jan 29, 2024 12:10 AM +0100", "2024-01-28 23:10:00"),
    ("20240129T100000Z", "2024-01-29 10:00:00"),
    ("20240129", "2024-01-29 00:00:00"),
    ("20240129T1000+0200", "2024-01-29 08:00:00"),
    ("Mon Jan 29 10:00:00 2024", "2024-01-29 10:00:00"),
    ("Mon Jan 29 10:00:00 EST 2024", "2024-01-29 15:00:00"),
    ("Mon, 29 Jan 2024 10:00:00 +0000 (UTC)", "2024-01-29 10:00:00"),
    ("Mon, 29 Jan 24 10:00:00 GMT", "2024-01-29 10:00:00"),
    ("29-Jan-24 10:00", "2024-01-29 10:00:00"),
    ("29 Jan 99", "1999-01-29 00:00:00"),
    ("  Mon,  15 Jan 2024\n10:00:00 Z ", "2024-01-15 10:00:00"),
    ("yesterday", None), ("", None), (None, None), ("2024-13-45", None),
])
def test_parse_date(one, written, expected):
    got = one(dates.parse_date, [written])[0]
    assert got == (datetime.fromisoformat(expected) if expected else None)


def test_parse_date_does_not_depend_on_the_session_zone(spark, one):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(dates.parse_date, ["2024-01-15T10:00:00Z"]) == [datetime(2024, 1, 15, 10)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_periods(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-14 23:59:59' AS t UNION ALL SELECT timestamp_ntz'2024-01-15 00:00:00'")
    got = [(str(r.d), str(r.w)) for r in df.select(dates.day_of(F.col("t")).alias("d"), dates.week_of(F.col("t")).alias("w")).collect()]
    assert got == [("2024-01-14", "2024-01-08"), ("2024-01-15", "2024-01-15")]


def test_cosine01(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])],
        "a array<float>, b array<float>")
    got = [r.c for r in df.select(vectors.cosine01(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [1.0, 0.0, 0.5, 0.0]


def test_scores(spark, one):
    ref = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    got = one(lambda c: scoring.recency(c.cast("timestamp_ntz"), ref), ["2024-01-02 00:00:00", "2024-01-01 00:00:00", "2024-01-02 12:00:00"])
    assert got == pytest.approx([1.0, math.exp(-1), math.exp(0.5)])
    assert one(scoring.relevance, [[], ["ai"], ["ai", "security"], ["ai", "security", "breaking"], ["x"], None], "array<string>") == [
        0.0, 0.5, 1.0, 1.0, 0.0, 0.0]
    assert one(scoring.length_score, [99, 100, 499, 500, 1999, 2000], "int") == [0.1, 0.5, 0.5, 1.0, 1.0, 0.8]
    assert one(scoring.diversity, [1, 5], "int") == pytest.approx([1.0, 1 / (1 + math.log(5))])
    assert one(scoring.category, [["ML", "x"], ["vulnerability"], ["zebra"], [], None], "array<string>") == [
        "ai", "security", "zebra", "general", "general"]


def test_weights_are_shares():
    shares = scoring.Weights(3, 2, 3, 2).shares()
    assert (shares.recency, shares.diversity) == pytest.approx((0.3, 0.2))
