"""Feed files of several kinds, read from folders."""

import pytest
from helpers import AS_OF, rows, when
from pyspark.sql import functions as F

from pressloom.operators import stats
from pressloom.plans import ingest
from pressloom.sources import feeds

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'
FILES = {
    "daily": HEAD + """<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Chan</title><link>https://chan.org</link>
<item><title> First </title><link> https://a.org/1 </link><description>Plain &amp; simple</description>
  <pubDate>Mon, 29 Jan 2024 10:00:00 GMT</pubDate><author>desk@a.org (Jo)</author><guid>g1</guid><category>AI</category><category>ai </category><category>Law</category></item>
<item><title>Second</title><link>https://a.org/2</link><description><![CDATA[<p>Short</p>]]></description>
  <content:encoded><![CDATA[<p>Long</p><p>text</p>]]></content:encoded><pubDate>Tue, 30 Jan 2024 02:00:00 +0200</pubDate></item>
<item><title>No link</title><description>x</description></item>
<item><title>  </title><link>https://a.org/3</link></item>
<item><title>Undated</title><link>https://a.org/4</link><description></description></item>
</channel></rss>""",
    "twice": HEAD + """<rss version="2.0"><channel><title>T</title>
<item><title>Same</title><link>https://t.org/x</link><description>one</description><pubDate>Tue, 30 Jan 2024 01:00:00 GMT</pubDate></item>
<item><title>Same</title><link>https://t.org/x</link><description>two</description><pubDate>Tue, 30 Jan 2024 02:00:00 GMT</pubDate></item>
<item><title>Other</title><link>https://t.org/y</link><pubDate>Tue, 30 Jan 2024 03:00:00 GMT</pubDate></item>
<item><title>Old</title><link>https://t.org/z</link><pubDate>Mon, 01 Jan 2024 03:00:00 GMT</pubDate></item>
<item><title>Bad</title><link>javascript:alert(1)</link><pubDate>Tue, 30 Jan 2024 03:00:00 GMT</pubDate></item>
</channel></rss>""",
    "arXiv AI": HEAD + """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel rdf:about="http://arxiv.org/rss/cs.AI"><title>c</title><link>http://arxiv.org/rss/cs.AI</link></channel>
<item rdf:about="http://arxiv.org/abs/2401.1"><title>Paper</title><link>http://arxiv.org/abs/2401.1</link><description>&lt;p&gt;""" + "w" * 250 + """&lt;/p&gt;</description>
  <dc:creator>Mara Quint,  Tove Brandt, ,</dc:creator><dc:date>2024-01-30T09:00:00+00:00</dc:date></item>
<item rdf:about="x"><title>Older id</title><link>http://arxiv.org/abs/math/0101</link><description>d</description><dc:date>nonsense</dc:date></item>
<item rdf:about="y"><title>Elsewhere</title><link>http://other.org/1</link><description>d</description></item>
</rdf:RDF>""",
    "atom": HEAD + """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title>
<entry><title>Entry</title><link rel="self" href="https://f.org/self"/><link rel="alternate" href="https://f.org/e"/><id>urn:1</id>
  <updated>2024-01-30T05:00:00Z</updated><summary>Sum</summary><content type="html">&lt;b&gt;Full&lt;/b&gt;</content>
  <author><name>Ann</name></author><author><name>Bo</name></author><category term="X"/><category term="Y"/></entry>
</feed>""",
    "empty": HEAD + "<rss version=\"2.0\"><channel><title>E</title><link>https://e.org</link></channel></rss>",
    "broken": HEAD + "<rss version=\"2.0\"><channel><item><title>Cut off</title><link>https://b.org",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("feeds")
    for name, text in FILES.items():
        (root / f"source={name}").mkdir()
        (root / f"source={name}" / "feed.xml").write_text(text, encoding="utf-8")
    return str(root)


@pytest.fixture(scope="module")
def parsed(spark, folder):
    return {r.url: r for r in feeds.normalise(feeds.read_feeds(spark, folder), AS_OF).collect()}


def test_standard_entries(parsed):
    first = parsed["https://a.org/1"]
    assert (first.title, first.content, first.summary, first.source) == ("First", "Plain & simple", "Plain & simple", "daily")
    assert (first.published_at, first.tags) == (when("2024-01-29 10:00:00"), ["ai", "law"])
    assert first.metadata == {"author": "desk@a.org (Jo)", "guid": "g1"}
    second = parsed["https://a.org/2"]
    assert (second.content, second.summary, second.published_at) == ("Longtext", "Short", when("2024-01-30 00:00:00"))
    undated = parsed["https://a.org/4"]
    assert (undated.published_at, undated.content, undated.tags, undated.metadata) == (when(AS_OF), "", [], {})


def test_blank_entries_are_dropped_and_broken_feeds_stop_nothing(parsed):
    assert "https://a.org/3" not in parsed and all(r.title.strip() for r in parsed.values())
    assert {r.source for r in parsed.values()} == {"daily", "twice", "arXiv AI", "atom"}


def test_preprints(parsed):
    paper = parsed["http://arxiv.org/abs/2401.1"]
    assert paper.metadata == {"authors": "Mara Quint, Tove Brandt", "arxiv_id": "2401.1", "type": "research_paper", "source_type": "preprint"}
    assert (paper.tags, paper.summary, paper.content) == (["arxiv", "cs.ai"], "w" * 200 + "...", "w" * 250)
    assert paper.published_at == when("2024-01-30 09:00:00")
    older = parsed["http://arxiv.org/abs/math/0101"]
    assert (older.tags, older.metadata["arxiv_id"], older.published_at) == (["math", "arxiv"], "math/0101", when(AS_OF))
    assert parsed["http://other.org/1"].tags == ["arxiv"] and "arxiv_id" not in parsed["http://other.org/1"].metadata


def test_atom_entries(parsed):
    entry = parsed["https://f.org/e"]
    assert (entry.content, entry.summary, entry.published_at, entry.tags) == ("Full", "Sum", when("2024-01-30 05:00:00"), ["x", "y"])
    assert entry.metadata == {"authors": "Ann, Bo", "guid": "urn:1"}


def test_collect(spark, folder):
    kept, refused = ingest.collect(feeds.read_feeds(spark, folder), AS_OF)
    twice = kept.where("source = 'twice'").select("url", "content")
    assert rows(twice, "url") == [("https://t.org/x", "one"), ("https://t.org/y", "")]
    assert [(r.url, r.reject_reason) for r in refused.collect()] == [("javascript:alert(1)", "scheme")]


def test_old_first_copy_hides_a_younger_one(spark):
    entry = "source string, entry_pos long, title string, link string, content string, summary string, published string, updated string, " \
            "dc_date string, dc_creator string, author string, authors array<string>, guid string, categories array<string>"
    row = lambda pos, day: ("s", pos, "T", "https://x.org/1", None, "d", f"2024-01-{day}", None, None, None, None, None, None, None)
    old_first = spark.createDataFrame([row(1, "01"), row(2, "30")], entry)
    assert ingest.collect(old_first, AS_OF)[0].count() == 0
    new_first = spark.createDataFrame([row(1, "30"), row(2, "01")], entry)
    assert ingest.collect(new_first, AS_OF)[0].count() == 1


def test_feed_stream_reads_like_the_batch(spark, folder, tmp_path):
    from pressloom.streaming import feeds as streams

    stream = feeds.normalise(feeds.read_feed_stream(spark, folder), AS_OF).select("id", "url", F.col("title"))
    streams.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = feeds.normalise(feeds.read_feeds(spark, folder), AS_OF).select("id", "url", "title")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_flaws_cost_one_entry(spark, tmp_path):
    folder = tmp_path / "source=flawed"
    folder.mkdir()
    (folder / "b.xml").write_text(HEAD + """<rss version="2.0"><channel><title>F</title>
<item><title>Cats & dogs</title><link>https://w.org/1?a=1&b=2</link><description>It&rsquo;s &nbsp;fine &amp; well &#8212; 1 &lt; 2</description></item>
<item><title>Bad <b>nesting</title><link>https://w.org/2</link></item>
<item><title>After</title><link>https://w.org/3</link><description><![CDATA[<p>Tea &amp; <b>cake</b> a&b]]></description></item>
<item><title>Cut off</title><link>https://w.org/4</link>""", encoding="utf-8")
    (folder / "a.xml").write_text(HEAD + "<rss><channel><items/><item><title>Earlier file</title><link>https://w.org/0</link></item></channel></rss>", encoding="utf-8")
    entries = feeds.read_feeds(spark, str(tmp_path))
    assert entries._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r.url: r for r in feeds.normalise(entries, AS_OF).collect()}
    assert set(got) >= {"https://w.org/0", "https://w.org/1?a=1&b=2", "https://w.org/3"} and "https://w.org/4" not in got
    first = got["https://w.org/1?a=1&b=2"]
    assert (first.title, first.content) == ("Cats & dogs", "It\u2019s \u00a0fine & well \u2014 1 < 2")
    assert got["https://w.org/3"].content == "Tea &cakea&b"
    order = [r.title for r in entries.orderBy("source", "entry_pos").collect() if r.title]
    assert order[:2] == ["Earlier file", "Cats & dogs"]


def test_collection_log(spark, tmp_path):
    whole = "<item><title>A</title><link>https://a.org/1</link></item>"
    texts = {
        "good": f"<rss><channel>{whole}{whole}<item><title>No link</title></item></channel></rss>",
        "cut": f"<rss><channel>{whole}<item><title>Ends",
        "page": "<html><body>Not found</body></html>",
        "none": "<feed xmlns='http://www.w3.org/2005/Atom'><title>F</title></feed>",
        "flaw": f"<rss><channel>{whole}<item><title>X</item></channel></rss>",
        "blank": "",
    }
    for name, text in texts.items():
        (tmp_path / f"source={name}").mkdir()
        (tmp_path / f"source={name}" / "feed.xml").write_text(text)
    done = feeds.collect_feeds(spark, str(tmp_path), AS_OF)
    log = {r.source: (r.ok, r["items"], r.malformed, r.refused) for r in done.log.collect()}
    assert log["good"] == (True, 3, 0, 1) and log["cut"] == (True, 1, 1, 0)
    assert log["page"][:2] == (False, 0) and log["none"] == (True, 0, 0, 0)
    assert log["flaw"][0] and log["flaw"][1] + log["flaw"][2] == 2 and log["flaw"][1] >= 1
    assert not log["blank"][0] if "blank" in log else True
    assert done.totals["items"] == sum(v[1] for v in log.values()) and done.totals["refused"] == sum(v[3] for v in log.values())
    same = lambda df: sorted((r.source, r.title or "", r.link or "") for r in df.collect())
    assert same(done.entries) == same(feeds.read_feeds(spark, str(tmp_path)))
    health = {r.source: r.success_rate for r in stats.feed_stats(done.log).collect()}
    assert health["good"] == 1.0 and health["page"] == 0.0
