import random

from pressloom.llm import urlfilter
from pressloom.llm.queries import URL_RULES
from pyspark.sql import functions as F


def plain(url, rules):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_rules(spark):
    random.seed(1)
    hosts = ["a.example.com", "EXAMPLE.com", "www.example.com", "m.www.example.com", "example.net", "x.net", "notexample.com", "org", "com", ""]
    paths = ["", "/", "/en/", "/en", "/en/1?q=/fr/", "/es/2#x", "/fr/?a", "?x=/en/", "#/en/", "/EN/"]
    urls = [f"{s}://{h}{p}" for s in ("http", "https") for h in hosts for p in paths]
    urls += [None, "", "no scheme", "://", "a://b://example.com/en/", "http://ex\nample.com/en/\n", "http://" + "a." * 300 + "com/en/", "http://é.com/ü"]
    urls += urls[:5]
    rules = [*URL_RULES, ("block", "com", "/en"), ("allow", "a.example.com", "/en/1")]
    for some in (URL_RULES, rules, []):
        df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, key string")
        for r in urlfilter.judge(df, some).collect():
            assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, some), r.url
    assert urlfilter.judge(df.limit(0), rules).count() == 0


def test_cascade_is_exact(spark):
    """Many listed keys among many others, so that several levels are needed."""
    universe = spark.range(20_000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = universe.where(F.crc32("key") % 9 == 0)
    cascade = urlfilter.Cascade.build(listed, universe)
    assert len(cascade.levels) > 2
    said = universe.select("key", cascade.lists(F.col("key")).alias("said"), (F.crc32("key") % 9 == 0).alias("wanted"))
    assert said.where("said <> wanted").isEmpty()
    assert sum(made.bits for made in cascade.levels) < 20_000 * 8
