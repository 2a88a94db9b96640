"""Feed files (RSS 2.0, RDF, Atom) to items.

Feeds lie in folders ``source=<name>/``. A file is one poll of one feed and is read whole; a folder of
many feeds is read by many tasks. Text that is no entry yields nothing and stops nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import hashing
from pressloom.functions.dates import as_of_literal, parse_date
from pressloom.functions.markup import escape_markup, markup_to_text
from pressloom.functions.text import clean_tags, strip, truncated
from pressloom.operators.filters import require_title_link
from pressloom.sources.scratch import cut_lineage

_TEXTS = ("title", "link", "description", "content:encoded", "summary", "pubDate", "published", "updated",
          "dc:date", "dc:creator", "author", "guid")
# Tags and metadata of preprints.
PREPRINT_MARK = "arxiv"
ABSTRACT_PATH = "arxiv.org/abs/"
DEFAULT_PREPRINT_TAG = "cs.AI"

_ATOM_DDL = (
    "title string, link array<struct<_href:string,_rel:string>>, id string, published string, updated string, "
    "summary string, content string, author array<struct<name:string>>, category array<struct<_term:string>>"
)


_RSS_DDL = ", ".join(f"`{n}` string" for n in _TEXTS) + ", category array<string>"
# Fixed value: the references that XML itself knows.
_XML_REFERENCE = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#[xX][0-9a-fA-F]+);)"


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _repaired(xml: Column) -> Column:
    """XML text that a strict parser accepts: character data sections written out, and every '&' that begins no
    XML reference taken for itself, so that a named entity stays in the text for the later decoding."""
    # Even pieces lie outside of the sections, odd ones inside.
    pieces = F.split(xml, r"<!\[CDATA\[|\]\]>")
    outside = lambda p: F.regexp_replace(p, _XML_REFERENCE, "&amp;")
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, outside(p)).otherwise(escape_markup(p))), "")


def feed_entries(files: DataFrame, source: str = "source") -> DataFrame:
    """The entries of feed files, one row of text (``value``) and ``source`` each, in the common entry shape.

    RSS and RDF items and Atom entries are cut out of the text one by one and read by themselves: a flaw in one
    costs that one, and a file that ends early keeps its whole entries. ``entry_pos`` is the file and the place in it.
    """
    return _entries(_blocks(files.withColumn("_xml", _repaired(F.col("value"))), source, F.posexplode))


def _blocks(files: DataFrame, source: str, explode: Callable[..., Column], *more: str) -> DataFrame:
    """The entries of feed files (``_xml``) as they were read: ``r`` from RSS or RDF, ``a`` from Atom, neither if it could not be read."""
    blocks = F.regexp_extract_all(F.col("_xml"), F.lit(r"(?s)(<(item|entry)(?=[\s>]).*?</\2\s*>)"), F.lit(1))
    cut = files.select(F.col(source).alias("source"), F.col("_metadata.file_path").alias("file"), *more, explode(blocks).alias("place", "block"))
    options = {"mode": "PERMISSIVE"}
    is_rss = F.col("block").startswith("<item")
    return cut.select(
        "source", F.struct("file", "place").alias("entry_pos"), *more, F.col("block").isNotNull().alias("found"),
        F.when(is_rss, F.from_xml("block", _RSS_DDL, {**options, "rowTag": "item"})).alias("r"),
        F.when(~is_rss, F.from_xml("block", _ATOM_DDL, {**options, "rowTag": "entry"})).alias("a"),
    )


def _entries(blocks: DataFrame) -> DataFrame:
    read = blocks.where(F.col("r").isNotNull() | F.col("a").isNotNull())
    plain = F.filter("a.link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    names = F.filter(F.transform("a.author", lambda n: n["name"]), lambda n: n.isNotNull())
    rss, atom = (lambda n: F.col(f"r.`{n}`")), (lambda n: F.col(f"a.{n}"))
    return read.select(
        "source", "entry_pos",
        F.coalesce(rss("title"), atom("title")).alias("title"),
        # The alternate link of an Atom entry.
        F.coalesce(rss("link"), F.coalesce(F.get(plain, 0), F.get("a.link", 0))["_href"]).alias("link"),
        F.coalesce(rss("content:encoded"), atom("content")).alias("content"),
        F.coalesce(rss("summary"), rss("description"), atom("summary")).alias("summary"),
        F.coalesce(rss("published"), rss("pubDate"), atom("published")).alias("published"),
        F.coalesce(rss("updated"), atom("updated")).alias("updated"),
        rss("dc:date").alias("dc_date"), rss("dc:creator").alias("dc_creator"),
        F.coalesce(rss("author"), F.when(F.size(names) == 1, F.get(names, 0))).alias("author"),
        names.alias("authors"),
        F.coalesce(rss("guid"), atom("id")).alias("guid"),
        F.coalesce(rss("category"), F.transform("a.category", lambda c: c["_term"])).alias("categories"),
    )


def read_feeds(spark: SparkSession, path: str, source: str = "source") -> DataFrame:
    """All entries of all feeds below ``path``, in one pass over the files."""
    return feed_entries(spark.read.schema(f"value string, {source} string").text(path, wholetext=True), source)


@dataclass(frozen=True)
class Collected:
    """Entries, what became of every feed file, and the totals over all files."""

    entries: DataFrame
    log: DataFrame
    totals: dict[str, int]


def collect_feeds(spark: SparkSession, path: str, as_of, source: str = "source") -> Collected:
    """All entries below ``path`` and the log of their collection, from one pass over the files.

    What is read is written once to the checkpoint folder; entries and log come from there, and the totals are observed while it
    is written. The log has a row per file: ``source, started_at, ok, items, malformed, refused, elapsed_s`` as ``stats.feed_stats``
    reads it. ``ok``: the text is a feed. ``malformed``: entries that cannot be read or have no end. ``refused``: entries among
    the items that have no title or no link.
    """
    files = spark.read.schema(f"value string, {source} string").text(path, wholetext=True).withColumn("_xml", _repaired(F.col("value")))
    files = files.withColumns({
        "is_feed": F.col("_xml").rlike(r"<(rss|feed|(\w+:)?RDF)[\s>]"), "begun": F.size(F.regexp_extract_all("_xml", F.lit(r"(<(item|entry)(?=[\s>]))"), F.lit(1))),
    })
    blocks = _blocks(files, source, F.posexplode_outer, "is_feed", "begun")
    read = F.col("r").isNotNull() | F.col("a").isNotNull()
    blank = lambda c: F.coalesce(F.length(strip(c)), F.lit(0)) == 0
    title, link = F.coalesce("r.title", "a.title"), F.coalesce("r.link", F.get("a.link", 0)["_href"])
    flags = blocks.withColumns({"read": read, "refused": read & (blank(title) | blank(link))})
    seen = Observation()
    counted = flags.observe(
        seen, F.count_if("read").alias("items"), F.count_if(F.col("found") & ~F.col("read")).alias("unreadable"), F.count_if("refused").alias("refused"),
        F.count_if(~F.col("is_feed")).alias("rows_of_no_feed"),
    )
    fixed = cut_lineage(counted)
    log = fixed.groupBy("source", F.col("entry_pos.file").alias("file")).agg(
        F.first("is_feed").alias("ok"), F.count_if("read").alias("items"),
        (F.first("begun") - F.count_if("read")).cast("long").alias("malformed"), F.count_if("refused").alias("refused"),
    )
    log = log.withColumns({"started_at": as_of_literal(as_of), "elapsed_s": F.lit(None).cast("double")})
    return Collected(_entries(fixed), log, seen.get)


def read_feed_stream(spark: SparkSession, path: str, source: str = "source", files_per_trigger: int = 10_000) -> DataFrame:
    """Entries of feed files as they arrive, of every kind of feed."""
    reader = spark.readStream.schema(f"value string, {source} string").option("maxFilesPerTrigger", files_per_trigger)
    return feed_entries(reader.text(path, wholetext=True), source)


def _item(df: DataFrame, as_of) -> DataFrame:
    return df.select(
        hashing.item_id(F.col("link"), F.col("title")).alias("id"),
        F.col("link").alias("url"), "title",
        F.coalesce("text", F.lit("")).alias("content"),
        F.coalesce("brief", F.lit("")).alias("summary"),
        "source",
        F.coalesce("when", as_of_literal(as_of)).alias("published_at"),
        as_of_literal(as_of).alias("collected_at"),
        clean_tags(F.col("labels")).alias("tags"),
        F.map_filter("facts", lambda _, v: v.isNotNull()).alias("metadata"),
        F.col("source").alias("feed_pos"), "entry_pos",
    )


def _trimmed(entries: DataFrame) -> DataFrame:
    out = entries.withColumns({"title": strip(F.col("title")), "link": strip(F.col("link"))})
    return require_title_link(out)


def normalise_standard(entries: DataFrame, as_of) -> DataFrame:
    """Entries of ordinary feeds as items."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    text = markup_to_text(F.coalesce(filled("content"), F.col("summary")))
    several = F.when(F.size("authors") > 0, F.array_join("authors", ", "))
    author = F.coalesce("author", "dc_creator")
    facts = F.create_map(
        F.lit("author"), author,
        F.lit("authors"), F.when(author.isNull(), several),
        F.lit("guid"), F.col("guid"),
    )
    return _item(
        _trimmed(entries).withColumn("text", text).withColumns({
            "brief": F.coalesce(F.when(F.col("summary") != "", markup_to_text(F.col("summary"))), truncated(F.col("text"), 200)),
            "when": F.coalesce(parse_date(F.col("published")), parse_date(F.coalesce("updated", "dc_date"))),
            "labels": F.filter("categories", lambda c: c != ""),
            "facts": facts,
        }),
        as_of,
    )


def normalise_preprint(entries: DataFrame, as_of) -> DataFrame:
    """Entries of preprint feeds as items: authors from dc:creator, id and tags from the link."""
    names = F.filter(F.transform(F.split("dc_creator", ","), strip), lambda n: n != "")
    authors = F.coalesce(F.array_join(names, ", "), F.array_join(F.filter("authors", lambda n: n != ""), ", "))
    number = F.when(F.contains("link", F.lit(ABSTRACT_PATH)), F.element_at(F.split("link", "/abs/"), -1))
    tags = (
        F.when(number.isNull(), F.array(F.lit(PREPRINT_MARK)))
        .when(number.contains("/"), F.array(F.element_at(F.split(number, "/"), 1), F.lit(PREPRINT_MARK)))
        .otherwise(F.array(F.lit(PREPRINT_MARK), F.lit(DEFAULT_PREPRINT_TAG)))
    )
    stated = (
        F.when(F.col("dc_date").isNotNull(), F.col("dc_date"))
        .when(F.col("published").isNotNull(), F.col("published"))
        .otherwise(F.col("updated"))
    )
    facts = F.create_map(
        F.lit("authors"), authors,
        F.lit("arxiv_id"), number,
        F.lit("type"), F.lit("research_paper"),
        F.lit("source_type"), F.lit("preprint"),
    )
    return _item(
        _trimmed(entries).withColumn("text", markup_to_text(strip(F.col("summary")))).withColumns({
            "brief": truncated(F.col("text"), 200),
            "when": parse_date(stated),
            "labels": tags,
            "facts": facts,
        }),
        as_of,
    )


def is_preprint_source(source: str = "source") -> Column:
    return F.contains(F.lower(source), F.lit(PREPRINT_MARK))


def normalise(entries: DataFrame, as_of) -> DataFrame:
    """Items from entries; preprint sources are told by their name."""
    preprint = is_preprint_source()
    return normalise_standard(entries.where(~preprint), as_of).unionByName(
        normalise_preprint(entries.where(preprint), as_of)
    )
