"""The item, run, digest and registry tables as parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from pressloom.functions.dates import as_of_literal
from pressloom.operators import dedup, filters
from pressloom.operators.skew import first_per, fits, only_keys_of
from pressloom.operators.stats import failed_sources
from pressloom.schemas import ITEM_SCHEMA
from pressloom.sources import files
from pressloom.sources.scratch import cut_lineage


#: Text of a day that stays in one task, about, and what a row has besides its texts. Neighbouring parts share a task, so that
#: small ones make no more files.
DAY_BYTES = 8 << 20
_ROW_BYTES = 100


def _first_of_id():
    return [F.asc("published_at"), F.asc("url")]


def new_keys(batch: DataFrame, stored: DataFrame, stored_urls: DataFrame | None = None) -> DataFrame:
    """``id, url`` of the batch rows that may be added; works on narrow rows only. Stored urls are those of ``stored``
    unless ``stored_urls`` has them.

    Ids and urls are unique, also within the batch. The batch is reduced to one row per id and
    per url first, so the anti-joins against the stored keys meet no hot key.
    """
    return _new_rows(batch, stored, stored_urls).select("id", "url")


def _new_rows(batch: DataFrame, stored: DataFrame, stored_urls: DataFrame | None) -> DataFrame:
    """``new_keys`` with ``published_at``."""
    narrow = batch.select("id", "url", "published_at")
    by_id = first_per(narrow, ["id"], _first_of_id())
    one = first_per(by_id, ["url"], [F.asc("published_at"), F.asc("id")])
    small = fits(narrow)
    known = lambda table, key: only_keys_of(table.select(key), narrow, [key], small)
    fresh = one.join(known(stored, "id"), "id", "left_anti")
    return fresh.join(known(stored if stored_urls is None else stored_urls, "url"), "url", "left_anti").select("id", "url", "published_at")


def new_items(batch: DataFrame, stored: DataFrame, stored_urls: DataFrame | None = None) -> DataFrame:
    """Items of the batch that may be added. Adding the same batch twice adds nothing.

    Wide rows are shuffled once, by id; the rest is decided on narrow rows.
    """
    one = first_per(batch, ["id"], _first_of_id())
    return one.join(new_keys(batch, stored, stored_urls).select("id"), "id", "left_semi")


def write_items(items: DataFrame, path: str, mode: str = "append") -> None:
    """Write items by publication day.

    Rows of a day come together so that files stay few; the rebalance hint lets the runtime
    split a day that is too large for one task and join days that are small.
    """
    dated = items.withColumn("published_date", F.to_date("published_at"))
    write_dated(dated.hint("rebalance", "published_date"), path, mode)


def new_items_by_day(batch: DataFrame, kept: DataFrame, stored: DataFrame, stored_urls: DataFrame | None = None) -> DataFrame:
    """The ``new_items`` of ``kept``, the rows of a day together; wide rows are shuffled once, by day.

    ``kept`` holds, of each id in ``batch``, all rows or none, and only its narrow columns are read. The keys that may be added
    are dealt out with the rows of ``batch`` as marks, one before the rows of its id; the row that follows a mark stays.
    Days, and those with much text in parts by id, are dealt out in order and in like numbers of rows.
    """
    day = F.to_date("published_at")
    marks = _new_rows(kept, stored, stored_urls).where("id IS NOT NULL").select("id", "published_at", F.lit(True).alias("_mark"))
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in batch.schema if isinstance(f.dataType, StringType)]
    amount = F.sum(sum(texts, F.lit(_ROW_BYTES)).cast("long"))
    days = batch.groupBy(day.alias("_day")).agg(F.ceil(amount / DAY_BYTES).cast("int").alias("_fan"))
    rows = batch.unionByName(marks, allowMissingColumns=True).withColumn("published_date", day)
    sized = rows.join(F.broadcast(days), F.col("published_date").eqNullSafe(F.col("_day")), "left")
    salt = F.pmod(F.xxhash64("id"), F.coalesce("_fan", F.lit(1))).cast("int")
    dealt = sized.withColumn("_salt", salt).repartitionByRange("published_date", "_salt")
    w = Window.partitionBy("published_date", "_salt", "id").orderBy(F.desc_nulls_last("_mark"), *_first_of_id())
    first = dealt.withColumn("_marked", F.lag("_mark").over(w)).where("_marked AND _mark IS NULL")
    return first.drop("_day", "_fan", "_salt", "_mark", "_marked")


def write_dated(dated: DataFrame, path: str, mode: str = "append") -> None:
    """Write items that have a ``published_date`` and lie together by it."""
    dated.write.mode(mode).partitionBy("published_date").parquet(path)


def append_items(batch: DataFrame, stored: DataFrame, path: str) -> DataFrame:
    """Add what is new to the table at ``path``; returns the rows that were added.

    They are fixed in the checkpoint folder first: ``stored`` may be the very table written.
    """
    fresh = cut_lineage(new_items(batch, stored))
    write_items(fresh, path)
    return fresh


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Stored items in the item schema, plus ``published_date`` for partition pruning."""
    schema = StructType([*ITEM_SCHEMA.fields, StructField("published_date", DateType())])
    return spark.read.schema(schema).parquet(path)


def newest_items(spark: SparkSession, path: str, as_of, limit: int, days: int = 7, source: str | None = None) -> DataFrame:
    """``filters.recent`` with ``limit`` on the table at ``path``, without reading more days than it takes.

    Days are walked from the newest, one, two, four and so on at a time, and their rows counted, until there are enough; only
    those days are then sorted. Candidates with a cap (``dedup.candidates``) are these rows for ``dedup.CANDIDATE_DAYS``.
    """
    stored, some, enough, step = read_items(spark, path), [], 0, 1
    since = spark.range(1).select(F.to_date(as_of_literal(as_of) - F.make_dt_interval(F.lit(days)))).first()[0]
    left = [d for d in files.days(spark, path, "published_date") if d >= since]
    while left and enough < limit:
        taken, left = left[:step], left[step:]
        of_days = stored.where(F.col("published_date").isin(taken))
        enough += filters.recent(of_days, as_of, days, source).count()
        some, step = some + taken, step * 2
    return filters.recent(stored.where(F.col("published_date").isin(some)), as_of, days, source, limit)


def flag_stored(spark: SparkSession, path: str, verdicts: DataFrame) -> list:
    """Set ``is_duplicate`` and ``duplicate_of`` in the table at ``path``; rewrites the days that have such items and no
    others. Returns these days."""
    found = cut_lineage(verdicts.where("is_duplicate").select("id", "original_id", F.lit(True).alias("is_duplicate")))
    stored = read_items(spark, path)
    # Ids and days only; the texts of other days are never read.
    narrow = only_keys_of(stored.select("id", "published_date"), found, ["id"], fits(found))
    days = files.partitions(narrow.join(found.select("id"), "id", "left_semi"), ["published_date"])
    if days:
        touched = stored.where(files.one_of(["published_date"], days))
        files.replace_partitions(dedup.flag_duplicates(touched, found).select(*stored.columns), path, ["published_date"])
    return [d for (d,) in days]


def as_items(stored: DataFrame) -> DataFrame:
    """Stored rows as item rows (``extra_metadata`` becomes ``metadata``, null lists become empty)."""
    out = stored.withColumnRenamed("extra_metadata", "metadata") if "extra_metadata" in stored.columns else stored
    names = [f.name for f in ITEM_SCHEMA.fields]
    missing = {f.name: F.lit(None).cast(f.dataType) for f in ITEM_SCHEMA.fields if f.name not in out.columns}
    return out.withColumns(missing).select(*names) if missing else out.select(*names)


def link_items(run_id: str, added: DataFrame) -> DataFrame:
    """(run, item) rows for the items a run added."""
    return added.select(F.lit(run_id).alias("run_id"), F.col("id").alias("item_id"))


_FEED_FACTS = ("success_rate", "average_response_time", "last_success")


def run_sources(run_id: str, feeds: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The sources of a run, a row each: ``stats.feed_stats`` of ``feeds`` and how many of its fetches failed.

    A source that only one of the two knows has a row too, without facts or with no failure. Nothing is gathered, so
    the number of sources is not bounded by what fits a row; ``run_record`` has the same facts as a text.
    """
    facts = feeds.select("source", *_FEED_FACTS)
    if failed is None:
        known = facts.withColumn("failed_fetches", F.lit(0).cast("long"))
    else:
        # Null is a source like any other here, so that its failures are not lost.
        lost = failed_sources(failed).withColumnRenamed("source", "_lost")
        joined = facts.withColumn("_known", F.lit(True)).join(lost, F.col("source").eqNullSafe(F.col("_lost")), "full_outer")
        known = joined.select(
            F.when(F.col("_known"), F.col("source")).otherwise(F.col("_lost")).alias("source"), *_FEED_FACTS,
            F.coalesce("failed_fetches", F.lit(0)).alias("failed_fetches"),
        )
    return known.select(F.lit(run_id).alias("run_id"), "*")


def write_run_sources(sources: DataFrame, path: str) -> DataFrame:
    """Write ``run_sources`` rows by run; a run that is written again replaces its own rows and touches no other run."""
    return files.replace_partitions(sources, path, ["run_id"])


def run_record(
    run_id: str, collector_type: str, started_at, completed_at, counters: DataFrame, feeds: DataFrame | None = None
) -> DataFrame:
    """The closed record of a run: counters plus per-source statistics as a JSON text."""
    per_feed = F.struct(*_FEED_FACTS)
    closed = counters.select(
        F.lit(run_id).alias("run_id"), F.lit(collector_type).alias("collector_type"),
        as_of_literal(started_at).alias("started_at"), as_of_literal(completed_at).alias("completed_at"),
        "total_items", "new_items", "duplicate_items", "failed_sources",
    )
    if feeds is None:
        return closed.withColumn("statistics", F.lit("{}"))
    entries = F.array_sort(F.collect_list(F.struct("source", per_feed.alias("s"))))
    stats = feeds.agg(F.to_json(F.map_from_entries(entries)).alias("statistics"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(closed).join(one(stats), "_one").drop("_one")


def publish(df: DataFrame, root: str, version: int) -> str:
    """Write a whole new version of a table next to the ones being read."""
    path = f"{root.rstrip('/')}/v={version:09d}"
    df.write.mode("overwrite").parquet(path)
    return path


def current_version(spark: SparkSession, root: str) -> int | None:
    """The newest version that was written completely, or None."""
    done = [n for n in files.numbers(spark, root, "v=") if files.exists(spark, f"{root.rstrip('/')}/v={n:09d}/_SUCCESS")]
    return max(done, default=None)


def read_current(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The newest complete version of a table; empty when there is none."""
    version = current_version(spark, root)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/v={version:09d}")
