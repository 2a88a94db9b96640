"""The sample tables seen as news items, runs, fetch logs and settings.

Each view computes its narrow columns before any join, so a query that does not
read ``content`` never shuffles it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import hashing

AS_OF = "2024-01-31 00:00:00"
SPLIT_AT = "2024-01-24 00:00:00"
FIRST_DAY = "2024-01-01"
LAST_DAY = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def published_at(key: Column) -> Column:
    minutes = ((key * 7919) % 43200).cast("int")
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), minutes, F.lit(0)
    )


def _tags(lang: Column) -> Column:
    marks = F.array(
        F.when(F.col("quality") == 1, F.lit("ai")), F.when(F.col("toxic") == 1, F.lit("security")), lang
    )
    return F.filter(marks, lambda t: t.isNotNull())


def _from_documents(spark, sf_dir, url: Column, tags: bool, duplicates: bool) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    items = docs.select(
        "doc_id",
        url.alias("url"),
        title.alias("title"),
        F.col("text").alias("content"),
        F.lit("").alias("summary"),
        "source",
        "lang",
        F.length("text").alias("content_length"),
        published_at(F.col("doc_id")).alias("published_at"),
    ).select(
        "doc_id",
        hashing.item_id(F.col("url"), F.col("title")).alias("id"),
        "url", "title", "content", "summary", "source", "lang", "content_length", "published_at",
        (F.col("published_at") + F.expr("interval 1 hour")).alias("collected_at"),
    )
    if tags:
        labels = table(spark, sf_dir, "labels")
        items = items.join(labels, "doc_id", "left").withColumn("tags", _tags(F.col("lang")))
        items = items.drop("quality", "toxic")
    if duplicates:
        # A copy is any document but the first with the same text. The firsts come from a
        # pre-aggregated minimum, so a text shared by many documents is never one task's work.
        firsts = (
            docs.groupBy(F.sha2("text", 256).alias("text_hash"))
            .agg(F.min("doc_id").alias("doc_id"))
            .select("doc_id", F.lit(False).alias("_copy"))
        )
        items = items.join(firsts, "doc_id", "left").withColumn(
            "is_duplicate", F.coalesce("_copy", F.lit(True))
        ).drop("_copy")
    return items.drop("lang")


def items(spark: SparkSession, sf_dir: str, tags: bool = False, duplicates: bool = False) -> DataFrame:
    """One item per document, every url different."""
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/a/"), F.col("doc_id").cast("string"))
    return _from_documents(spark, sf_dir, url, tags, duplicates)


def items_synd(spark: SparkSession, sf_dir: str, tags: bool = False, duplicates: bool = False) -> DataFrame:
    """One item per document; exact copies share url, title and id."""
    url = F.concat(F.lit("https://example.com/a/"), F.left(F.sha2("text", 256), F.lit(16)))
    out = _from_documents(spark, sf_dir, url, tags, duplicates)
    return out.withColumns({"feed_pos": F.col("source"), "entry_pos": F.col("doc_id")})


def before_split(df: DataFrame) -> DataFrame:
    return df.where(F.col("published_at") < F.lit(SPLIT_AT).cast("timestamp_ntz"))


def from_split(df: DataFrame) -> DataFrame:
    return df.where(F.col("published_at") >= F.lit(SPLIT_AT).cast("timestamp_ntz"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the publication time and id of the document of the same number, null where there is none."""
    docs = items(spark, sf_dir).select("doc_id", "id", "url", "source", "published_at")
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return vecs.join(docs, "doc_id", "left").withColumnRenamed("doc_id", "vec_id")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("source"),
        F.col("ts").cast("timestamp_ntz").alias("started_at"),
        (F.col("event_type") != "error").alias("ok"),
        _k().alias("items"),
        F.col("value").alias("elapsed_s"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = F.col("ts").cast("timestamp_ntz")
    took = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor("value").cast("decimal(18,6)"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("event_type").alias("collector_type"),
        started.alias("started_at"),
        F.when(F.col("event_id") % 10 != 0, started + took).alias("completed_at"),
        _k().alias("total_items"),
    )


def task_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("task"), (F.col("user_id") % 4).cast("string")).alias("task"),
        F.col("ts").cast("timestamp_ntz").alias("started_at"),
        F.col("event_id").alias("run_id"),
        ok.alias("ok"),
        F.when(~ok, F.concat(F.lit("err "), _k().cast("string"))).alias("error"),
    )


def settings_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    path = (
        F.when(d % 3 == 0, "cfg.api_key").when(d % 3 == 1, "cfg.auth.token").otherwise("cfg.endpoint")
    )
    hexed = F.left(F.sha2("text", 256), (d % 40 + 20).cast("int"))
    return table(spark, sf_dir, "documents").select(
        d.alias("row_id"),
        path.alias("path"),
        F.when(d % 7 == 0, F.lit("${ENV}")).otherwise(hexed).alias("value"),
    )
