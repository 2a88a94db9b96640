"""The queries of this package over the sample tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import bpe, htmltext, langid, latticededup, linededup, mixing, quality, simhash, suffix, tokenalign, urlfilter, whitening, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    done = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


HELD_OUT = "coalesce(crc32(cast(doc_id AS string)) % 4 = 2, false)"


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labels of three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.expr(HELD_OUT)
    filters = langid.learn(docs.where(~held_out & F.col("lang").isNotNull()).select("text", "lang"))
    judged = langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), filters)
    return judged.select("doc_id", "held_out", "lang_pred", "score")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by their fingerprints."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, of its edited text, and how alike they are."""
    return winnow.compared_with_edits(table(spark, sf_dir, "documents"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and boosted trees on every document; learned from its labels."""
    docs = table(spark, sf_dir, "documents")
    trees = quality.learn(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge(docs.select("doc_id", "text"), trees)
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "quality_score")


URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
_URL_RULES_SQL = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)

SQL["op8_urls"] = rf"""
WITH rules(action, rule_host, rule_path) AS (VALUES {_URL_RULES_SQL}),
parts AS (
  SELECT *, CASE WHEN coalesce(strpos(url, '://'), 0) = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
),
hosts AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM parts
),
split AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM hosts
),
shapes AS (
  SELECT host, path, action, rule_host || rule_path AS rule,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM (SELECT DISTINCT host, path FROM split) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, s.host, s.path, rule, coalesce(action, 'allow') AS verdict
FROM split s LEFT JOIN shapes r ON s.host = r.host AND s.path = r.path AND place = 1
"""


@query
def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.taken(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages of 400 bytes that occur more than once."""
    done = suffix.remove_repeats(table(spark, sf_dir, "documents"), keep="none", length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return done.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line, up to two edits away, repeats; short ones if they are equal."""
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), shortest=1)
    return done.select("doc_id", "n_lines", "n_removed", "n_near", "n_links", F.sha2("text", 256).alias("kept_sha256"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector along the first components of all distinct ones."""
    rows, model, error = whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    long = rows.select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*map(F.lit, model.explained)) if model.explained else F.array().cast("array<double>")
    return long.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


@query
def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all vectors by cosine."""
    return latticededup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under two vocabularies, aligned by bytes and weighed by how many documents align them so."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = tokenalign.aligned(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
