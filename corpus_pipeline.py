"""A training corpus from documents: language, repeated lines, near copies, mix, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents its predecessor kept. The first four
return the columns of ``documents``; the last returns the token ids of every piece of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import bpe, langid, linededup, mixing, simhash
from pressloom.llm.queries import tokenizer_file
from pressloom.sources.scratch import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of which no language explains this part of the n-grams are rejected.
LEAST_SCORE = 0.2

# Which words a mix takes follows from 64-bit hashes that DuckDB does not have.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without letters go."""
    filters = langid.learn(docs)
    judged = langid.predict(docs, filters)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier one repeats. All documents stay, some without text."""
    return _measured(linededup.dedup_lines(docs, shortest=1))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of 3-word shingles are linked by two bits or fewer."""
    return simhash.keep_one(docs).select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that the mix of sources takes, as often as it takes them."""
    return mixing.mixed(docs).select(*COLUMNS)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece as token ids, with a digest of what they decode to."""
    done = bpe.round_trip(docs, tokenizer_file())
    return done.select(
        "doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing_sources", mixing_sources),
    ("bpe_tokens", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
