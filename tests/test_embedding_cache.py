"""The stored embedding cache."""

from pathlib import Path

import pytest
from helpers import AS_OF, when
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.functions import hashing
from pressloom.sources import embedding_cache


@F.pandas_udf(T.ArrayType(T.FloatType()))
def lengths(texts):
    return texts.map(lambda t: [float(len(t))])


@pytest.fixture
def cache(spark, tmp_path):
    name, path = f"cache_{tmp_path.name}".replace("-", "_"), str(tmp_path / "cache")
    embedding_cache.open_cache(spark, name, path, 4)
    yield name, path
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


def test_missing_texts_are_embedded_once(spark, cache):
    name, path = cache
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def counting(values):
        seen.add(len(values))
        return values.map(lambda t: [float(len(t))])

    run = lambda df: {r.id: (r.embedding, r.from_cache) for r in embedding_cache.embed(df, name, counting, "m", AS_OF).collect()}
    assert run(texts(spark, "a", "bb", "a", None, "")) == {
        0: ([1.0], False), 1: ([2.0], False), 2: ([1.0], False), 3: (None, None), 4: ([0.0], False)
    }
    assert seen.value == 3
    assert run(texts(spark, "bb", "ccc", "ccc")) == {0: ([2.0], True), 1: ([3.0], False), 2: ([3.0], False)}
    assert seen.value == 4 and spark.table(name).count() == 4
    assert run(texts(spark, "a").limit(0)) == {}


def test_the_cache_side_is_not_moved(spark, cache):
    name, _ = cache
    embedding_cache.embed(texts(spark, *[f"t{n}" for n in range(50)]), name, lengths, "m", AS_OF).count()
    keys = texts(spark, "t1", "new").select(hashing.cache_key(F.col("text"), "m").alias("cache_key"))
    found = embedding_cache.look_up(keys, name)
    plan = found._jdf.queryExecution().executedPlan().toString()
    probe, stored = plan.split("Exchange", 1)[1].split("FileScan", 1)
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in probe and "Bucketed: true" in stored
    assert sorted(r.embedding is None for r in found.collect()) == [False, True]


def test_expiry_drops_folders(spark, cache):
    name, path = cache
    rows = [("k1", [1.0], when("2024-01-10 23:00:00")), ("k2", [2.0], when("2024-01-17 00:00:00")), ("k3", [3.0], when("2024-01-30 10:00:00"))]
    embedding_cache.add(spark.createDataFrame(rows, "cache_key string, embedding array<float>, created_at timestamp_ntz"), name)
    kept = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet") if "2024-01-10" not in str(f)}
    assert [str(d) for d in embedding_cache.expire(spark, name, path, AS_OF, 14)] == ["2024-01-10"]
    assert {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")} == kept
    assert sorted(r.cache_key for r in spark.table(name).collect()) == ["k2", "k3"]
    assert embedding_cache.expire(spark, name, path, AS_OF, 14) == []


def test_entries_before_the_limit_count_as_missing(spark, cache):
    name, _ = cache
    key = texts(spark, "old").select(hashing.cache_key(F.col("text"), "m").alias("cache_key"))
    old = key.select("cache_key", F.array(F.lit(9.0).cast("float")).alias("embedding"), F.lit("2024-01-10 10:00:00").cast("timestamp_ntz").alias("created_at"))
    embedding_cache.add(old, name)
    assert embedding_cache.embed(texts(spark, "old"), name, lengths, "m", AS_OF, days=14).first().embedding == [3.0]


def test_a_new_session_finds_what_is_stored(spark, cache):
    name, path = cache
    embedding_cache.embed(texts(spark, "a", "b"), name, lengths, "m", AS_OF).count()
    again = f"{name}_again"
    embedding_cache.open_cache(spark, again, path, 4)
    try:
        assert spark.table(again).count() == 2
        assert embedding_cache.embed(texts(spark, "a"), again, lengths, "m", AS_OF).first().from_cache
    finally:
        spark.sql(f"DROP TABLE {again}")


def test_texts_are_not_dealt_out_to_the_buckets(spark, cache, monkeypatch):
    """There are as many tasks as buckets, so what each of them reads must be narrow."""
    name, _ = cache
    dealt, look_up = [], embedding_cache.look_up
    monkeypatch.setattr(embedding_cache, "look_up", lambda keys, *a: dealt.append(keys.columns) or look_up(keys, *a))
    out = embedding_cache.embed(texts(spark, "a", "bb", "a", None), name, lengths, "m", AS_OF)
    assert {r.id: (r.embedding, r.from_cache) for r in out.collect()} == {0: ([1.0], False), 1: ([2.0], False), 2: ([1.0], False), 3: (None, None)}
    assert dealt == [["cache_key"]]
