"""Whole texts, whole periods, one result per question, work done once."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from helpers import AS_OF, item, items, when
from pressloom.functions import hashing
from pressloom.functions.text import similarity_text
from pressloom.operators import dedup, filters, registry, similarity, validate
from pressloom.plans import digests
from pressloom.sources import scratch, tables
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_texts_that_differ_late_are_different(spark):
    early = "same beginning " * 40
    df = items(spark, item("a", content=early + "one"), item("b", content=early + "two"))
    assert df.select(hashing.content_hash(F.col("content"))).distinct().count() == 2
    assert df.select(hashing.content_hash(F.col("content"), 500)).distinct().count() == 1
    assert df.select(similarity_text(F.col("title"), F.col("content"), F.lit("x"))).distinct().count() == 2
    new = items(spark, item("n", url="https://x.org/other", title="Title a", content=early + "two"))
    seen = registry.registry_rows(df.where("id = 'a'"))
    assert not dedup.match_registry(new, seen).first().is_duplicate


def test_validation_keeps_long_texts(spark):
    df = items(spark, item("a", content="w" * 60_000, title="t" * 900))
    good, _ = validate.validate_items(df)
    assert (len(good.first().content), len(good.first().title)) == (60_000, 900)
    cut, _ = validate.validate_items(df, {"content": 100})
    assert cut.first().content == "w" * 100 + "..."


def test_weeks_are_whole(spark):
    days = [item(f"d{d:02}", published_at=when(f"2024-01-{d:02} 10:00:00")) for d in range(1, 32)]
    weeks = filters.in_period(items(spark, *days), "weekly", "2024-01-10", "2024-01-24")
    assert {str(r.period): r["count"] for r in weeks.groupBy("period").count().collect()} == {
        "2024-01-08": 7, "2024-01-15": 7, "2024-01-22": 7,
    }


def test_digest_texts_come_from_their_days(spark, tmp_path):
    rows = [item(f"i{d}", published_at=when(f"2024-01-{d} 10:00:00")) for d in range(10, 30)]
    tables.write_items(items(spark, *rows), str(tmp_path / "items"))
    stored = tables.read_items(spark, str(tmp_path / "items"))
    pool, counts, best = digests._ranked(stored, "daily", "2024-01-20", "2024-01-20", digests.Weights(), {})
    from pressloom.operators import ranking

    plan = ranking.attach_columns(best, pool, ["title", "content"])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "content" in line]
    assert scans and all("published_date" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)
    few = digests.daily_digests(stored, AS_OF, "2024-01-20", "2024-01-20", texts=False)
    assert "content_markdown" not in few.records.columns and few.records.count() == 1


def test_ties_have_one_winner(spark):
    rows = [(f"c{i:02}", 5, [1.0, 0.0], when("2024-01-30 10:00:00")) for i in range(40)]
    query = spark.createDataFrame([("q", [1.0, 0.0], when("2024-01-30 11:00:00"))], "query_id string, embedding array<double>, published_at timestamp_ntz")
    random.seed(1)
    for parts in (1, 3, 7):
        random.shuffle(rows)
        cands = spark.createDataFrame(rows, "cand_id string, cand_pos long, embedding array<double>, published_at timestamp_ntz").repartition(parts)
        for found in (
            similarity.top_similar_small(query, cands, 0.9, 2),
            similarity.top_similar_large(query, cands, 0.9, 2, candidate_block=4),
            similarity.top_similar_large(query, cands, 0.9, 2, within_days=3, candidate_block=4),
        ):
            assert [r.cand_id for r in found.orderBy("rank").collect()] == ["c00", "c01"]
        whole = similarity.top_similar_large(query, cands, 0.9, None, candidate_block=4)
        assert whole.count() == similarity.top_similar_small(query, cands, 0.9).count() == 40


def test_items_without_vector_are_judged(spark):
    make = lambda key, v: (key, f"https://x.org/{key}", when("2024-01-30 10:00:00"), when("2024-01-30 11:00:00"), v)
    schema = "id string, url string, published_at timestamp_ntz, collected_at timestamp_ntz, embedding array<double>"
    new = spark.createDataFrame([make("a", None), make("b", [1.0, 0.0]), make("k", None)], schema)
    old = spark.createDataFrame([make("k", [0.0, 1.0]), make("o", [1.0, 0.0]), make("p", None)], schema)
    for cap in (None, 100):
        got = {r.id: r.match_type for r in dedup.dedup_batch_cascade(new, old, old, cap=cap).collect()}
        assert got == {"a": "none", "b": "similar_content", "k": "exact_url"}


def test_texts_are_embedded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts.map(lambda t: [float(len(t))])

    df = spark.createDataFrame([("a", "one"), ("b", "two two"), ("c", "one")], "id string, text string")
    cache = spark.createDataFrame([], "cache_key string, embedding array<float>, created_at timestamp_ntz")
    embedded, fresh = registry.embed_with_cache(df, cache, embed, "m", AS_OF)
    assert embedded.count() == 3 and fresh.count() == 2 and len(embedded.collect()) == 3
    assert seen.value == 2


def test_no_local_scratch_on_a_cluster():
    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(
        master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset))
    )
    session = SimpleNamespace(conf={}, sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_root(session)
    session.conf["spark.checkpoint.dir"] = "hdfs://shared"
    assert scratch.shared_root(session) == "hdfs://shared"


def test_scratch_goes_with_its_scope(spark):
    from pathlib import Path

    with scratch.temporary(spark):
        kept = scratch.cut_lineage(spark.range(3))
        folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
        assert kept.count() == 3 and folder.exists()
    assert not folder.exists()


def test_nested_hidden_elements(one):
    from pressloom.operators import screening

    pages = {
        '<p>a</p><div style="display:none">b<div>c</div>d<p>e</p></div><p>f</p>': "af",
        "<DIV style='visibility: hidden'><div><div>x</div></div></DIV>rest": "rest",
        '<p style="display:none">x</p>y<p style="display: none">never closed': "ynever closed",
        '<span style="display:none">x</span><b>y</b><i style="color:red">z</i>': "yz",
        "no tags at all": "no tags at all", None: "",
    }
    assert one(screening.visible_text, list(pages)) == list(pages.values())
