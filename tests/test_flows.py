"""Ingestion of batches and streams, with replays."""

import pytest
from helpers import AS_OF, days_before, item, items, rows
from pyspark.sql import functions as F

from pressloom.operators import dedup, registry
from pressloom.plans import ingest
from pressloom.sources import scratch, tables
from pressloom.streaming import feeds as streams


def with_vectors(df, v=(1.0, 0.0)):
    return df.withColumn("embedding", F.array(*[F.lit(float(x)) for x in v]))


def test_ingest(spark):
    stored = with_vectors(items(spark, item("o1", url="u1", published_at=days_before(2)), item("o2", published_at=days_before(29)), item("o3", is_duplicate=True)))
    batch = with_vectors(items(
        spark, item("n1", url="u1"), item("n2", url="same", published_at=days_before(1)), item("n3", url="same", published_at=days_before(2)),
        item("n4", published_at=days_before(0.5))), (0.0, 1.0)).drop("is_duplicate", "duplicate_of")
    like_old = with_vectors(items(spark, item("n5", published_at=days_before(1)))).drop("is_duplicate", "duplicate_of")
    failed = spark.createDataFrame([("f",)], "source string")
    out = ingest.ingest(batch.unionByName(like_old), stored, dedup.candidates(stored, AS_OF), "run-7", AS_OF, failed=failed)
    got = {r.id: (r.is_duplicate, r.original_id, r.match_type) for r in out.verdicts.collect()}
    assert got == {"n1": (True, "o1", "exact_url"), "n2": (True, "n3", "exact_url"), "n3": (False, None, "none"),
                   "n4": (False, None, "none"), "n5": (True, "o1", "similar_content")}
    assert sorted(r.id for r in out.added.collect()) == ["n3", "n4"]
    assert rows(out.links, "item_id") == [("run-7", "n3"), ("run-7", "n4")]
    assert rows(out.counters) == [(5, 2, 3, ["f"])]
    assert out.registry_rows.count() == 2
    (run,) = out.run.collect()
    assert (run.run_id, run.new_items, run.failed_sources) == ("run-7", 2, ["f"])
    assert out.run_sources is None


def test_one_url_for_most_of_the_batch(spark):
    batch = items(spark, *[item(f"n{i:03d}", url="hot" if i % 3 else f"u{i}", published_at=days_before(i / 100)) for i in range(1, 100)])
    judged = dedup.match_url(batch.drop("is_duplicate"), items(spark, item("o")), hot_rows=5)
    out = ingest.same_url_in_batch(judged)
    assert out.count() == 99 and out.where("not is_duplicate").count() == 34
    assert {r.original_id for r in out.where("is_duplicate").collect()} == {"n098"}


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert scratch.scratch_path(spark, "x").startswith(named.rstrip("/"))
    fixed = scratch.cut_lineage(spark.range(5))
    assert fixed.count() == 5 and "Range" not in fixed._jdf.queryExecution().optimizedPlan().toString()


def arrivals(spark, path, *parts):
    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("overwrite").parquet(f"{path}/{n}")
    return f"{path}/*"


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_items_are_dropped(spark, tmp_path):
    first = items(spark, item("a", published_at=days_before(1)))
    path = arrivals(spark, str(tmp_path / "in"), first, items(spark, item("b", published_at=days_before(2)), item("a", published_at=days_before(1))),
                    items(spark, item("late", published_at=days_before(20)), item("c", published_at=days_before(3))))
    stream = streams.unique_items(stream_of(spark, path, first.schema)).select("id")
    streams.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_counts_by_day_like_the_batch(spark, tmp_path):
    parts = [items(spark, *[item(f"{n}-{i}", source=f"s{i % 2}", published_at=days_before(20 - n * 6 - i / 4)) for i in range(8)]) for n in range(3)]
    path = arrivals(spark, str(tmp_path / "in"), *parts)
    stream = streams.counts_by_day(stream_of(spark, path, parts[0].schema), max_age="2 days")
    streams.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.day, r.source): r.n_items for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    everything = parts[0].union(parts[1]).union(parts[2])
    latest = everything.agg(F.max("published_at")).first()[0]
    batch = everything.groupBy(F.to_date("published_at").alias("day"), "source").count().collect()
    closed = {(r.day, r.source): r["count"] for r in batch if (latest.date() - r.day).days >= 3}
    assert closed.items() <= got.items() and set(got) <= {(r.day, r.source) for r in batch}


def test_item_sink_and_replay(spark, tmp_path):
    parts = [items(spark, item("a", url="u"), item("b")), items(spark, item("c", url="u"), item("d"), item("d"))]
    path = arrivals(spark, str(tmp_path / "in"), *parts)
    where = {n: str(tmp_path / n) for n in ("items", "registry", "state")}
    sink = streams.item_sink(where["items"], where["registry"])
    streams.run_item_stream(stream_of(spark, path, parts[0].schema), sink, where["state"]).awaitTermination()
    state = lambda: (sorted(r.id for r in streams.stored_items(spark, where["items"], parts[0].schema).collect()),
                     sorted(r.occurrence_count for r in streams.registry_now(spark, where["registry"]).collect()))
    assert state() == (["a", "b", "d"], [1, 2, 2])
    sink(parts[1], 1)
    sink(parts[0], 0)
    assert state() == (["a", "b", "d"], [1, 2, 2])


def test_item_sink_with_a_judge(spark, tmp_path):
    batch = items(spark, item("a", title="keep"), item("b", title="drop"))
    sink = streams.item_sink(str(tmp_path / "i"), str(tmp_path / "r"), judge=lambda new, stored: new.where("title = 'keep'"))
    sink(batch, 0)
    assert [r.id for r in streams.stored_items(spark, str(tmp_path / "i"), batch.schema).collect()] == ["a"]


def test_item_sink_judges_by_url_and_meaning(spark, tmp_path):
    vector = lambda df, **by_id: df.withColumn("embedding", F.coalesce(*[
        F.when(F.col("id") == k, F.array(*map(F.lit, v))) for k, v in by_id.items()
    ]))
    first = vector(items(spark, item("a"), item("b")), a=[1.0, 0.0], b=[0.0, 1.0])
    second = vector(items(spark, item("c"), item("d", url="https://x.org/b"), item("e"), item("f")), c=[1.0, 0.01], d=[1.0, 1.0], e=[-1.0, 0.3])
    path = str(tmp_path / "items")
    sink = streams.item_sink(path, str(tmp_path / "registry"))
    stored = lambda: sorted(r.id for r in tables.read_items(spark, path).collect())
    sink(first, 0)
    sink(second, 1)
    assert stored() == ["a", "b", "e", "f"]
    sink(second, 1)
    assert stored() == ["a", "b", "e", "f"]
    plan = tables.read_items(spark, path).where("published_date = DATE'2024-01-30'")._jdf.queryExecution().executedPlan().toString()
    assert "published_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_registry_parts_merge_in_any_order(spark, order):
    parts = [registry.registry_rows(items(spark, item(f"i{n}", url="u", collected_at=days_before(n)))) for n in range(3)]
    (row,) = registry.merge_registry(*[parts[i] for i in order]).collect()
    assert (row.news_item_id, row.occurrence_count, row.last_seen_at) == ("i2", 3, days_before(0))


def test_append_is_safe_when_reading_its_own_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_items(items(spark, item("a")), path)
    added = tables.append_items(items(spark, item("b")), tables.read_items(spark, path), path)
    assert [r.id for r in added.collect()] == ["b"]


@pytest.mark.parametrize("small", [True, False])
def test_thinning_a_table_changes_no_result(spark, small):
    from pressloom.operators.skew import only_keys_of

    table = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").alias("v"))
    probe = spark.createDataFrame([(1,), (1,), (77,)], "k long")
    kept = only_keys_of(table, probe, ["k"], small)
    assert kept.count() == (10 if small else 100)
    assert kept.where("k = 1").count() == 10
