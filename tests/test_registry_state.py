"""The registry kept as state of a stream, against batch upsert and expiry."""

import random
from datetime import timedelta

from helpers import item, items, when
from pyspark.sql import functions as F

from pressloom.operators import registry
from pressloom.streaming import registry_state


def batches():
    """Sightings of 30 urls over 30 days in three batches, some late, some urls gone for long and then back."""
    random.seed(3)
    start, out = when("2024-01-01 00:00:00"), []
    for n in range(3):
        rows = []
        for k in range(40):
            at = start + timedelta(days=10 * n + random.uniform(-3 if n else 0, 10), microseconds=random.randrange(10**6))
            rows.append(item(f"{n}-{k}", url=f"u{random.randrange(30)}", title=f"t{k}", collected_at=at))
        out.append(rows)
    return out


def plain(parts, days):
    """url: (first, last, count, id of the first), batch by batch."""
    live, newest = {}, None
    for rows in parts:
        if newest is not None:
            limit = newest - timedelta(days=days)
            # Watermarks are whole milliseconds.
            limit = limit.replace(microsecond=limit.microsecond // 1000 * 1000)
            live = {u: v for u, v in live.items() if v[1] >= limit}
            rows = [r for r in rows if r["collected_at"] >= limit]
        for r in rows:
            at, old = r["collected_at"], live.get(r["url"])
            first = min((old[0], old[3]), (at, r["id"])) if old else (at, r["id"])
            live[r["url"]] = (first[0], max(old[1], at) if old else at, old[2] + 1 if old else 1, first[1])
        newest = max([r["collected_at"] for r in rows] + ([newest] if newest else []))
    limit = newest - timedelta(days=days)
    return {u: v for u, v in live.items() if v[1] >= limit}


def test_state_equals_batches_over_restarts(spark, tmp_path):
    arrivals, state = str(tmp_path / "in"), str(tmp_path / "state")
    parts = batches()
    schema = items(spark, item("x")).schema
    for n, rows in enumerate(parts):
        items(spark, *rows).coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(schema).parquet(arrivals)
        registry_state.keep_registry(stream, state, 6).awaitTermination()  # a new query from the same checkpoint
        found = registry_state.live_registry(spark, state).collect()
        wanted = plain(parts[: n + 1], 6)
        hashes = {r.u: r.h for r in spark.createDataFrame([(u,) for u in wanted], "u string").select("u", F.sha2("u", 256).alias("h")).collect()}
        assert {r.url_hash: (r.first_seen_at, r.last_seen_at, r.occurrence_count, r.news_item_id) for r in found} == {
            hashes[u]: v for u, v in wanted.items()
        }
        assert len(found) == len(wanted)  # state rows are the live keys
    assert len(wanted) < 30


def test_without_expiry_it_is_the_upsert(spark, tmp_path):
    arrivals, rows = str(tmp_path / "in"), [r for part in batches() for r in part]
    items(spark, *rows).write.parquet(arrivals)
    stream = spark.readStream.schema(items(spark, item("x")).schema).parquet(arrivals)
    changes = []
    sink = lambda df, n: changes.extend(df.collect())
    registry_state.keep_registry(stream, str(tmp_path / "state"), 100, sink).awaitTermination()
    live = registry_state.live_registry(spark, str(tmp_path / "state"))
    whole = registry.merge_registry(registry.registry_rows(items(spark, *rows))).select(*live.columns)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, whole.collect()))
    assert {r.url_hash for r in changes} == {r.url_hash for r in live.collect()} and not any(r.removed for r in changes)


def test_python_is_called_for_rows_of_many_keys(spark, tmp_path, monkeypatch):
    """The state rows, and with them the calls, are bounded whatever the number of keys; none is left when all keys are gone."""
    monkeypatch.setattr(registry_state, "BUCKETS", 4)
    arrivals, state = str(tmp_path / "in"), str(tmp_path / "state")
    at = when("2024-01-10 00:00:00")
    later = at + timedelta(days=30)
    for rows in ([item(f"a{k}", url=f"u{k % 50}", collected_at=at) for k in range(60)], [item("z", url=None, collected_at=later), item("y", url="u1", collected_at=later)]):
        items(spark, *rows).coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(items(spark, item("x")).schema).parquet(arrivals)
        changes = []
        registry_state.keep_registry(stream, state, 6, lambda df, n: changes.extend(df.collect())).awaitTermination()
        live = registry_state.live_registry(spark, state).collect()
        assert spark.read.format("statestore").option("path", state).load().count() <= 4
        assert len(live) == (50 if len(rows) == 60 else 2)
    assert sorted(r.occurrence_count for r in live) == [1, 3] and sum(r.removed for r in changes) == 49
    assert {r.url_hash is None for r in live} == {True, False}
