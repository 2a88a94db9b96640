"""Stored tables that are brought up to date in parts: key index, replaced partitions, counts by batch."""

import os
from pathlib import Path

import pytest
from helpers import days_before, item, items
from pyspark.sql import functions as F

from pressloom.operators import partials, stats
from pressloom.plans import digests
from pressloom.sources import files, keyindex, tables
from pressloom.streaming import feeds as streams


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stamps(path):
    """When each data file below ``path`` was written, and its name, which is new with every write."""
    return {str(f): os.stat(f).st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    path = str(tmp_path / "keys")
    keyindex.write_keys(items(spark, *[item(f"i{n}", url=f"u{n}") for n in range(200)]), path, 0)
    batch = items(spark, item("new", url="u7"), item("i9", url="other"))
    found = keyindex.known(batch, path, "url")
    filters = plan(found).split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters
    wanted = [keyindex.bucket_of(F.lit(u)) for u in ("u7", "other")]
    buckets = {v for v in spark.range(1).select(*wanted).first()}
    read = {Path(r[0]).parent.name for r in found.select(F.input_file_name()).distinct().collect()}
    assert read <= {f"bucket={b}" for b in buckets} and len(list(Path(path).rglob("bucket=*"))) == keyindex.BUCKETS
    assert [r.id for r in found.where("url = 'u7'").collect()] == ["i7"]
    assert [r.id for r in keyindex.known(batch, path, "id").where("id = 'i9'").collect()] == ["i9"]


def test_key_files_have_bloom_filters(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "keys")
    keyindex.write_keys(items(spark, *[item(f"i{n}") for n in range(500)]), path, 0, buckets=2)
    (file, *_) = Path(path).rglob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    group = meta.row_group(0)
    columns = sum(group.column(c).total_compressed_size for c in range(group.num_columns))
    assert 8_000 < file.stat().st_size - columns < 60_000 and meta.num_rows > 100


def test_writing_a_batch_of_keys_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "keys")
    first, second = items(spark, item("a"), item("b")), items(spark, item("c"))
    for n, part in ((0, first), (1, second), (0, first)):
        keyindex.write_keys(part, path, n)
    probe = items(spark, item("a"), item("b"), item("c"), item("d"))
    ids = lambda **k: sorted(r.id for r in keyindex.known(probe, path, "id", **k).collect())
    assert ids() == ["a", "b", "c"] and ids(before=1) == ["a", "b"]
    assert keyindex.known(probe, str(tmp_path / "none"), "id").count() == 0
    assert keyindex.known(probe.where("false"), path, "id").count() == 0
    keyindex.compact(spark, path, 2)
    assert files.numbers(spark, path, "batch_id=") == [-2] and ids() == ["a", "b", "c"]
    keyindex.write_keys(items(spark, item("d")), path, 2)
    keyindex.compact(spark, path, 2)
    assert ids() == ["a", "b", "c", "d"] and ids(before=2) == ["a", "b", "c"]


def test_sink_looks_keys_up_in_the_index(spark, tmp_path):
    where = {n: str(tmp_path / n) for n in ("items", "registry", "keys")}
    sink = streams.item_sink(where["items"], where["registry"], keys_path=where["keys"])
    parts = [items(spark, item("a", url="u"), item("b"), item("z", url=None)), items(spark, item("c", url="u"), item("d"), item("b", url="new"))]
    stored = lambda: sorted(r.id for r in tables.read_items(spark, where["items"]).collect())
    for n in (0, 1, 1, 0):
        sink(parts[n], n)
    assert stored() == ["a", "b", "d", "z"]
    held = spark.read.parquet(where["keys"]).where("kind = 'id'")
    assert sorted(r.key for r in held.collect()) == ["a", "b", "d", "z"]


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "v string, made int, day string")
    files.replace_partitions(rows(("old", 1, "a"), ("old", 1, "b")), path, ["day"])
    before = stamps(path)
    held = lambda: sorted((r.day, r.v, r.made) for r in spark.read.parquet(path).collect())
    files.replace_partitions(rows(("new", 2, "b"), ("new", 2, "c")), path, ["day"], force=False)
    assert held() == [("a", "old", 1), ("b", "old", 1), ("c", "new", 2)]
    assert before.items() <= stamps(path).items()
    files.replace_partitions(rows(("newer", 3, "b")), path, ["day"], kept=("made",))
    assert held() == [("a", "old", 1), ("b", "newer", 1), ("c", "new", 2)]
    after = stamps(path)
    assert {f: t for f, t in before.items() if "day=a" in f}.items() <= after.items()
    assert not any(f in after for f in before if "day=b" in f)
    files.replace_partitions(rows(("none", 4, None)), path, ["day"])
    files.replace_partitions(rows(("null", 5, None)), path, ["day"])
    assert [r.v for r in spark.read.parquet(path).where("day IS NULL").collect()] == ["null"]
    files.replace_partitions(rows(("x", 9, "a")).where("false"), path, ["day"])
    assert len(held_days(spark, path)) == 4


def held_days(spark, path):
    return spark.read.parquet(path).select("day").distinct().collect()


@pytest.mark.parametrize("force", [False, True])
def test_stored_digests_equal_merged_ones(spark, tmp_path, force):
    pool = items(spark, *[item(f"i{n}", source=f"s{n % 3}", published_at=days_before(n / 4)) for n in range(24)])
    few = digests.daily_digests(pool.where("id < 'i2'"), "2024-01-29 00:00:00", texts=False)
    every = digests.daily_digests(pool.where("published_at >= '2024-01-27'"), "2024-02-01 00:00:00", texts=False)
    root = str(tmp_path)
    digests.store_digests(few, root, "daily")
    before = stamps(f"{root}/daily")
    digests.store_digests(every, root, "daily", force)
    wanted = digests.merge_digests(few.records, every.records, "digest_date", force)
    entries = digests.merge_entries(few.entries, every.entries, force)
    same = lambda path, df: sorted(map(str, spark.read.schema(df.schema).parquet(path).select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert same(f"{root}/daily", wanted) and same(f"{root}/entries", entries)
    touched = {str(r[0]) for r in every.records.select("digest_date").collect()}
    kept = {f: t for f, t in before.items() if not force or not any(d in f for d in touched)}
    assert kept and kept.items() <= stamps(f"{root}/daily").items()


def test_flags_rewrite_only_days_with_duplicates(spark, tmp_path):
    path = str(tmp_path / "items")
    tables.write_items(items(spark, *[item(f"i{n}", published_at=days_before(n)) for n in range(6)]), path)
    before = stamps(path)
    verdicts = spark.createDataFrame([("i1", True, "i5"), ("i2", False, None), ("gone", True, "i5")], "id string, is_duplicate boolean, original_id string")
    days = tables.flag_stored(spark, path, verdicts)
    assert [str(d) for d in days] == ["2024-01-30"]
    rows = {r.id: (r.is_duplicate, r.duplicate_of, r.content) for r in tables.read_items(spark, path).collect()}
    assert rows.pop("i1") == (True, "i5", "c" * 600) and {v[:2] for v in rows.values()} == {(False, None)} and len(rows) == 5
    kept = {f: t for f, t in before.items() if "2024-01-30" not in f}
    assert len(kept) == 5 and kept.items() <= stamps(path).items()
    assert tables.flag_stored(spark, path, verdicts.where("false")) == []


def listed(df, *maps):
    out = df.withColumns({m: F.array_sort(F.map_entries(m)) for m in maps})
    return sorted(map(str, out.select(*sorted(out.columns)).collect()))


def test_rollups_follow_batches_in_any_order(spark, tmp_path):
    root = str(tmp_path)
    part = lambda n, shift: [
        item(f"{n}-{i}", source=f"s{i % 3}", tags=["x", f"t{i % 2}"] if i % 4 else None, is_duplicate=i % 5 == 0, published_at=days_before(shift + i / 3)) for i in range(12)
    ]
    batches = {0: part(0, 0), 1: part(1, 9), 2: part(2, 3), 3: [item("undated", published_at=None)]}
    for n in (2, 0, 3, 1, 0):
        partials.roll(items(spark, *batches[n]), root, n)
    every = items(spark, *[r for rows in batches.values() for r in rows if r["published_at"]])
    daily, weekly = (spark.read.parquet(f"{root}/{k}") for k in ("daily", "weekly"))
    assert listed(daily, "sources_summary") == listed(stats.daily_rollup(every), "sources_summary")
    assert listed(weekly, "sources_breakdown") == listed(stats.weekly_rollup(every), "sources_breakdown")
    # A batch that comes again with less: days without items go, others of its weeks are made anew.
    before = stamps(f"{root}/daily")
    partials.roll(items(spark, *batches[1][:1]), root, 1)
    left = items(spark, *batches[0], *batches[2], *batches[1][:1])
    daily, weekly = (spark.read.parquet(f"{root}/{k}") for k in ("daily", "weekly"))
    assert listed(daily, "sources_summary") == listed(stats.daily_rollup(left), "sources_summary")
    assert listed(weekly, "sources_breakdown") == listed(stats.weekly_rollup(left), "sources_breakdown")
    untouched = {f: t for f, t in before.items() if "2024-01-30" in f or "2024-01-29" in f}
    assert untouched and untouched.items() <= stamps(f"{root}/daily").items()
