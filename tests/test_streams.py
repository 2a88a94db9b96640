"""Streams over the tables, whether a table is one file or a folder of files."""

import re
import shutil

import pytest
from helpers import days_before, item, items
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pressloom.catalog import flows
from pressloom.sources import tables
from pressloom.streaming import feeds as streams


def as_file(df, path):
    df.coalesce(1).write.parquet(f"{path}.folder")
    (part,) = path.parent.glob(f"{path.name}.folder/part-*")
    shutil.copy(part, path)


def as_folder(df, path):
    df.repartition(4).write.parquet(str(path))


@pytest.fixture(params=[as_file, as_folder])
def sf(spark, tmp_path, request):
    docs = spark.range(60).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("title "), (F.col("id") % 45).cast("string"), F.lit("\nbody")).alias("text"),
        F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(10).cast("long").alias("n_chars"),
    )
    folder = tmp_path / "tables"
    folder.mkdir()
    request.param(docs, folder / "documents.parquet")
    return str(folder)


def test_a_stream_has_the_rows_of_its_table(spark, sf):
    assert flows._run(flows._stream(spark, sf, "documents").select("doc_id")).count() == 60


def test_unique_items(spark, sf):
    assert entry.queries()["str2_unique_items"](spark, sf).count() == 45


def test_item_sink(spark, sf):
    rows = entry.queries()["str4_item_sink"](spark, sf).collect()
    assert len(rows) == 45 and sum(r.occurrence_count for r in rows) == 60


def test_a_sink_that_nothing_has_reached_is_empty(spark, tmp_path):
    folder, schema = tmp_path / "in", items(spark, item("a")).schema
    folder.mkdir()
    where = {n: str(tmp_path / n) for n in ("items", "registry", "state")}
    stream = spark.readStream.schema(schema).parquet(str(folder))
    streams.run_item_stream(stream, streams.item_sink(where["items"], where["registry"]), where["state"]).awaitTermination()
    assert streams.stored_items(spark, where["items"], schema).count() == 0
    assert streams.registry_now(spark, where["registry"]).count() == 0


@pytest.mark.parametrize("day_bytes", [8 << 20, 1_500])
def test_new_items_by_day_are_the_new_items(spark, monkeypatch, day_bytes):
    monkeypatch.setattr(tables, "DAY_BYTES", day_bytes)
    made = [item(f"i{n % 30}", url=f"u{n % 37}", title=f"t{n}", published_at=days_before(n * 7 % 11 / 2)) for n in range(120)]
    made += [item(None), item("y", published_at=None), item("y"), item("z", url=None), item("z", url=None), item("twice"), item("twice")]
    batch = items(spark, *made)
    stored = items(spark, item("i3", url="v"), item("w", url="u5")).select("id", "url")
    kept = batch.where("id IS NULL OR id != 'i7'")
    rows = lambda df: sorted(map(str, df.select(*batch.columns, F.to_date("published_at")).collect()))
    got = tables.new_items_by_day(batch, kept, stored)
    assert rows(got) == rows(tables.new_items(kept, stored)) and got.where("NOT published_date <=> to_date(published_at)").count() == 0


def test_the_item_sink_moves_whole_items_once(spark, tmp_path, monkeypatch):
    plans = []
    write = tables.write_dated
    monkeypatch.setattr(tables, "write_dated", lambda df, *a, **k: (plans.append(df), write(df, *a, **k)))
    streams.item_sink(str(tmp_path / "items"), str(tmp_path / "registry"))(items(spark, item("a"), item("b")), 0)
    (df,) = plans
    told = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", told)
    assert moved and sum("content#" in columns for columns in moved) == 1
