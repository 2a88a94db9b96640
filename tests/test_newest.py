"""The newest stored items without reading older days."""

import random
from pathlib import Path

import pytest
from helpers import AS_OF, days_before, item, items

from pressloom.operators import filters
from pressloom.sources import files, tables


def stored(spark, path, n=60, seed=1):
    random.seed(seed)
    some = [item(f"i{k}", source=random.choice("ab"), published_at=days_before(random.randrange(14) + 0.25), is_duplicate=k % 7 == 0) for k in range(n)]
    df = items(spark, *some, item("undated", published_at=None))
    tables.write_items(df, path)
    return df


@pytest.mark.parametrize("limit", [1, 5, 25, 1000])
@pytest.mark.parametrize("source", [None, "a", "none"])
def test_as_the_sort(spark, tmp_path, limit, source):
    path = str(tmp_path / "items")
    df = stored(spark, path)
    ids = lambda found: [r.id for r in found.select("id").collect()]
    assert ids(tables.newest_items(spark, path, AS_OF, limit, 10, source)) == ids(filters.recent(df, AS_OF, 10, source, limit))


def test_older_days_are_not_read(spark, tmp_path):
    path = str(tmp_path / "items")
    df = stored(spark, path)
    days = files.days(spark, path, "published_date")
    assert days == sorted(days, reverse=True) and len(days) > 10
    for day in days[3:]:
        for f in Path(path, f"published_date={day}").glob("*.parquet"):
            f.write_bytes(b"not a parquet file")
            Path(f.parent, f".{f.name}.crc").unlink(missing_ok=True)
    found = [r.id for r in tables.newest_items(spark, path, AS_OF, 4, 30).select("id").collect()]
    assert found == [r.id for r in filters.recent(df, AS_OF, 30, limit=4).select("id").collect()]


def test_tables_by_batch_and_none(spark, tmp_path):
    path = str(tmp_path / "items")
    first, second = stored(spark, f"{path}/batch_id=000000000", 20, 2), stored(spark, f"{path}/batch_id=000000001", 20, 3)
    found = tables.newest_items(spark, path, AS_OF, 7, 30).select("published_at", "id").collect()
    both = filters.recent(first.union(second), AS_OF, 30, limit=7).select("published_at", "id").collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in both]
    tables.write_items(items(spark, item("x", published_at=None)), str(tmp_path / "undated"))
    assert tables.newest_items(spark, str(tmp_path / "undated"), AS_OF, 7).count() == 0
