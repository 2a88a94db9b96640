"""Deduplication on small tables, also with keys that hold most of the rows."""

from collections import Counter

import pytest
from helpers import AS_OF, days_before, item, items, rows, when
from pyspark.sql import functions as F

from pressloom.operators import dedup, registry
from pressloom.operators.skew import first_per, lookup_join


def verdicts(df):
    return {r.id: (r.is_duplicate, r.original_id, round(r.similarity_score, 4), r.match_type) for r in df.collect()}


def test_item_id_is_made_only_when_missing(spark):
    df = spark.createDataFrame([("given", "u", "t"), (None, "u", "t"), ("", "u", "t")], "id string, url string, title string")
    made = [r.id for r in dedup.with_item_id(df).collect()]
    assert made[0] == "given" and made[1] == made[2] and len(made[1]) == 64


def test_batch_keeps_the_first_in_feed_then_entry_order(spark):
    df = spark.createDataFrame([("a", 2, 1, "x"), ("a", 1, 9, "y"), ("b", 1, 2, "z"), ("b", 1, 1, "w")],
                               "id string, feed_pos int, entry_pos int, mark string")
    assert rows(dedup.dedup_batch(df).select("id", "mark"), "id") == [("a", "y"), ("b", "w")]


def test_first_per_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 2)
    plan = first_per(df, ["k"], [F.asc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("hot_rows", [2, 7, 1000])
def test_lookup_join_with_hot_keys(spark, hot_rows):
    probe = spark.range(300).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = spark.createDataFrame([("hot", 1), ("1", 2), ("none", 3)], "k string, v int")
    got = {r.n: r.v for r in lookup_join(probe, table, ["k"], ["n"], hot_rows=hot_rows).collect()}
    assert len(got) == 300 and got == {n: 1 if n % 3 == 0 else 2 if n == 1 else None for n in range(300)}


def test_lookup_join_spreads_a_hot_key(spark):
    probe = spark.range(1000).select(F.col("id").alias("n"), F.lit("hot").alias("k"))
    table = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(probe, table, ["k"], ["n"], hot_rows=50)
        sizes = Counter(r.p for r in joined.select(F.spark_partition_id().alias("p")).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 3 and max(sizes.values()) < 600


def test_url_match(spark):
    old = items(spark, item("o1", url="u", collected_at=days_before(3)), item("o2", url="u", collected_at=days_before(9)))
    new = items(spark, item("n1", url="u"), item("n2", url="v"))
    assert verdicts(dedup.match_url(new, old)) == {"n1": (True, "o2", 1.0, "exact_url"), "n2": (False, None, 0.0, "none")}


def test_registry_match_takes_the_earliest_of_several(spark):
    old = items(spark, item("o1", title="A", content="same", collected_at=days_before(1)),
                item("o2", title="a", content="SAME", collected_at=days_before(5)),
                item("o3", title="A", content="other"))
    new = items(spark, item("n1", title="a", content="Same"), item("n2", url="https://x.org/o1", title="zz"),
                item("n3", title="A", content="third"))
    got = verdicts(dedup.match_registry(new, registry.merge_registry(registry.registry_rows(old))))
    assert got == {"n1": (True, "o2", 1.0, "exact_title"), "n2": (True, "o1", 1.0, "exact_title"), "n3": (False, None, 0.0, "none")}


def test_find_duplicates_counts_like_the_pairwise_check(spark):
    old = [item(f"o{i}", url=f"u{i % 4}", title="Same" if i % 2 else f"T{i}", collected_at=days_before(i)) for i in range(12)]
    new = [item(f"n{i}", url=f"u{i}", title="sAME" if i % 2 else f"t{i}") for i in range(6)]
    got = {r.id: (r.n_matches, r.n_url_matches, r.n_title_matches, r.first_match_id)
           for r in dedup.find_duplicates(items(spark, *new), items(spark, *old), AS_OF, 7, hot_rows=2).collect()}
    for n in new:
        live = [o for o in old if o["collected_at"] >= days_before(7)]
        by_url = [o for o in live if o["url"] == n["url"]]
        by_title = [o for o in live if o["title"].lower() == n["title"].lower()]
        hits = {o["id"]: o for o in by_url + by_title}
        first = min(hits.values(), key=lambda o: (o["collected_at"], o["id"]))["id"] if hits else None
        assert got[n["id"]] == (len(hits), len(by_url), len(by_title), first)


def test_matching_history_includes_flagged_items_and_the_cutoff(spark):
    old = items(spark, item("o1", url="u", is_duplicate=True), item("o2", title="NEW", collected_at=days_before(7)),
                item("o3", url="u", collected_at=days_before(7.1)), item("o4"))
    new = items(spark, item("n", url="u", title="new"))
    got = rows(dedup.matching_history(new, old, AS_OF, 7).select("id", "same_url", "same_title"), "id")
    assert got == [("o1", True, False), ("o2", False, True)]


def embedded(spark, *rows_):
    base = items(spark, *[r for r, _ in rows_])
    vecs = spark.createDataFrame([(r["id"], v) for r, v in rows_], "id string, embedding array<float>")
    return base.join(vecs, "id")


A, B, NEAR_A = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.2, 0.0]


def test_semantic_gate_applies_to_the_best_only(spark):
    cands = embedded(spark, (item("far", published_at=when("2024-01-10 00:00:00")), A), (item("near"), NEAR_A))
    new = embedded(spark, (item("n"), A)).drop("is_duplicate")
    assert verdicts(dedup.match_semantic(new, cands, 0.9)) == {"n": (False, None, 0.0, "none")}
    first = verdicts(dedup.match_semantic(new, cands, 0.9, gate="before_best"))
    assert first["n"][:2] == (True, "near") and first["n"][3] == "similar_content"


@pytest.mark.parametrize("gate", ["after_best", "before_best"])
def test_semantic_gate_is_inclusive(spark, gate):
    cands = embedded(spark, (item("o", published_at=when("2024-01-23 10:00:00")), A))
    new = embedded(spark, (item("n"), A), (item("late", published_at=when("2024-01-30 10:00:01")), A)).drop("is_duplicate")
    got = verdicts(dedup.match_semantic(new, cands, 0.9, gate=gate))
    assert got["n"][0] and not got["late"][0]


def test_cascade_order_and_empty_candidates(spark):
    old = embedded(spark, (item("o1", url="u1"), B), (item("o2", title="T", content="x"), B), (item("o3"), A))
    new = embedded(spark, (item("n1", url="u1"), A), (item("n2", title="t", content="X"), A), (item("n3"), A),
                   (item("n4"), [0.0, 0.0, 1.0]), (item("n5"), [0.0, 0.0, 0.0])).drop("is_duplicate")
    seen = registry.merge_registry(registry.registry_rows(old))
    cands = dedup.candidates(old, AS_OF)
    kinds = {k: v[3] for k, v in verdicts(dedup.dedup_cascade(new, old, seen, cands)).items()}
    assert kinds == {"n1": "exact_url", "n2": "exact_title", "n3": "similar_content", "n4": "none", "n5": "none"}
    kinds = {k: v[3] for k, v in verdicts(dedup.dedup_batch_cascade(new, old, cands)).items()}
    assert kinds["n2"] == "similar_content"
    kinds = {k: v[3] for k, v in verdicts(dedup.dedup_batch_cascade(new, old, cands.where("false"))).items()}
    assert kinds == {"n1": "exact_url", "n2": "none", "n3": "none", "n4": "none", "n5": "none"}


def test_candidates_are_the_newest_originals(spark):
    old = items(spark, *[item(f"o{i}", published_at=days_before(i)) for i in range(1, 6)], item("dup", is_duplicate=True),
                item("old", published_at=days_before(31)))
    assert [r.id for r in dedup.candidates(old, AS_OF, cap=3).collect()] == ["o1", "o2", "o3"]
    assert dedup.candidates(old, AS_OF, cap=None).count() == 5


def test_flag_duplicates(spark):
    got = dedup.flag_duplicates(items(spark, item("a"), item("b", is_duplicate=True, duplicate_of="z")), spark.createDataFrame(
        [("a", True, "o"), ("b", False, None)], "id string, is_duplicate boolean, original_id string"))
    assert rows(got.select("id", "is_duplicate", "duplicate_of"), "id") == [("a", True, "o"), ("b", True, "z")]


def test_registry_upsert_counts_and_keeps_first_fields(spark):
    first = registry.upsert_registry(registry.registry_rows(items(spark).limit(0)), items(spark, item("a", url="u", title="A", collected_at=days_before(3))))
    second = registry.upsert_registry(first, items(spark, item("b", url="u", title="B", collected_at=days_before(1)), item("c")))
    got = {r.news_item_id: r for r in second.collect()}
    assert set(got) == {"a", "c"}
    assert (got["a"].occurrence_count, got["a"].first_seen_at, got["a"].last_seen_at) == (2, days_before(3), days_before(1))
    assert got["a"].title_hash != got["c"].title_hash


def test_registry_expiry_is_strict(spark):
    reg = registry.registry_rows(items(spark, item("a", collected_at=days_before(30)), item("b", collected_at=days_before(30.01))))
    assert [r.news_item_id for r in registry.expire_registry(reg, AS_OF).collect()] == ["a"]
    assert rows(registry.expired_count(reg, AS_OF, 30)) == [(1, 1)]


def test_embed_only_what_is_missing(spark):
    from pressloom.catalog.duplicates import stand_in_embedder

    df = spark.createDataFrame([("1", "a b"), ("2", "a b"), ("3", "c")], "id string, text string")
    none = spark.createDataFrame([], "cache_key string, embedding array<float>, created_at timestamp_ntz")
    all_new, fresh = registry.embed_with_cache(df, none, stand_in_embedder, "m", AS_OF)
    assert fresh.count() == 2 and [r.from_cache for r in all_new.collect()] == [False] * 3
    again, fresh = registry.embed_with_cache(df, fresh, stand_in_embedder, "m", AS_OF)
    assert fresh.count() == 0
    assert rows(again.select("id", "from_cache", "embedding"), "id") == [("1", True, [3.0, 1.0]), ("2", True, [3.0, 1.0]), ("3", True, [1.0, 0.0])]
    assert registry.embed_with_cache(df, fresh, stand_in_embedder, "other", AS_OF)[1].count() == 2
