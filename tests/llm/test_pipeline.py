from collections import Counter

import corpus_pipeline
from small_docs import AWKWARD, docs
from test_simhash import groups, plain_print

SF = "/root/testdata/sf0.001"


def test_stages_on_sample(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe_tokens":
            assert after.columns == df.columns
        counts.append(after.count())
        df = after
    assert counts[0] >= counts[1] >= counts[2] > 0 and counts[3] == counts[4] > 0
    assert df.where("n_tokens <> size(ids)").isEmpty()
    assert corpus_pipeline.run(spark, SF).count() == counts[4]


def test_near_copies_of_sample_by_brute_force(spark):
    """One document, that of the smallest id, of each group linked by two bits or fewer, and no other one goes."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = df.select("doc_id", "text").orderBy("doc_id").collect()
    least = groups([plain_print(r.text) for r in rows])
    kept = corpus_pipeline.simhash_near_dedup(spark, df, SF)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [rows[i].doc_id for i in sorted(set(least))]


def test_stages_on_awkward_rows(spark):
    english = [(100 + i, f"this is the text number {i} and there is another line\nwith words in it that are long", "en", "a") for i in range(5)]
    for rows in ([*AWKWARD, *english], [*english], []):
        df = docs(spark, *rows)
        for name, stage in corpus_pipeline.STAGES:
            before = df
            df = stage(spark, df, SF)
            if name in ("language_id", "simhash_near_dedup"):
                assert df.columns == before.columns and not Counter(df.collect()) - Counter(before.collect())
            elif name == "line_dedup":
                assert Counter(r.doc_id for r in df.collect()) == Counter(r.doc_id for r in before.collect())
        assert (df.count() > 0) == (len(rows) > 0)
        assert {r.doc_id for r in df.select("doc_id").distinct().collect()} <= {r[0] for r in rows}
