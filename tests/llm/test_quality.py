import random
import re
from collections import Counter

import numpy as np
from pressloom.llm import quality, queries
from small_docs import AWKWARD, docs, with_clashes


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    random.seed(1)
    made = ["".join(random.choice(["ab", "c ", " d", "é\n", "#", "x y z\n", "\x1c", "🎉 "]) for _ in range(random.randint(0, 90))) for _ in range(150)]
    made += [t * 3 for t in made[:40]] + ["w" * 9000 + " " + "v" * 9000, "a b c d e f g h " * 4]
    df = with_clashes(docs(spark, *AWKWARD, *[(100 + i, t) for i, t in enumerate(made)]))
    for r in quality.statistics(df).collect():
        assert tuple(r[b] for b in quality.BASE) == plain(r.text)
        assert len(r.features) == len(quality.FEATURES) and np.isfinite(r.features).all()


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.learn(documents, labels.where("doc_id % 3 <> 0"))
    held = labels.where("doc_id % 3 = 0").select("doc_id", "quality")
    rows = quality.judge(documents.join(held, "doc_id"), trees).select("quality", "kept", "base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_scores_are_monotonic():
    rng = np.random.default_rng(1)
    rows = rng.random((600, 3))
    good = (rows[:, 0] + 0.3 * rng.standard_normal(600) < 0.5).astype(float)
    trees = quality.grow(rows, good, [-1, 0, 1])
    for column, sign in ((0, -1), (2, 1)):
        grid = np.repeat(rng.random((40, 1, 3)), 50, axis=1)
        grid[:, :, column] = np.linspace(0, 1, 50)
        steps = np.diff(trees.score(grid.reshape(-1, 3)).reshape(40, 50), axis=1)
        assert (sign * steps >= -1e-12).all()
    assert np.mean((trees.score(rows) > 0.5) == good) > 0.8


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    trees = quality.learn(docs(spark, *AWKWARD), none)
    kept = {r.doc_id: r.kept for r in quality.judge(docs(spark, *AWKWARD, (50, " ".join(map(str, range(40))))), trees).collect()}
    assert kept[50] and not kept[1] and not kept[7]
    assert quality.judge(docs(spark, *AWKWARD).limit(0), trees).count() == 0


def test_query_keeps_the_good(spark):
    rows = queries.QUERIES["op9_quality"](spark, "/root/testdata/sf0.01").collect()
    assert 0.7 < np.mean([r.kept for r in rows]) < 0.95
    assert not any(r.kept for r in rows if r.base_failed)
