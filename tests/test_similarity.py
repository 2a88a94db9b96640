"""Both similarity joins against a brute-force search, with clustered and repeated vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.operators import similarity

RNG = np.random.default_rng(7)


def clustered(n, dim=8, centres=5, copies=0.0):
    middle = RNG.normal(size=(centres, dim))
    m = middle[RNG.integers(0, centres, n)] + 0.4 * RNG.normal(size=(n, dim))
    m[: int(n * copies)] = m[0]
    return np.float32(m)


def tables(spark, q, c, days=None):
    at = lambda i: f"2024-01-{1 + (days[i] if days is not None else 0):02d} 12:00:00"
    qs = spark.createDataFrame([(f"q{i}", v.tolist(), at(i)) for i, v in enumerate(q)], "query_id string, embedding array<float>, at string")
    cs = spark.createDataFrame([(f"c{i:04d}", i, v.tolist(), at(i)) for i, v in enumerate(c)],
                               "cand_id string, cand_pos long, embedding array<float>, at string")
    dated = lambda df: df.withColumn("published_at", F.col("at").cast("timestamp_ntz")).drop("at")
    return dated(qs), dated(cs)


def brute(q, c, threshold, k, days=None, within=None):
    out = {}
    for i, a in enumerate(np.float64(q)):
        hits = []
        for j, b in enumerate(np.float64(c)):
            na, nb = np.linalg.norm(a), np.linalg.norm(b)
            if na == 0 or nb == 0 or (within is not None and abs(days[i] - days[j]) > within):
                continue
            s = round(float((a @ b / (na * nb) + 1) / 2), 9)
            if s >= threshold:
                hits.append((-s, j))
        out[f"q{i}"] = [f"c{j:04d}" for _, j in sorted(hits)[:k]]
    return {q: h for q, h in out.items() if h}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.cand_id)
    return out


@pytest.fixture(scope="module")
def data():
    q, c = clustered(60), clustered(150, copies=0.34)
    q[3], c[100] = 0, 0
    return q, c


@pytest.mark.parametrize("threshold, k", [(0.9, 1), (0.8, 3), (0.55, 5)])
def test_small_and_large_agree_with_brute_force(spark, data, threshold, k):
    q, c = data
    qs, cs = tables(spark, q, c)
    expected = brute(q, c, threshold, k)
    assert found(similarity.top_similar_small(qs, cs, threshold, k)) == expected
    large = similarity.top_similar_large(qs, cs, threshold, k, pivots=4, candidate_block=16, query_block=16)
    assert found(large) == expected


def test_large_within_days(spark, data):
    q, c = data
    days = np.random.default_rng(1).integers(0, 28, 150)
    qs, cs = tables(spark, q, c, days)
    got = similarity.top_similar_large(qs, cs, 0.8, 3, within_days=5, pivots=4, candidate_block=8, query_block=8)
    assert found(got) == brute(q, c, 0.8, 3, days, 5)


def test_large_without_k_reports_all(spark, data):
    q, c = data
    qs, cs = tables(spark, q, c)
    got = similarity.top_similar_large(qs, cs, 0.8, None, pivots=4, candidate_block=16, query_block=16)
    assert found(got) == brute(q, c, 0.8, None)


def test_small_refuses_more_than_its_bound(spark, data):
    qs, cs = tables(spark, *data)
    with pytest.raises(ValueError):
        similarity.top_similar_small(qs, cs, 0.8, 1, bound=100)


def test_no_candidates(spark, data):
    qs, cs = tables(spark, *data)
    none = cs.where("false")
    assert similarity.top_similar_small(qs, none, 0.8, 1).count() == 0
    assert similarity.top_similar_large(qs, none, 0.8, 1).count() == 0


def far_clusters(n, dim=32, centres=40, noise=0.25):
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(centres, dim))
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    return np.float32(middle[rng.integers(0, centres, n)] + noise / np.sqrt(dim) * rng.normal(size=(n, dim)))


def test_few_pairs_are_compared_in_clusters(spark):
    """Under a tenth of all pairs, and still all results."""
    m = far_clusters(2_400)
    qs, cs = tables(spark, m[:300], m[300:])
    compared, every = similarity.comparisons(qs, cs, 0.9)
    assert every == 300 * 2_100 and 0 < compared < every / 10
    got = similarity.top_similar_large(qs, cs, 0.9, 2, candidate_block=64, query_block=32)
    assert found(got) == brute(m[:300], m[300:], 0.9, 2)


def test_comparisons_of_nothing(spark, data):
    qs, cs = tables(spark, *data)
    assert similarity.comparisons(qs, cs.where("false"), 0.9) == (0, 0)
    assert similarity.comparisons(qs.where("false"), cs, 0.9)[0] == 0


def test_many_blocks_are_joined_without_broadcast(spark, data, monkeypatch):
    monkeypatch.setattr(similarity, "BROADCAST_BLOCKS", 0)
    q, c = data
    qs, cs = tables(spark, q, c)
    got = similarity.top_similar_large(qs, cs, 0.8, 3, pivots=4, candidate_block=16, query_block=16)
    assert found(got) == brute(q, c, 0.8, 3)


def test_approximate_finds_most_and_scores_exactly(spark):
    m = far_clusters(1_200, noise=0.5)
    m[5] = 0
    qs, cs = tables(spark, m[:200], m[200:])
    exact = {(r.query_id, r.cand_id): r.score for r in similarity.top_similar_large(qs, cs, 0.9, None).collect()}
    rough = {(r.query_id, r.cand_id): r.score for r in similarity.top_similar_approximate(qs, cs, 0.9, None).collect()}
    assert set(rough) <= set(exact) and len(rough) >= 0.9 * len(exact) > 1_000
    assert all(abs(rough[p] - exact[p]) < 1e-9 for p in rough)
    best = similarity.top_similar_approximate(qs, cs, 0.9, 1)
    assert best.count() == best.select("query_id").distinct().count() and best.where("rank <> 1").isEmpty()
    assert similarity.top_similar_approximate(qs, cs.where("false"), 0.9).count() == 0


@pytest.mark.parametrize("k", [1, 3, None])
def test_best_pairs_hold_few_scores(monkeypatch, k):
    """A full pair of blocks of which every pair reaches the threshold, with equal scores and places."""
    rng = np.random.default_rng(2)
    q, c = np.abs(rng.normal(size=(300, 8))), np.abs(rng.normal(size=(500, 8)))
    c[100:400] = c[0]
    q, c = (m / np.linalg.norm(m, axis=1)[:, None] for m in (q, c))
    ids, pos = np.array([f"c{i}" for i in rng.permutation(500)], object), rng.integers(0, 50, 500)
    days, q_days = rng.integers(0, 10, 500), rng.integers(0, 10, 300)
    near = lambda rows: np.abs(q_days[rows, None] - days) <= 2
    scores = np.where(near(slice(None)), np.round((q @ c.T + 1) / 2, 9), -1)
    wanted = [
        (f"q{i}", ids[j]) for i in range(300) for j in sorted(np.flatnonzero(scores[i] >= 0.5), key=lambda j: (-scores[i, j], pos[j], ids[j]))[:k]
    ]
    monkeypatch.setattr(similarity, "SCORES", 10_000)
    q_ids = np.array([f"q{i}" for i in range(300)], object)
    got = similarity._best_pairs(q, c, 0.5, k, q_ids, ids, pos, near)
    assert sorted(zip(got["query_id"], got["cand_id"])) == sorted(wanted)


def test_best_pairs_of_full_blocks_stay_small():
    """Two full blocks whose pairs all reach the threshold; all pairs at once would take gigabytes."""
    import tracemalloc

    m = np.full((similarity.CANDIDATE_BLOCK, 4), 0.5)
    ids, pos = np.array([f"{i:064d}" for i in range(len(m))], object), np.arange(len(m))
    tracemalloc.start()
    try:
        got = similarity._best_pairs(m, m, 0.6, 1, ids, ids, pos)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == len(m) and (got["cand_pos"] == 0).all()
    assert peak < 100e6
