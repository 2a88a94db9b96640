import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from pressloom.llm import latticededup as lattice
from pressloom.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>"


def brute(rows, cosine=0.9):
    """(n_links, component) of each row by comparing all pairs."""
    units = []
    for _, v in rows:
        ok = v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)
        v = np.array(v) / np.abs(v).max() if ok else None
        units.append(v / np.linalg.norm(v) if ok else None)
    alike = lambda p, q: p is not None and q is not None and len(p) == len(q) and p @ q >= cosine
    near = [[j for j, q in enumerate(units) if j != i and alike(p, q)] for i, p in enumerate(units)]
    least = [r[0] if r[0] is not None else math.inf for r in rows]
    for _ in rows:
        for i, others in enumerate(near):
            least[i] = min([least[i], *[least[j] for j in others]])
    return [(len(others), None if least[i] == math.inf else least[i]) for i, others in enumerate(near)]


def found(spark, rows):
    return lattice.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()


def test_nearest_lattice_points():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(300, 8)) * 2
    home = lattice.decode(y)
    steps = lattice.shortest()
    assert len({tuple(s) for s in steps}) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    # No neighbour is nearer, every coordinate sum is even, and coordinates are all whole or all halves.
    off = ((y - home) ** 2).sum(axis=1)
    assert (off[:, None] <= ((y[:, None] - home[:, None] - steps) ** 2).sum(axis=2) + 1e-12).all() and off.max() <= 1 + 1e-12
    assert (home.sum(axis=1) % 2 == 0).all() and all(len(set((r * 2 % 2).tolist())) == 1 for r in home)
    chosen = lattice.neighbours(y, home, 16)
    every = np.sort(((y[:, None] - home[:, None] - steps) ** 2).sum(axis=2), axis=1)
    assert np.allclose(np.sort(((y[:, None] - chosen) ** 2).sum(axis=2), axis=1), every[:, :16])


def test_rows_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for noise in (0.02, 0.2, 0.35):
        for _ in range(6):
            base = rng.normal(size=32)
            base /= np.linalg.norm(base)
            rows += [base + rng.normal(size=32) * noise / math.sqrt(32) for _ in range(12)]
    rows += [rng.normal(size=32) for _ in range(200)]
    rows = [(i, v.tolist()) for i, v in enumerate(rows)]
    rows += [(1_000 + i, rows[0][1]) for i in range(300)] + [(2_000 + i, [3 * c for c in rows[20][1]]) for i in range(4)]
    out = {r.vec_id: (r.n_links, r.component_id) for r in found(spark, rows)}
    wanted = {r[0]: w for r, w in zip(rows, brute(rows))}
    # At this cosine a few pairs on the edge may be missed; none may be added.
    assert all(out[i][0] <= wanted[i][0] for i in wanted)
    assert sum(out[i][0] for i in out) >= 0.99 * sum(w[0] for w in wanted.values())
    assert sum(out[i] == wanted[i] for i in wanted) >= 0.98 * len(wanted)


def test_recall_at_the_threshold(spark):
    """Pairs of cosine 0.9 to 0.91, the hardest to find, one by one."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        p, q = rng.normal(size=(2, 64))
        p /= np.linalg.norm(p)
        q -= p * (p @ q)
        q /= np.linalg.norm(q)
        c = rng.uniform(0.9005, 0.91)
        rows += [(2 * i, p.tolist()), (2 * i + 1, (c * p + math.sqrt(1 - c * c) * q).tolist())]
    out = found(spark, rows)
    assert sum(r.n_links for r in out) >= 0.95 * len(rows)
    assert all(r.component_id == r.vec_id - r.vec_id % 2 for r in out if r.n_links)


def test_threshold_is_exact(spark):
    # Cosines of exactly 0.9, just above and just below.
    rows = [(1, [1.0, 0.0]), (2, [9.0, math.sqrt(19.0)]), (3, [0.9, math.sqrt(0.19) + 1e-9]), (4, [0.9, -math.sqrt(0.19) + 1e-9])]
    pairs = {p: _pair([dict(rows)[i] for i in p]) for p in itertools.combinations(range(1, 5), 2)}
    assert not pairs[1, 3] and pairs[1, 4] and pairs[2, 3] and not pairs[2, 4]


def _pair(vectors):
    import pyarrow as pa

    lists = [pa.array([v], pa.list_(pa.float64())) for v in vectors]
    return lattice._reaching(*[lattice._units(x) for x in lists], *lists, 0.9)[0, 0]


def test_large_groups_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.01).tolist()) for i in range(300)]
    assert {(r.n_links, r.component_id) for r in found(spark, rows)} == {(299, 0)}


def test_broken_null_and_repeated_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [2.0, 0.0]),
        (13, [1.0]), (14, [1e-200, 0.0]), (15, [1e200, 0.0]), (None, [0.0, 1.0]), (None, [0.0, -1.0]), (None, [0.0, -1.0]), (3, [0.0, 2.0]), (None, None),
        (20, [-0.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("block", "node", "weight", "vector", "usable", "links", "root", "s1", "_m1")})
    out = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect()]
    key = lambda r: str(r)
    wanted = [(r[0], n, c, r[0] == c) for r, (n, c) in zip(rows, brute(rows))]
    assert sorted(out, key=key) == sorted(wanted, key=key)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_query_on_the_sample(spark):
    rows = QUERIES["op13_embeddings"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 500 and {(r.n_links, r.vec_id == r.component_id, r.kept) for r in rows} == {(0, True, True)}
