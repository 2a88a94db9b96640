import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.llm import whitening
from pressloom.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>"


def brute(vectors):
    """(x, n, deviations, eigenvalues, components, trace) by numpy's own solver, over distinct vectors."""
    x = [[math.floor(c * 64) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), np.int64)
    n, sums = len(fit), [sum(col) for col in fit.T.tolist()]
    z = fit - fit.mean(axis=0)
    values, columns = np.linalg.eigh(z.T @ z / n)
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return np.array(x, float) - fit.mean(axis=0), n, deviations, values[::-1], columns[:, ::-1].T, values.sum()


def compared(rows, vectors, ids, most=16):
    x, n, deviations, values, components, trace = brute(vectors)
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    by_key = {(r.vec_id, r.component): r for r in rows}
    assert len(by_key) == len(rows) == k * len(ids)
    for j in range(k):
        wanted = x @ components[j] / math.sqrt(values[j])
        found = np.array([by_key[i, j + 1].whitened for i in ids])
        sign = 1 if abs(found - wanted).max() < abs(found + wanted).max() else -1
        assert np.allclose(found, sign * wanted, atol=1e-7)
        assert all(math.isclose(by_key[i, j + 1].explained, values[j] / trace, rel_tol=1e-9) for i in ids)
    assert [by_key[i, 1].deviation for i in ids] == deviations
    assert {r.n for r in rows} == {n} and {r.identity_error for r in rows}.pop() < 1e-9


def test_query_on_the_sample(spark):
    rows = QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001").collect()
    held = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").toPandas()
    compared(rows, [list(map(float, v)) for v in held.embedding], held.vec_id.tolist())


def written(spark, tmp_path, rows, kind=VECTORS):
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/embeddings.parquet")
    return QUERIES["op12_whitening"](spark, str(tmp_path)).collect()


def test_few_dimensions_copies_and_scales(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(40, 5)) * [1, 3, 10, 30, 100] + 3e3).tolist()
    vectors += vectors[:10] + [vectors[0]] * 20
    compared(written(spark, tmp_path, list(enumerate(vectors))), vectors, list(range(len(vectors))))


def test_broken_rows_are_left_out(spark, tmp_path):
    good = [[0.5, 1.0, 2.0], [1.5, -1.0, 0.0], [0.0, 0.25, 7.0], [3.0, 2.0, 1.0]]
    broken = [None, [1.0, None, 2.0], [math.nan, 1.0, 1.0], [math.inf, 0.0, 0.0], [1.0, -math.inf, 0.0], [1.0], [], [1e300, 0.0, 0.0]]
    rows = written(spark, tmp_path, [*enumerate(good), *((100 + i, v) for i, v in enumerate(broken))])
    compared(rows, good, [0, 1, 2, 3])


def test_directions_without_variance_have_no_component(spark, tmp_path):
    flat = [[float(i), 2.0 * i, 5.0, float(i * i)] for i in range(9)]
    rows = written(spark, tmp_path, list(enumerate(flat)))
    assert {r.component for r in rows} == {1, 2}
    compared(rows, flat, list(range(9)))


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (1, [0.5, 0.5])], [(1, []), (2, None)]])
def test_nothing_to_fit(spark, tmp_path, rows):
    assert written(spark, tmp_path, rows) == []


def test_null_and_repeated_ids_and_other_columns(spark):
    rows = [(None, [0.0, 1.0]), (None, [1.0, 0.0]), (7, [2.0, 2.0]), (7, [2.0, 2.0]), (8, [5.0, 0.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("mine") for c in ("x", "d", "n", "i", "j", "v", "row", "deviation", "label")})
    out, model, _ = whitening.whitened(df)
    assert model.n == 4 and out.count() == 5
    assert {r.label for r in out.collect()} == {"mine"} and len(set(out.columns)) == len(out.columns)


def test_huge_entries_stay_exact(spark):
    rng = np.random.default_rng(2)
    z = rng.integers(-(1 << 45), 1 << 45, (50, 4))
    assert whitening._products(z).tolist() == (z.astype(object).T @ z.astype(object)).tolist()
    sums = [int(s) for s in z.sum(axis=0)]
    n, middle = 50, np.array([(2 * s + 50) // 100 for s in sums])
    rest = [n * int(m) - s for m, s in zip(middle, sums)]
    found = whitening._deviations(z - middle, n, [2 * n * r for r in rest], sum(r * r for r in rest))
    assert found == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in z]


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 2), (7, 7), (16, 5), (48, 48)])
def test_factor_and_rotations(d, rank):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-3, 3, rank)
    scatter = a @ a.T
    factor = whitening.triangular(scatter)
    assert np.allclose(factor @ factor.T, scatter, atol=1e-12 * scatter.max())
    turned = whitening.rotated(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    assert np.allclose((turned / norms).T @ (turned / norms), np.eye(len(norms)), atol=1e-12)
    assert np.allclose(np.sort(norms**2)[::-1], np.linalg.eigvalsh(scatter)[::-1][: len(norms)], atol=1e-11 * scatter.max())
