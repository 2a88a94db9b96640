"""Embedding whitening by a pivoted Cholesky factor and one-sided Jacobi rotations.

Entries become whole numbers ``x = floor(64 c) + 1000000``, so all sums below are exact, whatever the
order in which tasks add them. Each distinct vector counts once (the fit list):

1. one pass over the fit list gives its length ``n`` and the sums ``S``;
2. a second pass centres every vector at the rounded mean, multiplies and adds up per batch; only
   one row per dimension leaves a batch, and what rounding left of the mean is corrected in whole numbers;
3. the scatter, a matrix of dimensions by dimensions whatever the number of rows, is factored on the driver:
   Cholesky with pivots gives a triangular factor, one-sided Jacobi rotations make its columns orthogonal.
   Squared column norms are then the eigenvalues and normalised columns the components;
4. every row is projected where it lies; the model's numbers travel with the function.

Defined results: rows whose vector is null or holds null, infinite or undefined entries are left out, and so are those
with an entry beyond 2^52 / 64, whose ``x`` arithmetic cannot hold exactly. Of vectors of different lengths
those of the most frequent length take part (ties: the longer). Repeated rows count once in the fit and come out as often
as they occur; ids may be null or repeated. Directions in which the fit list does not vary have no
component, so one distinct vector, or none, gives no rows. Other columns pass through ``whiten``, which
replaces columns of the names it makes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.sources.scratch import cut_lineage

SCALE, ORIGIN = 64, 1_000_000
#: Entries beyond this (times 64) have no exact whole number.
MOST = float(1 << 52)
COMPONENTS = 16
SWEEPS = 60
#: Rows that a task multiplies at once.
ROWS = 4_096


def whole(df: DataFrame, vector: str = "embedding", out: str = "x") -> DataFrame:
    """The rows of ``df`` whose vector can be used, with ``out``, the vector in whole numbers (array<long>)."""
    doubles = F.col(f"`{vector}`").cast("array<double>")
    # A comparison with an undefined or null entry must not pass: NaN is the largest double here.
    usable = F.forall(doubles, lambda c: F.coalesce(F.abs(c) <= MOST / SCALE, F.lit(False)))
    # Decided per row, so that no entry beyond the range is ever converted.
    made = F.when(usable, F.transform(doubles, lambda c: F.floor(c * SCALE) + F.lit(ORIGIN).cast("long")))
    df = df.withColumn(out, made).where(F.col(f"`{out}`").isNotNull())
    lengths = df.groupBy(F.size(out).alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return df.where(F.size(out) == (most["d"] if most else 0))


def _matrix(batch: pa.RecordBatch | pa.Array, column: int = 0) -> np.ndarray:
    lists = batch.column(column) if isinstance(batch, pa.RecordBatch) else batch
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), len(flat) // max(len(lists), 1))


def _products(z: np.ndarray) -> np.ndarray:
    """``z.T @ z`` without rounding."""
    most = int(np.abs(z).max(initial=0))
    if most * most * len(z) < 1 << 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if most * most * len(z) < 1 << 62:
        return np.einsum("ni,nj->ij", z, z).astype(object)
    return z.astype(object).T @ z.astype(object)


def _whole_sums(fit: DataFrame, d: int, sums) -> list[list[int]]:
    """Whole numbers that ``sums`` gives for stretches of the fit list (an array of ``d`` rows), added up.

    A task sends one row per dimension, its numbers as text; they are added as decimals by place, and no more than one
    number per place reaches the driver.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch)
            for at in range(0, len(x), ROWS):
                part = sums(x[at : at + ROWS])
                total = part if total is None else total + part
        if total is not None:
            rows = [[str(v) for v in row] for row in total.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["i", "row"]
            )

    parts = fit.select("x").mapInArrow(partial, "i int, row array<string>")
    # 38 digits hold the sums of 10^20 vectors whose entries differ by a billion.
    each = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")
    )
    held = {(r.i, r.j): int(r.v) for r in each.collect()}
    return [[held[i, j] for j in range(len(held) // d)] for i in range(d)]


def triangular(scatter: np.ndarray, tolerance: float | None = None) -> np.ndarray:
    """A factor ``L`` with ``L @ L.T == scatter`` by Cholesky steps that take the largest remaining
    diagonal entry first. Its rows in the order of the pivots form a lower triangle; it has as many columns as
    the matrix has rank."""
    left = scatter.astype(np.float64).copy()
    d = len(left)
    diagonal = left.diagonal().copy()
    columns = np.zeros((d, 0))
    tolerance = d * np.finfo(float).eps * diagonal.max(initial=0) if tolerance is None else tolerance
    done = np.zeros(d, bool)
    for _ in range(d):
        rest = np.where(done, -1.0, diagonal)
        p = int(rest.argmax()) if d else 0
        if rest[p] <= tolerance:
            break
        column = left[:, p] - columns @ columns[p]
        column[done] = 0.0
        column /= math.sqrt(rest[p])
        column[p] = math.sqrt(rest[p])
        columns = np.column_stack([columns, column])
        done[p] = True
        diagonal -= column * column
    return columns


def rotated(factor: np.ndarray) -> np.ndarray:
    """``factor`` after rotations of pairs of its columns until all are orthogonal. Pairs that share no
    column are rotated together, dealt as in a round-robin tournament."""
    f = factor.copy()
    r = f.shape[1]
    seats = list(range(r + r % 2))
    for _ in range(SWEEPS):
        largest = 0.0
        for _ in range(max(len(seats) - 1, 0)):
            half = len(seats) // 2
            pairs = [(a, b) for a, b in zip(seats[:half], seats[:half - 1 : -1]) if a < r and b < r]
            p, q = np.array([min(x) for x in pairs], int), np.array([max(x) for x in pairs], int)
            a, b = f[:, p], f[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            size = np.sqrt(aa * bb)
            off = np.abs(ab) / np.where(size > 0, size, 1.0)
            largest = max(largest, off.max(initial=0.0))
            turn = off > 1e-16
            zeta = (bb - aa) / np.where(turn, 2 * ab, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            f[:, p], f[:, q] = c * a - c * t * b, c * t * a + c * b
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if largest <= 1e-15:
            break
    return f


@dataclass(frozen=True)
class Whitening:
    """A fitted model. ``components`` are rows of length one."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def fit(fit_list: DataFrame, most: int | None = COMPONENTS) -> Whitening:
    """The model of ``fit_list(x)``: distinct vectors of one length in whole numbers."""
    first = fit_list.select(F.size("x").alias("d")).first()
    d = first["d"] if first else 0
    if not d:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    # Columns: the sum of the entries, and the number of vectors beside it.
    totals = _whole_sums(fit_list, d, lambda x: np.column_stack([x.astype(object).sum(axis=0), np.full(d, len(x), object)]))
    sums, n = [row[0] for row in totals], totals[0][1]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        z = x - middle
        return np.column_stack([_products(z), z.astype(object).sum(axis=0)])

    both = _whole_sums(fit_list, d, centred)
    products, rest = [row[:d] for row in both], [row[d] for row in both]
    # n^2 times the covariance, exactly, then to the nearest double.
    cov = np.array([[float(Fraction(n * products[i][j] - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)])
    turned = rotated(triangular(cov))
    values = (turned * turned).sum(axis=0)
    order = np.argsort(-values, kind="stable")[:most]
    trace = float(sum((Fraction(n * products[i][i] - rest[i] * rest[i], n * n) for i in range(d)), Fraction(0)))
    columns = turned[:, order] / np.sqrt(values[order])
    return Whitening(n, sums, np.ascontiguousarray(columns.T), values[order], trace)


def whiten(df: DataFrame, model: Whitening, x: str = "x") -> DataFrame:
    """``df`` with ``whitened`` (array<double>, one entry per component) and ``deviation`` (decimal), the exact
    sum over the dimensions of ``(n x - S)^2``; both of the vector ``x`` in whole numbers."""
    n, sums = model.n, model.sums
    middle = [(2 * s + n) // (2 * n) for s in sums] if n else []
    # n x - S = n (x - middle) + rest, where rest is at most n / 2.
    rest = [n * m - s for m, s in zip(middle, sums)]
    scaled = model.components / np.sqrt(model.eigenvalues)[:, None] if n else model.components
    middles, shift = np.array(middle, np.int64), np.array([float(Fraction(r, n)) for r in rest]) if n else np.zeros(0)
    twice, square = [2 * n * r for r in rest], sum(r * r for r in rest)

    @F.arrow_udf("struct<whitened array<double>, deviation decimal(38,0)>")
    def made(batch: pa.Array) -> pa.Array:
        values, exact = [], []
        m = _matrix(batch) if len(batch) else np.zeros((0, len(middle)), np.int64)
        for at in range(0, len(m), ROWS):
            z = m[at : at + ROWS] - middles
            values.append(np.einsum("nd,kd->nk", z + shift, scaled))
            exact += _deviations(z, n, twice, square)
        flat = np.concatenate(values).ravel() if values else np.zeros(0)
        ends = np.arange(len(m) + 1) * len(scaled)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.float64()))
        return pa.StructArray.from_arrays([lists, pa.array([str(v) for v in exact], pa.string()).cast(pa.decimal128(38, 0))], ["whitened", "deviation"])

    done = df.withColumn("_made", made(F.col(f"`{x}`")))
    return done.withColumns({"whitened": F.col("_made.whitened"), "deviation": F.col("_made.deviation")}).drop("_made")


def _deviations(z: np.ndarray, n: int, twice: list[int], square: int) -> list[int]:
    """For each row the sum of ``(n z + rest)^2`` in whole numbers of any size."""
    most = int(np.abs(z).max(initial=0))
    small = most * most * z.shape[1] < 1 << 62 and all(abs(t) * most * len(twice) < 1 << 62 for t in twice)
    z = z if small else z.astype(object)
    squares, cross = (z * z).sum(axis=1), z @ np.array(twice, np.int64 if small else object)
    return [n * n * int(a) + int(b) + square for a, b in zip(squares.tolist(), cross.tolist())]


def identity_error(fit_list: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the covariance of the whitened fit list minus the identity. Each stretch is centred at
    its own mean before it is multiplied; means and products are then added up."""
    k = len(model.components)
    if not k:
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, inner, between = 0, np.zeros(k), np.zeros((k, k)), np.zeros((k, k))
        for batch in batches:
            w = _matrix(batch)
            if len(w):
                mean = w.mean(axis=0)
                n, total = n + len(w), total + len(w) * mean
                inner, between = inner + (w - mean).T @ (w - mean), between + len(w) * np.outer(mean, mean)
        if n:
            table = np.column_stack([inner + between, total, np.full(k, n)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(k), pa.int32()), pa.array(table.tolist(), pa.list_(pa.float64()))], ["i", "row"]
            )

    parts = whiten(fit_list, model).select("whitened").mapInArrow(partial, "i int, row array<double>")
    each = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    table = np.zeros((k, k + 2))
    for r in each.collect():
        table[r.i, r.j] = r.v
    n, mean = table[0, k + 1], table[:, k] / table[0, k + 1]
    return float(np.abs(table[:, :k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(df: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> tuple[DataFrame, Whitening, float | None]:
    """The usable rows of ``df`` with ``x``, ``whitened`` and ``deviation``, the model that whitens them, and
    its ``identity_error``. The fit list is written once, as three passes read it."""
    rows = whole(df, vector)
    fit_list = cut_lineage(rows.select("x").distinct())
    model = fit(fit_list, most)
    return whiten(rows, model), model, identity_error(fit_list, model)
