"""Near-duplicate vectors by E8 lattice hashing.

A table projects unit vectors on eight random directions and decodes the result to the nearest point of the lattice E8,
its home cell. The lattice has 240 shortest vectors; the ``PROBES`` of them that lead to the cells nearest to the projection
are probed too. Vectors that are alike meet, with a high chance in each of ``TABLES`` tables, where one is at home.

Equal vectors are one node from the start. Nodes are kept in blocks: those that fall into one cell of a
finer lattice (two E8 points side by side) and have nearly the same sketch, at most about ``BLOCK`` together. A tight group of near copies thus has few blocks, and cells hold
blocks, not vectors. The join on cells yields pairs of blocks, each pair once; a sketch of 128 signs of
random projections with the spread of the block around it drops pairs that cannot reach the cosine but for a chance of less than
one in ten thousand. Then the blocks of a pair are multiplied, and every pair of vectors is verified in double
precision. What leaves a multiplication is one row per linked vector: how many links it found and
one link that ties it to its class. So no group is expanded into pairs of rows, and no pair counts twice.

Defined results: vectors that are null, have no entries or length zero, or hold null, infinite or undefined entries have
no links and are classes by themselves. Vectors of different lengths do not link. Repeated rows and copies link with each
other. Null ids are ignored where a class has others; a class of null ids has a null ``component_id``
and is kept. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.components import components
from pressloom.operators.skew import lookup_join
from pressloom.sources.scratch import cut_lineage

COSINE = 0.9
TABLES = 6
PROBES = 32
#: Cells' size for unit vectors: the projections are divided by it. That of blocks is larger, as two points must agree.
WIDTH = 1.0
BLOCK_WIDTH = 1.6
#: Nodes of a block, and what its vectors may weigh together.
BLOCK, BLOCK_BYTES = 256, 1 << 17
SKETCH = 128
#: Members of a block differ from its first by no more signs; others are blocks by themselves.
CORE = 24
#: Pairs of blocks with no more pairs of vectors are looked at many at a time.
FEW = 256
SEED = 13
#: Cosines this near to the threshold are computed again, term by term.
CLOSE = 1e-9


def sketch_reach(cosine: float, sigmas: float = 4.4) -> int:
    """Signs in which vectors of this cosine differ at most, but for a chance of about one in 10^5."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return min(SKETCH, math.ceil(SKETCH * p + sigmas * math.sqrt(SKETCH * p * (1 - p))))


@lru_cache(maxsize=1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    units = [
        [s if k == i else t if k == j else 0.0 for k in range(8)]
        for i, j in itertools.combinations(range(8), 2) for s in (1.0, -1.0) for t in (1.0, -1.0)
    ]
    halves = [b for b in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in b) % 2 == 0]
    return np.array([*units, *halves])


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of an even sum."""
    near = np.rint(y)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    off = y[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: whole coordinates, or all of them halves, of an even sum."""
    whole, half = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def neighbours(y: np.ndarray, home: np.ndarray, probes: int) -> np.ndarray:
    """For each row the ``probes`` lattice points beside ``home`` that are nearest to ``y`` (rows x probes x 8)."""
    steps = shortest()
    gain = (y - home) @ steps.T
    best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes] if probes < len(steps) else np.tile(np.arange(len(steps)), (len(y), 1))
    return home[:, None, :] + steps[best]


def _names(points: np.ndarray, salt: int) -> np.ndarray:
    """A number for each lattice point: a byte per coordinate. Points that share one only meet in vain."""
    places = (np.rint(points * 2).astype(np.int64) & 255).astype(np.uint64)
    packed = (places << np.arange(0, 64, 8, dtype=np.uint64)).sum(axis=-1, dtype=np.uint64)
    return ((packed ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


class Tables:
    """The random directions for vectors of one length."""

    def __init__(self, d: int, tables: int, probes: int, width: float, block_width: float):
        rng = np.random.default_rng([SEED, d])
        self.probes, self.width, self.block_width = probes, width, block_width
        self.salts = rng.integers(1, 1 << 62, tables + 2)
        directions = rng.normal(size=(d, 8 * (tables + 2)))
        # The directions of a table are made orthogonal: they then tell more than if they were alike.
        if d >= 8:
            directions = np.hstack([np.linalg.qr(directions[:, i : i + 8])[0] * math.sqrt(d) for i in range(0, 8 * (tables + 2), 8)])
        self.directions = directions
        self.signs = rng.normal(size=(d, SKETCH))

    def hashes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(block, homes, probed, sketch) of unit vectors: a number, one per table, ``probes`` per table, two of 64 bits."""
        y = (unit @ self.directions).reshape(len(unit), -1, 8)
        blocks = [_names(decode(y[:, t] / self.block_width), int(self.salts[t])) for t in (0, 1)]
        homes, probed = [], []
        for t in range(2, y.shape[1]):
            at = y[:, t] / self.width
            home = decode(at)
            homes.append(_names(home, int(self.salts[t])))
            if self.probes:
                probed.append(_names(neighbours(at, home, self.probes), int(self.salts[t])))
        sketch = np.packbits(unit @ self.signs > 0, axis=1, bitorder="little").view(np.int64)
        return blocks[0] * 31 + blocks[1], np.column_stack(homes), np.hstack(probed) if probed else np.zeros((len(unit), 0), np.int64), sketch


def usable(vector: Column) -> Column:
    """Whether a vector (array<double>) can link with anything."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def _units(lists: pa.ListArray) -> np.ndarray:
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    # First by the largest entry: squares of very large or small ones would leave the range.
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


_HASHED = "struct<block: long, homes: array<long>, probed: array<long>, s1: long, s2: long>"


def _hashed(tables: int, probes: int, width: float, block_width: float):
    made: dict[int, Tables] = {}

    @F.arrow_udf(_HASHED)
    def hashed(batch: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(batch).to_numpy(zero_copy_only=False)
        parts, places = [], []
        for d in np.unique(sizes).tolist():
            if d not in made:
                made[d] = Tables(d, tables, probes, width, block_width)
            at = np.flatnonzero(sizes == d)
            block, homes, probed, sketch = made[d].hashes(_units(batch.take(pa.array(at))))
            lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (homes, probed)]
            parts.append(pa.StructArray.from_arrays(
                [pa.array(block + d), *lists, pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())], ["block", "homes", "probed", "s1", "s2"]
            ))
            places.append(at)
        if not parts:
            return pa.array([], pa.struct([("block", pa.int64()), ("homes", pa.list_(pa.int64())), ("probed", pa.list_(pa.int64())), ("s1", pa.int64()), ("s2", pa.int64())]))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(places), kind="stable")))

    return hashed


_LINKED = "array<struct<node: long, links: long, root: long>>"


def _multiplied(cosine: float):
    """A function of the two blocks of a pair: for each vector with links in it their number (copies counted) and the smallest
    node that they reach in this pair of blocks."""

    @F.arrow_udf(_LINKED)
    def linked(nodes_a: pa.Array, weights_a: pa.Array, a: pa.Array, nodes_b: pa.Array, weights_b: pa.Array, b: pa.Array) -> pa.Array:
        nodes, links, roots, counts = [], [], [], np.zeros(len(a), np.int64)
        for i, va, vb in _worth_multiplying(a, b, cosine):
            na, wa = (x[i].values.to_numpy() for x in (nodes_a, weights_a))
            nb, wb = (x[i].values.to_numpy() for x in (nodes_b, weights_b))
            same = len(na) == len(nb) and (na == nb).all()
            ok = _reaching(va, vb, a[i].values, b[i].values, cosine)
            if same:
                np.fill_diagonal(ok, False)
            if ok.any():
                found, count, root = _summed(ok, na, wa, nb, wb, same)
                nodes.append(found)
                links.append(count)
                roots.append(root)
                counts[i] = len(found)
        flat = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (nodes, links, roots)]
        rows = pa.StructArray.from_arrays([pa.array(x) for x in flat], ["node", "links", "root"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), rows)

    return linked


def _worth_multiplying(a: pa.Array, b: pa.Array, cosine: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, unit vectors of a, of b) of the pairs of blocks with a chance of links, in order. Pairs of few vectors are
    looked at together, as most have no links."""
    inner_a, inner_b = a.flatten(), b.flatten()
    size_a, size_b = (pc.list_value_length(x).to_numpy() for x in (a, b))
    if not len(a):
        return
    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    length_a, length_b = (pc.list_value_length(x).to_numpy() for x in (inner_a, inner_b))
    units = {}
    comparable = length_a[first_a] == length_b[first_b]
    for d in np.unique(length_a[first_a][comparable]).tolist():
        # Vectors of one length, and where each of them is among these.
        units[d] = [(_units(x.filter(pa.array(n == d))), np.cumsum(n == d) - 1) for x, n in ((inner_a, length_a), (inner_b, length_b))]
    chances = comparable & (size_a * size_b > FEW)
    for d, ((ua, at_a), (ub, at_b)) in units.items():
        few = np.flatnonzero(comparable & ~chances & (length_a[first_a] == d))
        products = (size_a * size_b)[few]
        ends = np.cumsum(products)
        for start in range(0, int(products.sum()), 1 << 16):
            pair = np.arange(start, min(start + (1 << 16), int(ends[-1])))
            k = np.searchsorted(ends, pair, "right")
            row, within = few[k], pair - (ends - products)[k]
            i, j = at_a[first_a[row] + within // size_b[row]], at_b[first_b[row] + within % size_b[row]]
            chances[row[np.einsum("nd,nd->n", ua[i], ub[j]) >= cosine - CLOSE]] = True
    for row in np.flatnonzero(chances).tolist():
        (ua, at_a), (ub, at_b) = units[int(length_a[first_a[row]])]
        i, j = at_a[first_a[row]], at_b[first_b[row]]
        yield row, ua[i : i + size_a[row]], ub[j : j + size_b[row]]


def _reaching(ua: np.ndarray, ub: np.ndarray, va: pa.ListArray, vb: pa.ListArray, cosine: float) -> np.ndarray:
    """Which unit vectors ``ua`` (rows) and ``ub`` (columns) have the cosine or more. ``va`` and ``vb`` are the vectors as given."""
    cos = ua @ ub.T
    ok = cos >= cosine
    for i, j in np.argwhere(np.abs(cos - cosine) < CLOSE):
        p, q = np.array(va[int(i)].as_py(), float), np.array(vb[int(j)].as_py(), float)
        p, q = p / np.abs(p).max(), q / np.abs(q).max()
        ok[i, j] = math.fsum(p * q) / math.sqrt(math.fsum(p * p) * math.fsum(q * q)) >= cosine
    return ok


def _summed(ok, na, wa, nb, wb, same) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, links, roots) of the linked rows and columns; the smallest node reached by following links back and forth."""
    if same:
        nodes, links = na, ok @ wb
    else:
        nodes, links = np.r_[na, nb], np.r_[ok @ wb, ok.T @ wa]
    up, down = na.copy(), nb.copy()
    far = np.iinfo(np.int64).max
    while True:
        new_down = np.minimum(down, np.where(ok, up[:, None], far).min(axis=0))
        new_up = np.minimum(up, np.where(ok, new_down[None, :], far).min(axis=1))
        if same:
            new_up = new_down = np.minimum(new_up, new_down)
        if (new_up == up).all() and (new_down == down).all():
            break
        up, down = new_up, new_down
    roots = up if same else np.r_[up, down]
    some = links > 0
    return nodes[some], links[some], roots[some]


def blocks_of(nodes: DataFrame, tables: int, probes: int, width: float, block_width: float) -> DataFrame:
    """``block, nodes, weights, vectors, homes, probed, s1, s2, spread``: one row per block of ``nodes(node, weight, vector)``.
    The cells are those of all members; the sketch is that of one member, the spread how far the others' are from it."""
    hashed = nodes.withColumn("_h", _hashed(tables, probes, width, block_width)("vector"))
    hashed = cut_lineage(hashed.select("node", "weight", "vector", "_h.*"))
    fit = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (F.size("vector") * 8))))
    first = F.min(F.struct("node", "s1", "s2")).alias("first")
    sizes = hashed.groupBy("block").agg(F.ceil(F.count("*") / F.min(fit)).cast("int").alias("parts"), first, F.count("*").alias("n")).where("n > 1")
    apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("first.s1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("first.s2")))
    own = F.when(apart <= CORE, F.pmod(F.xxhash64("node"), F.col("parts"))).when(apart > CORE, F.col("node"))
    joined = lookup_join(hashed, sizes.drop("n"), ["block"], ["node"])
    # A number of the block; whatever else should get the same one would be in it, too, and that is no harm.
    cut = joined.withColumn("block", F.xxhash64("block", F.size("vector"), apart > CORE, own))
    member = F.struct("node", "weight", "vector", "s1", "s2")
    # Members of a block are bounded by the parts above, so the lists are.
    held = cut.groupBy("block").agg(
        F.array_sort(F.collect_list(member)).alias("m"),
        F.array_distinct(F.flatten(F.collect_list("homes"))).alias("homes"),
        F.array_distinct(F.flatten(F.collect_list("probed"))).alias("probed"),
    )
    off = lambda m: F.bit_count(m["s1"].bitwiseXOR(F.col("m")[0]["s1"])) + F.bit_count(m["s2"].bitwiseXOR(F.col("m")[0]["s2"]))
    return cut_lineage(held.select(
        "block", F.col("m.node").alias("nodes"), F.col("m.weight").alias("weights"), F.col("m.vector").alias("vectors"), "homes",
        F.array_except("probed", "homes").alias("probed"), F.col("m")[0]["s1"].alias("s1"), F.col("m")[0]["s2"].alias("s2"),
        F.array_max(F.transform("m", off)).cast("int").alias("spread"),
    ))


def block_pairs(blocks: DataFrame, cosine: float) -> DataFrame:
    """``a, b``: the blocks that meet in a cell where one is at home, a <= b, each pair once; a block of
    several nodes also meets itself."""
    reach = sketch_reach(cosine)
    facts = ["block", "s1", "s2", "spread"]
    home = blocks.select(F.explode("homes").alias("cell"), *facts)
    met = blocks.select(F.explode(F.concat("homes", "probed")).alias("cell"), *[F.col(c).alias(f"{c}_") for c in facts])
    apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("s1_"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("s2_")))
    near = apart <= F.lit(reach) + F.col("spread") + F.col("spread_")
    pairs = home.hint("merge").join(met, "cell").where((F.col("block") != F.col("block_")) & near)
    pairs = pairs.select(F.least("block", "block_").alias("a"), F.greatest("block", "block_").alias("b")).distinct()
    return pairs.union(blocks.where(F.size("nodes") > 1).select(F.col("block").alias("a"), F.col("block").alias("b")))


def linked_nodes(
    nodes: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, block_width: float = BLOCK_WIDTH
) -> DataFrame:
    """``node, links, root`` for nodes of ``nodes(node, weight, vector)`` with links: how often each pair of
    blocks linked it, counting copies, and a node of the same class. A node has a row per pair of blocks."""
    blocks = blocks_of(nodes, tables, probes, width, block_width)
    held = blocks.select("block", "nodes", "weights", "vectors")
    side = lambda s: held.toDF(s, *[f"{c}_{s}" for c in held.columns[1:]])
    pairs = cut_lineage(block_pairs(blocks, cosine))
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    found = _multiplied(cosine)(*[f"{c}_{s}" for s in "ab" for c in held.columns[1:]])
    return cut_lineage(both.select(F.explode(found).alias("f")).select("f.*"))


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", **how) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``df``: how many other rows it is linked with, the smallest
    id that links reach, and whether it is its own. ``how``: as for ``linked_nodes``."""
    doubles = F.col(f"`{vector}`").cast("array<double>")
    marks = {f"_m{i}": F.xxhash64(F.lit(i), "vector") for i in (1, 2)}
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), doubles.alias("vector")).withColumns(marks)
    rows = rows.withColumn("usable", usable(F.col("vector")))
    keys = list(marks)
    copies = rows.where("usable").groupBy(*keys).agg(
        F.any_value("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("least")
    )
    # Written once with their numbers: read again, every node has the number it had.
    nodes = cut_lineage(copies.withColumn("node", F.monotonically_increasing_id()))
    found = linked_nodes(nodes.select("node", "weight", "vector"), **how)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    trees = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    whole = nodes.select(*keys, "node", "weight", "least").join(links, "node", "left").join(trees, "node", "left")
    whole = cut_lineage(whole.withColumn("root", F.coalesce("root", "node")))
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    total = F.coalesce("links", F.lit(0)) + F.col("weight") - 1
    facts = cut_lineage(whole.join(least, "root").select(*keys, total.alias("n_links"), "component_id"))
    linkable = lookup_join(cut_lineage(rows.where("usable").select("vec_id", *keys)), facts, keys, ["vec_id"], how="inner")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linkable.select("vec_id", F.col("n_links").cast("long"), "component_id").unionByName(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
