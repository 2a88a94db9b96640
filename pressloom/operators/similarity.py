"""Best matches by rescaled cosine, exact, for few or for many candidates.

Both forms return, per query, the candidates at or above a threshold with their rank:
``query_id, cand_id, cand_pos, score, rank``; equal scores go to the lower ``cand_pos``, then to the
lower ``cand_id``. Without ``k`` both return all of them. Rows without a vector match nothing.

* ``top_similar_small`` and ``nearest_small``: candidates up to a checked bound are broadcast as one matrix and
  every batch of queries is multiplied with it. No shuffle of the queries.
* ``top_similar_large``: no bound, exact. Candidates are put in order of their angle to the nearest of some pivots and cut
  into intervals of it; an interval knows the least and the largest angle of its vectors to every pivot. By
  the triangle inequality a query needs only intervals that none of these ranges keeps out of its reach. Neighbouring
  intervals of a pivot form blocks of limited size, queries likewise, and a block sends on at most ``k`` rows per query.
  ``comparisons`` tells how many pairs that leaves.
* ``top_similar_approximate``: for unbounded candidates where a small loss is fine. Signs of random projections in bands
  are join keys; what meets is compared exactly. Never used unless it is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import vectors
from pressloom.operators.skew import fits
from pressloom.sources.scratch import cut_lineage

# The most candidates that may be broadcast.
SMALL_CANDIDATES = 10_000
#: The most pivots, and of how many candidates they are chosen. Fewer candidates get fewer pivots.
PIVOTS = 48
PIVOT_SAMPLE = 2_048
PER_PIVOT = 128
#: The most intervals of one pivot; a number of 64 bits names a set of them.
INTERVALS = 60
CANDIDATE_BLOCK = 4_096
QUERY_BLOCK = 4_096
#: So many scores of a pair of blocks are held at a time.
SCORES = 1_000_000
#: Rows that describe blocks are broadcast up to this number, joined beyond it.
BROADCAST_BLOCKS = 100_000
_DECIMALS = 12
_SLACK = 1e-6

_PAIR = "query_id string, cand_id string, cand_pos long, score double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which rows have a length at all."""
    length = np.sqrt((m * m).sum(axis=1))
    some = length > 0
    return m / np.where(some, length, 1.0)[:, None], some


def _best_pairs(q_unit, c_unit, threshold, k, q_ids, c_ids, c_pos, allowed=None) -> pd.DataFrame:
    """Pairs at or above the threshold, at most ``k`` per query; ``allowed(rows)`` tells which pairs of a slice of the queries count.

    Queries are taken in slices, so that no more than about ``SCORES`` scores are held at a time, and with ``k`` only the
    best of a query leave its slice, however many pairs reach the threshold.
    """
    # Candidates in order of preference: of equal scores the first is the preferred one.
    order = pd.DataFrame({"pos": c_pos, "id": c_ids}).sort_values(["pos", "id"], kind="stable").index.to_numpy()
    c_unit, c_ids, c_pos = c_unit[order], c_ids[order], c_pos[order]
    size, found = max(1, SCORES // max(1, len(c_ids))), []
    for at in range(0, len(q_ids), size):
        rows = slice(at, at + size)
        scores = q_unit[rows] @ c_unit.T
        scores += 1
        scores /= 2
        np.round(scores, _DECIMALS, out=scores)
        scores[~(scores >= threshold)] = -1
        if allowed is not None:
            scores[~allowed(rows)[:, order]] = -1
        if k == 1 and len(c_ids):
            qi, ci = np.arange(len(scores)), scores.argmax(axis=1)
            hit = scores[qi, ci] >= 0
            qi, ci = qi[hit], ci[hit]
        else:
            qi, ci = np.nonzero(scores >= 0)
            if k is not None:
                best = np.lexsort((-scores[qi, ci], qi))
                # Places from the first of the query on.
                best = best[np.arange(len(qi)) - np.searchsorted(qi, qi) < k]
                qi, ci = qi[best], ci[best]
        found.append((qi + at, ci, scores[qi, ci]))
    if not found:
        return pd.DataFrame(columns=["query_id", "cand_id", "cand_pos", "score"])
    qi, ci, score = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"query_id": q_ids[qi], "cand_id": c_ids[ci], "cand_pos": c_pos[ci], "score": score})


def _rank(pairs: DataFrame, k: int | None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_pos", "cand_id")
    ranked = pairs.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _hold(candidates: DataFrame, bound: int):
    """At most ``bound`` candidates as one broadcast matrix; None when there are none."""
    held = candidates.dropna(subset=["embedding"]).limit(bound + 1).toPandas()
    if len(held) > bound:
        raise ValueError(f"more than {bound} candidates; use top_similar_large")
    if held.empty:
        return None
    unit, some = _unit_rows(_matrix(held["embedding"]))
    shared = (unit, some, held["cand_id"].to_numpy(dtype=object), held["cand_pos"].to_numpy())
    return candidates.sparkSession.sparkContext.broadcast(shared)


def top_similar_small(
    queries: DataFrame, candidates: DataFrame, threshold: float = 0.8, k: int | None = None,
    bound: int = SMALL_CANDIDATES,
) -> DataFrame:
    """``queries(query_id, embedding)`` against at most ``bound`` ``candidates(cand_id, cand_pos, embedding)``."""
    shared = _hold(candidates.select("cand_id", "cand_pos", "embedding"), bound)
    if shared is None:
        return queries.sparkSession.createDataFrame([], f"{_PAIR}, rank int")

    def match(batches):
        c_unit, c_some, c_ids, c_pos = shared.value
        for batch in batches:
            batch = batch[batch["embedding"].notna()]
            if batch.empty:
                continue
            q_unit, q_some = _unit_rows(_matrix(batch["embedding"]))
            ids = batch["query_id"].to_numpy(dtype=object)
            yield _best_pairs(q_unit[q_some], c_unit[c_some], threshold, k, ids[q_some], c_ids[c_some], c_pos[c_some])

    return _rank(queries.select("query_id", "embedding").mapInPandas(match, _PAIR), k)


_BEST = "struct<cand_id:string,cand_pos:bigint,score:double>"


def nearest_small(candidates: DataFrame, threshold: float, bound: int = SMALL_CANDIDATES) -> Callable[[Column], Column]:
    """A column function: embedding -> best of at most ``bound`` candidates, null below the threshold.

    Works in place, row by row of the table it is used on: no join and no shuffle.
    """
    shared = _hold(candidates.select("cand_id", "cand_pos", "embedding"), bound)
    if shared is None:
        return lambda _: F.lit(None).cast(_BEST)

    @F.pandas_udf(_BEST)
    def nearest(embedding: pd.Series) -> pd.DataFrame:
        c_unit, c_some, c_ids, c_pos = shared.value
        empty = [None] * len(embedding)
        out = pd.DataFrame({"cand_id": empty, "cand_pos": empty, "score": empty}, dtype=object)
        asked = np.flatnonzero(embedding.notna().to_numpy())
        if len(asked) and c_some.any():
            q_unit, q_some = _unit_rows(_matrix(embedding.iloc[asked]))
            # Candidates in order of preference, so that the first maximum is the preferred one.
            order = np.lexsort((c_ids.astype(str), c_pos))
            order = order[c_some[order]]
            scores = np.round((q_unit @ c_unit[order].T + 1) / 2, _DECIMALS)
            best = scores.argmax(axis=1)
            top = scores[np.arange(len(asked)), best]
            hit = q_some & (top >= threshold)
            out.loc[asked[hit], "cand_id"] = c_ids[order[best[hit]]]
            out.loc[asked[hit], "cand_pos"] = c_pos[order[best[hit]]]
            out.loc[asked[hit], "score"] = top[hit]
        return out.astype({"score": "float64", "cand_pos": "Int64"})

    return nearest


def _with_bucket(df: DataFrame, days: int | None) -> DataFrame:
    """Time bucket of ``published_at``; one bucket for everything when there is no window."""
    if days is None:
        return df.withColumn("bucket", F.lit(0))
    since = F.datediff(F.to_date("published_at"), F.lit("1970-01-01").cast("date"))
    return df.withColumn("bucket", F.floor(since / days).cast("int"))


def _micros(df: DataFrame) -> DataFrame:
    whole = (F.col("published_at") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second")
    return df.withColumn("at", (whole.cast("decimal(24,6)") * 1_000_000).cast("long"))


def top_similar_large(
    queries: DataFrame, candidates: DataFrame, threshold: float = 0.8, k: int | None = 1,
    within_days: int | None = None,
    pivots: int = PIVOTS, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """As ``top_similar_small`` without a bound on the candidates; exact.

    With ``within_days`` only candidates published that close to the query count (both sides
    need ``published_at``); time buckets then keep distant periods apart.

    Candidates with the very same vector score alike, so with ``k`` and without a window only the first
    ``k`` of them are compared.
    """
    if k is not None and within_days is None:
        same = Window.partitionBy("embedding").orderBy("cand_pos", "cand_id")
        candidates = candidates.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k).drop("_n")
    return _block_join(queries, candidates, threshold, k, within_days, pivots, candidate_block, query_block)


def _placed(
    queries: DataFrame, candidates: DataFrame, threshold: float, within_days: int | None, pivots: int
) -> tuple[DataFrame, DataFrame] | None:
    """Both sides with what decides whether they meet: candidates with ``bucket, pivot, step``, queries with a row per
    ``bucket, pivot`` and the set of ``steps`` they can reach there. None without candidates."""
    timed = ["published_at"] if within_days is not None else []
    length = vectors.norm(vectors.as_doubles(F.col("embedding")))
    cand = candidates.select("cand_id", "cand_pos", "embedding", *timed).where(length > 0)
    query = queries.select("query_id", "embedding", *timed).where(length > 0)
    if timed:
        cand, query = _micros(cand), _micros(query)
    else:
        cand, query = cand.withColumn("at", F.lit(0).cast("long")), query.withColumn("at", F.lit(0).cast("long"))

    pivot_unit = _pivots(cand, pivots)
    if pivot_unit is None:
        return None
    reach = math.acos(max(-1.0, min(1.0, 2 * threshold - 1))) + _SLACK
    width = max(reach / 2, math.pi / INTERVALS)

    @F.pandas_udf("array<double>")
    def angles(v: pd.Series) -> pd.Series:
        return pd.Series(list(_angles(v, pivot_unit)))

    cand = _with_bucket(cand, within_days).withColumn("angles", angles("embedding"))
    cand = cand.withColumn("angle", F.array_min("angles")).withColumns({
        "pivot": (F.array_position("angles", F.col("angle")) - 1).cast("int"), "step": F.floor(F.col("angle") / width).cast("int"),
    })
    # Both sides are read several times below; fix them once.
    cand = cut_lineage(cand)
    # One row per interval, that is at most PIVOTS * INTERVALS: the ranges of angles to all pivots.
    ranges = cand.select("pivot", "step", F.posexplode("angles").alias("to", "angle")).groupBy("pivot", "step", "to").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high")
    ).toPandas()
    names = ranges[["pivot", "step"]].drop_duplicates().to_numpy()
    low, high = (ranges.pivot(index=["pivot", "step"], columns="to", values=c).loc[list(map(tuple, names))].to_numpy() for c in ("low", "high"))

    @F.pandas_udf("array<long>")
    def reached(v: pd.Series) -> pd.Series:
        """For each pivot the set of its intervals that a query can reach."""
        out = np.zeros((len(v), len(pivot_unit)), np.int64)
        at = _angles(v, pivot_unit)
        for i, (pivot, step) in enumerate(names.tolist()):
            near = ((at - reach <= high[i]) & (at + reach >= low[i])).all(axis=1)
            out[near, pivot] |= 1 << step
        return pd.Series(list(out))

    near = F.array(F.col("bucket")) if within_days is None else F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])
    query = _with_bucket(query, within_days).withColumn("bucket", F.explode(near))
    asked = cut_lineage(query.select("*", F.posexplode(reached("embedding")).alias("pivot", "steps")).where("steps <> 0"))
    return cand, asked


def _pivots(cand: DataFrame, most: int) -> np.ndarray | None:
    """Unit vectors far from each other, out of a bounded sample of the candidates; None without candidates."""
    sample = cand.select("cand_id", "embedding").orderBy(F.xxhash64("cand_id"), "cand_id").limit(PIVOT_SAMPLE).toPandas()
    if sample.empty:
        return None
    unit, _ = _unit_rows(_matrix(sample["embedding"]))
    most = min(most, len(unit)) if len(unit) == PIVOT_SAMPLE else min(most, max(4, len(unit) // PER_PIVOT), len(unit))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < most:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def _angles(v: pd.Series, pivot_unit: np.ndarray) -> np.ndarray:
    if not len(v):
        return np.zeros((0, len(pivot_unit)))
    unit, _ = _unit_rows(_matrix(v))
    return np.arccos(np.clip(unit @ pivot_unit.T, -1.0, 1.0))


def _steps(cand: DataFrame) -> DataFrame:
    """``bucket, pivot, step, n``: the candidates of each interval."""
    return cand.groupBy("bucket", "pivot", "step").agg(F.count(F.lit(1)).alias("n"))


def comparisons(
    queries: DataFrame, candidates: DataFrame, threshold: float = 0.8, within_days: int | None = None, pivots: int = PIVOTS
) -> tuple[int, int]:
    """How many pairs ``top_similar_large`` compares, and how many there are, of vectors with a length."""
    placed = _placed(queries, candidates, threshold, within_days, pivots)
    if placed is None:
        return 0, 0
    cand, asked = placed
    reached = F.getbit("steps", F.col("step")) == 1
    met = asked.groupBy("bucket", "pivot", "steps").agg(F.count(F.lit(1)).alias("q")).join(_steps(cand), ["bucket", "pivot"]).where(reached)
    length = vectors.norm(vectors.as_doubles(F.col("embedding"))) > 0
    return met.agg(F.sum(F.col("q") * F.col("n"))).first()[0] or 0, queries.where(length).count() * cand.count()


def _block_join(
    queries: DataFrame, candidates: DataFrame, threshold: float, k: int | None, within_days: int | None,
    pivots: int, candidate_block: int, query_block: int,
) -> DataFrame:
    placed = _placed(queries, candidates, threshold, within_days, pivots)
    if placed is None:
        return queries.sparkSession.createDataFrame([], f"{_PAIR}, rank int")
    cand, asked = placed
    reach_us = None if within_days is None else within_days * 86_400_000_000
    # Intervals of a pivot in a row form blocks; one with too many vectors is dealt to several.
    before = Window.partitionBy("bucket", "pivot").orderBy("step")
    blocks = _steps(cand).withColumns({
        "block": F.floor((F.sum("n").over(before) - F.col("n")) / candidate_block).cast("int"), "parts": F.ceil(F.col("n") / candidate_block).cast("int"),
    })
    here = asked.groupBy("bucket", "pivot").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("q_parts"))
    blocks = cut_lineage(blocks.join(here, ["bucket", "pivot"]))
    rows = blocks.groupBy("bucket", "pivot", "block", "q_parts").agg(
        F.bit_or(F.expr("shiftleft(1L, step)")).alias("held"), F.max("parts").alias("c_parts")
    )
    # Few rows per block, not per vector; if there are many all the same, they are not broadcast.
    blocks, rows = (F.broadcast(x) if fits(x, BROADCAST_BLOCKS) else x for x in (blocks, rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    q_side = (
        asked.join(rows, ["bucket", "pivot"]).where(F.col("steps").bitwiseAND(F.col("held")) != 0)
        .select("bucket", "pivot", "block", part("query_id", "q_parts").alias("q_part"), every("c_parts").alias("c_part"), "query_id", "embedding", "at", "steps")
    )
    c_side = cand.join(blocks, ["bucket", "pivot", "step"]).select(
        "bucket", "pivot", "block", every("q_parts").alias("q_part"), part("cand_id", "parts").alias("c_part"), "cand_id", "cand_pos", "embedding", "at", "step"
    )

    def match(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame(columns=["query_id", "cand_id", "cand_pos", "score"])]
        if q.empty or c.empty:
            return found[0]
        q_unit, _ = _unit_rows(_matrix(q["embedding"]))
        c_unit, _ = _unit_rows(_matrix(c["embedding_"]))
        q_ids, c_ids, c_pos = q["query_id"].to_numpy(dtype=object), c["cand_id_"].to_numpy(dtype=object), c["cand_pos_"].to_numpy()
        steps, step = q["steps"].to_numpy(), c["step_"].to_numpy()
        for one in np.unique(step):
            i, j = np.flatnonzero(steps >> one & 1), np.flatnonzero(step == one)
            if not len(i):
                continue
            near = None
            if reach_us is not None:
                q_at, c_at = q["at"].to_numpy()[i], c["at_"].to_numpy()[j]
                near = lambda rows, q_at=q_at, c_at=c_at: np.abs(q_at[rows, None] - c_at) <= reach_us
            pairs = _best_pairs(q_unit[i], c_unit[j], threshold, k, q_ids[i], c_ids[j], c_pos[j], near)
            if len(pairs):
                found.append(pairs)
        return pd.concat(found[1:]) if len(found) > 1 else found[0]

    # Both sides come from the same candidates; new names keep their columns apart.
    key = ["bucket", "pivot", "block", "q_part", "c_part"]
    left, right = q_side, c_side.toDF(*[f"{c}_" for c in c_side.columns])
    left = left.groupBy(*key)
    right = right.groupBy(*[f"{c}_" for c in key])
    return _rank(left.cogroup(right).applyInPandas(match, _PAIR), k)


# ---- approximate, only where it is asked for

BANDS, BAND_BITS = 24, 10
_SEED = 5


def top_similar_approximate(
    queries: DataFrame, candidates: DataFrame, threshold: float = 0.8, k: int | None = 1, bands: int = BANDS, bits: int = BAND_BITS
) -> DataFrame:
    """As ``top_similar_large`` without a window, but it may miss candidates; every row it returns has its exact score.

    A vector gets ``bands`` keys of ``bits`` signs of random projections each. Vectors at an angle ``a`` agree in a sign
    with chance ``1 - a / pi``, so at least one band agrees with chance ``1 - (1 - (1 - a / pi) ** bits) ** bands``. Ids and keys meet
    first, each pair once; vectors are fetched for the pairs. More bands find more, more bits compare less. Vectors
    of queries and candidates must be of one length.
    """
    length = vectors.norm(vectors.as_doubles(F.col("embedding")))
    sides = {}
    for name, df, columns in (("q", queries, ["query_id"]), ("c", candidates, ["cand_id", "cand_pos"])):
        sides[name] = cut_lineage(df.select(*columns, "embedding").where(length > 0).withColumn("keys", _band_keys(bands, bits)("embedding")))
    keyed = lambda s, c: sides[s].select(c, F.posexplode("keys").alias("band", "key"))
    # A key that very many vectors share is split on both sides by the planner, as any skewed join.
    met = keyed("q", "query_id").hint("merge").join(keyed("c", "cand_id"), ["band", "key"]).select("query_id", "cand_id").distinct()
    q = sides["q"].select("query_id", F.col("embedding").alias("_q"))
    c = sides["c"].select("cand_id", "cand_pos", F.col("embedding").alias("_c"))
    both = met.join(q, "query_id").join(c, "cand_id")
    score = F.round(vectors.cosine01(F.col("_q"), F.col("_c")), _DECIMALS)
    return _rank(both.select("query_id", "cand_id", "cand_pos", score.alias("score")).where(F.col("score") >= threshold), k)


def _band_keys(bands: int, bits: int):
    @F.pandas_udf("array<long>")
    def keys(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        m = _matrix(v)
        directions = np.random.default_rng([_SEED, m.shape[1]]).normal(size=(m.shape[1], bands * bits))
        signs = (m @ directions > 0).reshape(len(m), bands, bits)
        return pd.Series(list(signs @ (1 << np.arange(bits, dtype=np.int64))))

    return keys
