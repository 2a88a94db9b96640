"""Document fingerprints by winnowing.

The k-grams of a text are hashed with a rolling polynomial; of every window of ``w`` neighbouring
hashes the smallest is chosen, of equal ones the rightmost. Two texts that share ``w + k - 1``
characters share a chosen hash, and none shorter than ``k`` is noticed. Chosen hashes keep the
position of their k-gram, so matches can be located.

``fingerprints`` gives them as ``array<struct<hash, pos>>``. ``with_next`` brings each row together
with its successor in descending order of ids: rows are dealt to ranges of ids, each range also
gets the first row of the range below it, and a task passes its sorted ranges once. Texts move once.

Defined results: null is the empty text, which has no hashes; a text of fewer than ``k`` characters is
one k-gram; with fewer than ``w`` k-grams all of them are one window. Likeness is the Jaccard index
of the sets of hashes, 1 for two empty sets. Rows with one id follow each other in the order of
their texts; a null id comes after all others. With a single row it is its own successor.

``located`` tells where a text has the k-grams of the chosen hashes that another text has as well: of every passage of
``w + k - 1`` characters that both share, at least one k-gram is in these spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


K, WINDOW = 16, 32
_MULTIPLIER = 0x100000001B3


def chosen(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that winnowing chooses, in order of positions. Hashes have 32 bits."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k = min(k, len(codes))
    # A hash of 2m characters is made from two of m; k is the sum of some powers of two.
    h, have, power, block, size = np.zeros(len(codes), np.uint64), 0, _MULTIPLIER, codes + np.uint64(1), 1
    while size <= k:
        if k & size:
            n = len(codes) - have - size + 1
            h = h[:n] * np.uint64(power) + block[have : have + n]
            have += size
        block = block[:-size] * np.uint64(power) + block[size:]
        power = power * power % (1 << 64)
        size *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = h >> np.uint64(32)
    # Smallest hash first, then rightmost place: one number to take minima of.
    low = np.uint64(0xFFFFFFFF)
    best = (h << np.uint64(32)) | (low - np.arange(len(h), dtype=np.uint64))
    span, window = 1, min(window, len(h))
    while span < window:
        step = min(span, window - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    best = best[np.r_[True, best[1:] != best[:-1]]]
    return (best >> np.uint64(32)).astype(np.uint32), (low - (best & low)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def located(hashes: np.ndarray, places: np.ndarray, other: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of a text that chosen k-grams shared with ``other`` cover, in order; parts that meet are one."""
    starts = places[np.isin(hashes, other)]
    if not len(starts):
        return []
    begins = np.r_[True, starts[1:] > starts[:-1] + k]
    return list(zip(starts[begins].tolist(), (starts[np.r_[begins[1:], True]] + k).tolist()))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K, window: int = WINDOW) -> DataFrame:
    """``df`` with ``out``, the chosen hashes of ``text`` and their places in it."""

    @F.arrow_udf("array<struct<hash long, pos long>>")
    def made(texts: pa.Array) -> pa.Array:
        found = [chosen(t.as_py() or "", k, window) for t in texts]
        ends = np.r_[0, np.cumsum([len(h) for h, _ in found])].astype(np.int32)
        hashes = np.concatenate([np.zeros(0, np.int64), *[h.astype(np.int64) for h, _ in found]])
        places = np.concatenate([np.zeros(0, np.int64), *[p for _, p in found]])
        both = pa.StructArray.from_arrays([pa.array(hashes), pa.array(places)], ["hash", "pos"])
        return pa.ListArray.from_arrays(pa.array(ends), both)

    return df.withColumn(out, made(F.col(f"`{text}`")))


#: Ranges of ids that rows are dealt to for each shuffle partition.
RANGES = 8


def with_next(df: DataFrame, per_range, schema: str) -> DataFrame:
    """``per_range(rows)`` over rows and their successors in descending order of ``doc_id``.

    ``per_range`` gets an iterator of ((doc_id, text), next text) and yields tuples of ``schema``; after
    the smallest id comes the largest. Ids bound the ranges, so equal ids are in one range.
    """
    spark = df.sparkSession
    docs = df.select("doc_id", "text")
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Of each range only its bound comes to the driver.
    bounds = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    bounds = np.unique(np.array(bounds or [], np.int64))

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        # A null id comes last, so it is in the lowest range.
        known = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False)) + 1
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, known), pa.int32())

    dealt = docs.withColumn("part", range_of("doc_id"))
    tops = dealt.groupBy("part").agg(F.max("doc_id").alias("top")).toPandas().sort_values("part")
    parts = [int(p) for p in tops["part"]]
    # The first row of a range is also wanted at the end of the range above it; that of the highest
    # range at the end of the lowest.
    above = dict(zip(parts, [*parts[1:], *parts[:1]]))
    top = {p: (None if t != t or t is None else int(t)) for p, t in zip(parts, tops["top"])}

    @F.arrow_udf("array<struct<part int, borrowed boolean>>")
    def places(part: pa.Array, ids: pa.Array) -> pa.Array:
        out = []
        for p, i in zip(part.to_pylist(), ids.to_pylist()):
            own = [{"part": p, "borrowed": False}]
            out.append([*own, {"part": above[p], "borrowed": True}] if i == top[p] else own)
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("borrowed", pa.bool_())])))

    rows = dealt.select("doc_id", "text", F.explode(places("part", "doc_id")).alias("place")).select("place.*", "doc_id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "part").sortWithinPartitions("part", "borrowed", F.desc("doc_id"), F.asc("text"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, ended = None, None
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                part, borrowed, doc_id, text = (c[i].as_py() for c in columns)
                if held and held[0] == part and ended != part:
                    yield held[1:], text or ""
                if borrowed:
                    ended = part  # further borrowed rows have the same id
                held = (part, doc_id, text or "")

    types = spark.createDataFrame([], schema).schema
    names = types.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, waiting = to_arrow_schema(types), []
        for row in per_range(pairs(batches)):
            waiting.append(row)
            if len(waiting) == 500:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in waiting], arrow)
                waiting = []
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in waiting], arrow)

    return ordered.mapInArrow(run, types)


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "edited_spans string, next_spans string"
)


def compared_with_edits(df: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each text (``doc_id``, ``text``) against its edited form and against the next text.

    The edited text has its last ``floor(n/2)`` characters replaced by as many from the start of the next
    text (all of it, if it is shorter). Fingerprints are the chosen hashes in order, 8 hex digits each. Spans are
    the ``located`` parts of the text itself, as ``start-end`` (first character, one behind the last) with commas between.
    """

    def shown(h: np.ndarray) -> str:
        return h.astype(">u4").tobytes().hex()

    def spans(own: tuple, other: np.ndarray, n: int) -> str:
        return ",".join(f"{a}-{b}" for a, b in located(*own, other, min(k, n)))

    def compare(rows: Iterator[tuple]) -> Iterator[tuple]:
        following, cached = None, None
        for (doc_id, text), after in rows:
            own = cached if following == text and cached is not None else chosen(text, k, window)
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            changed, following = chosen(edited, k, window)[0], after
            cached = chosen(after, k, window)
            sha = hashlib.sha256(edited.encode("utf-8")).hexdigest()
            near = likeness(own[0], changed), likeness(own[0], cached[0])
            yield doc_id, len(text), sha, shown(own[0]), shown(changed), *near, spans(own, changed, len(text)), spans(own, cached[0], len(text))

    return with_next(df, compare, COMPARED)
