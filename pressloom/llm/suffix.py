"""Removal of repeated passages with longest-previous-factor arrays.

A passage is a string of ``LENGTH`` bytes that starts at more than one place of the corpus. With
``keep="first"`` every byte is removed that a later copy of a passage covers; with ``keep="none"`` the first
copy goes as well. Texts are UTF-8 bytes; passages never reach over the end of a text.

Suffixes are dealt out so that equal passages meet:

* Every window of ``LENGTH`` bytes has an anchor, the ``K``-gram in it with the smallest hash (the rightmost of
  equal ones). Neighbouring windows share anchors; the stretch of text that the windows of one anchor
  cover is its segment. Equal passages have equal anchors at the same offset.
* Anchors go to their hash with a hash of their segment, as numbers only. An anchor that occurs once
  is done with. Segments that are equal are counted in one aggregate and need no comparison.
* Where one anchor has different segments, one copy of each is fetched and a task builds the suffix
  array of many such groups at once. In suffix order the previous and the next smaller position give
  the longest earlier match of each position (the longest previous factor); with the order turned
  round they give the longest later one.
* An anchor with more different segments than fit one array (``TOGETHER``) is made longer: its windows are cut into those that
  begin farther before it and those that begin nearer, and each half goes to the longer string that all its windows
  share. Parts of segments that are equal there are counted; the different ones of one such string are few, or it is made
  longer again. After eight halvings the string is the window itself, so no group stays large.

Defined results: null is the empty text; shorter texts have no passages. Equal rows are separate
documents, each a copy of the other; as nothing tells them apart, ``keep="first"`` leaves in all of them
what it leaves in one. First is the row with the smallest id (null last), then hash of
id and text, then place. Only ``doc_id`` and ``text`` are looked at. A text of one byte repeated
has an anchor at every place, which is slow but right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.sources.scratch import cut_lineage

LENGTH, K = 400, 200
#: Different segments of one anchor that go into one suffix array.
TOGETHER = 400
#: Bytes of segments in one suffix array.
BATCH = 1_000_000


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` codes, put together from runs of powers of two."""
    h, have, power, block, size = np.zeros(len(codes), np.uint64), 0, 0x100000001B3, codes.astype(np.uint64) + np.uint64(1), 1
    while size <= k:
        if k & size:
            n = len(codes) - have - size + 1
            h = h[:n] * np.uint64(power) + block[have : have + n]
            have += size
        block = block[:-size] * np.uint64(power) + block[size:]
        power = power * power % (1 << 64)
        size *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def anchors(raw: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, first window, last window): places in ``raw``, the windows being those of each anchor."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none
    h = rolling(np.frombuffer(raw, np.uint8), k) >> np.uint64(32)
    low = np.uint64(0xFFFFFFFF)
    best = (h << np.uint64(32)) | (low - np.arange(len(h), dtype=np.uint64))
    span, window = 1, length - k + 1
    while span < window:
        step = min(span, window - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    at = (low - (best & low)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], len(at)] - 1


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): positions sorted by the ``depth`` codes that follow, and how many codes (``depth`` at
    most) each shares with the one before it. Codes beyond the end are smaller than all others."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    levels, size = [rank], 1
    while size < depth:
        after = np.r_[rank[size:], np.zeros(min(size, n), np.int64)][:n]
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        levels.append(rank)
        size *= 2
    order = np.argsort(rank, kind="stable")
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for level, ranks in reversed(list(enumerate(levels))):
        padded = np.r_[ranks, 0]
        same = (padded[np.minimum(a, n)] == padded[np.minimum(b, n)]) & (a < n) & (b < n)
        step = np.where(same, 1 << level, 0)
        a, b, lcp = a + step, b + step, lcp + step
    return order, np.minimum(np.r_[0, lcp], depth)


def previous_factors(order: np.ndarray, lcp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each entry of ``order`` the longest match with a position that ``first`` ranks before it.

    The nearest entries before and after it in suffix order with a smaller rank are the previous and
    next smaller positions; the larger of the two common prefixes is the longest previous factor.
    """
    rank, out, common = first[order].tolist(), [0] * len(order), lcp.tolist()
    for turn in (range(len(rank)), range(len(rank) - 1, -1, -1)):
        stack: list[tuple[int, int]] = []  # (rank, prefix shared with the entry below it in the stack)
        before = None
        for i in turn:
            shared = 0 if before is None else common[max(i, before)]
            while stack and stack[-1][0] > rank[i]:
                shared = min(shared, stack.pop()[1])
            if stack:
                out[i] = max(out[i], shared)
            stack.append((rank[i], shared))
            before = i
    return np.array(out, np.int64)


def repeated(segments: list[bytes], length: int, keep: str) -> list[list[tuple[int, int]]]:
    """For each segment the ranges of its windows that an earlier one repeats (``keep="first"``), or any
    other one (``keep="none"``). Segments come in their order; ranges are of first bytes of windows."""
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    # Segments without a window whose hash comes twice are not worth sorting.
    chosen = _with_common_windows(segments, length)
    for s, ranges in zip(chosen, _repeated([segments[s] for s in chosen], length, keep) if chosen else ()):
        out[s] = ranges
    return out


def _with_common_windows(segments: list[bytes], length: int) -> list[int]:
    hashes = [rolling(np.frombuffer(s, np.uint8), length) for s in segments]
    owner = np.repeat(np.arange(len(segments)), [len(h) for h in hashes])
    every = np.concatenate([np.zeros(0, np.uint64), *hashes])
    order = np.argsort(every)
    same = every[order[1:]] == every[order[:-1]]
    return np.unique(np.r_[owner[order[1:][same]], owner[order[:-1][same]]]).tolist()


def _repeated(segments: list[bytes], length: int, keep: str) -> list[list[tuple[int, int]]]:
    sizes = np.array([len(s) for s in segments], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = np.zeros(int(sizes.sum() + len(sizes)), np.int64)
    ends = starts + sizes
    inside = np.ones(len(codes), bool)
    inside[ends] = False
    codes[inside] = np.frombuffer(b"".join(segments), np.uint8)
    codes[ends] = 256 + np.arange(len(ends))  # each end is a code of its own, so no match reaches over it
    order, lcp = suffix_order(codes, length)
    # Only neighbours with a whole passage in common can be or have a match.
    linked = lcp >= length
    member = linked | np.r_[linked[1:], False]
    order, lcp = order[member], np.where(linked, lcp, 0)[member]
    place = np.arange(len(codes))
    found = previous_factors(order, lcp, place) >= length
    if keep == "none":
        found |= previous_factors(order, lcp, -place) >= length
    hits = np.sort(order[found])
    owner = np.searchsorted(starts, hits, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    if len(hits):
        breaks = np.flatnonzero((np.diff(hits) != 1) | (np.diff(owner) != 0)) + 1
        for part in np.split(np.arange(len(hits)), breaks):
            s = owner[part[0]]
            out[s].append((int(hits[part[0]] - starts[s]), int(hits[part[-1]] - starts[s])))
    return out


def _uid(df: DataFrame) -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _anchor_rows(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "uid", "key", "seg", "lo", "hi"]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, uid, text in zip(*(batch.column(i) for i in range(3))):
                raw = (text.as_py() or "").encode("utf-8")
                at, lo, hi = anchors(raw, length, k)
                rows[0].append((doc_id.as_py(), uid.as_py(), len(at)))
                rows[2] += [xxhash.xxh64_intdigest(raw[a : a + k]) for a in at.tolist()]
                rows[3] += [xxhash.xxh64_intdigest(raw[a : b + length], 1) for a, b in zip(lo.tolist(), hi.tolist())]
                rows[4].append(lo)
                rows[5].append(hi)
            count = [n for _, _, n in rows[0]]
            owner = np.repeat(np.arange(len(count)), count)
            ids = pa.array([d for d, _, _ in rows[0]], pa.int64()).take(pa.array(owner))
            uids = pa.array([u for _, u, _ in rows[0]], pa.int64()).take(pa.array(owner))
            hashes = [pa.array(np.array(r, np.uint64).view(np.int64)) for r in rows[2:4]]
            places = [pa.array(np.concatenate([np.zeros(0, np.int64), *r])) for r in rows[4:]]
            yield pa.RecordBatch.from_arrays([ids, uids, *hashes, *places], names)

    return run


_ANCHOR = "doc_id long, uid long, key long, seg long, lo long, hi long"
_CONTENT = "key long, seg long, kinds long, at int, doc_id long, uid long, lo long, hi long, copies long, content binary"
_RANGE = "key long, seg long, uid long, lo long, copies long, a long, b long"


def _compare(length: int, keep: str):
    """Ranges of repeated windows; rows come sorted by key and, within it, in their order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def done() -> pd.DataFrame:
            out = []
            for row, ranges in zip(held, repeated([r[-1] for r in held], length, keep)):
                out += [(*row[:-1], a, b) for a, b in ranges]
            return pd.DataFrame(out, columns=[c.split()[0] for c in _RANGE.split(", ")])

        for frame in frames:
            for row in zip(*(frame[c] for c in ("key", "seg", "uid", "lo", "copies", "content"))):
                if size > BATCH and held[-1][0] != row[0]:
                    yield done()
                    held, size = [], 0
                if held and held[-1][:2] == row[:2]:
                    continue  # equal rows of a document fetch the same segment
                held.append(row)
                size += len(row[-1])
        if held:
            yield done()

    return run


def spans(df: DataFrame, keep: str = "none", length: int = LENGTH, k: int = K) -> DataFrame:
    """``uid, spans``: for every text with something to remove the byte ranges, merged and in order, as
    ``array<struct<a, b>>``; ``uid`` is a hash of id and text."""
    docs = df.select("doc_id", _uid(df).alias("uid"), "text")
    found = cut_lineage(docs.mapInArrow(_anchor_rows(length, k), _ANCHOR))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid", "lo", "hi")
    kinds = found.groupBy("key", "seg").agg(F.count("*").alias("copies"), F.min(order).alias("first"))
    per_key = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("copies").alias("all"))
    kinds = cut_lineage(kinds.join(per_key.where(F.col("all") > 1).drop("all"), "key"))
    # Copies of one segment: all of it is repeated, for keep="first" but in its first copy.
    copied = found.join(kinds.where("copies > 1").select("key", "seg", "first"), ["key", "seg"])
    if keep == "first":
        copied = copied.where(~((F.col("uid") == F.col("first.uid")) & (F.col("lo") == F.col("first.lo"))))
    whole = copied.select("uid", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    # Different segments of one anchor: fetch one copy of each.
    fetched = kinds.where("kinds > 1").select("first.*", "key", "seg", "kinds", "copies").drop("no_id")
    wanted = fetched.groupBy("uid").agg(F.collect_list(F.struct("doc_id", "lo", "hi", "key", "seg", "kinds", "copies")).alias("wanted"))
    raw = F.encode(F.col("text"), "utf-8")
    texts = docs.join(wanted, "uid").select("uid", raw.alias("raw"), F.explode("wanted").alias("w"))
    content = F.substring(F.col("raw"), F.col("w.lo").cast("int") + 1, (F.col("w.hi") - F.col("w.lo")).cast("int") + length)
    segments = cut_lineage(texts.select("uid", "w.*", content.alias("content")))
    small, equal = _small_groups(segments, length, k, keep)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = small.repartition(n, "key").sortWithinPartitions("key", F.col("doc_id").asc_nulls_last(), "uid", "lo")
    mixed = ordered.mapInPandas(_compare(length, keep), _RANGE)
    # What has copies is already removed whole, unless its first copy is to be kept.
    mixed = mixed.where("copies = 1") if keep == "none" else mixed
    parts = mixed.select("uid", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b") + length).alias("b"))
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("a", "b"))),
        F.array().cast("array<struct<a:bigint,b:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["b"] >= s["a"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], s["b"]).alias("b"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    for more in equal:
        whole = whole.union(more)
    return whole.union(parts).groupBy("uid").agg(merged.alias("spans"))


def _small_groups(segments: DataFrame, length: int, k: int, keep: str) -> tuple[DataFrame, list[DataFrame]]:
    """(segments or parts of them, by keys with at most ``TOGETHER`` different ones; ranges of equal parts, as ``uid, a, b``).

    ``s`` is the first window of a row and ``x`` to ``y`` are the windows its key stands for, all counted from the anchor.
    """

    @F.arrow_udf("long")
    def first_window(contents: pa.Array) -> pa.Array:
        return pa.array([-int(anchors(c.as_py(), length, k)[0][0]) for c in contents], pa.int64())

    columns = ["key", "seg", "doc_id", "uid", "lo", "copies", "content"]
    small, equal = segments.where(F.col("kinds") <= TOGETHER).select(*columns), []
    large = segments.where(F.col("kinds") > TOGETHER).select(*columns)
    large = large.withColumns({"s": first_window("content"), "x": F.lit(k - length).cast("long"), "y": F.lit(0).cast("long")})
    while not large.isEmpty():
        parts = cut_lineage(_halves(large, length))
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid", "lo")
        kinds = parts.groupBy("key", "seg").agg(F.count("*").alias("n"), F.min(order).alias("first"))
        per_key = kinds.groupBy("key").agg(F.count("*").alias("kinds"))
        is_first = (F.col("uid") == F.col("first.uid")) & (F.col("lo") == F.col("first.lo"))
        copied = parts.join(kinds.where("n > 1"), ["key", "seg"])
        if keep == "first":
            copied = copied.where(~is_first)
        equal.append(copied.select("uid", F.col("lo").alias("a"), (F.col("lo") + F.octet_length("content")).alias("b")))
        several = kinds.join(per_key.where("kinds > 1"), "key").select("key", "seg", "first", "kinds")
        large = cut_lineage(parts.join(several, ["key", "seg"]).where(is_first).drop("first"))
        small = small.union(large.where(F.col("kinds") <= TOGETHER).select(*columns))
        large = large.where(F.col("kinds") > TOGETHER).drop("kinds")
    return small, equal


def _halves(rows: DataFrame, length: int) -> DataFrame:
    """Each row as its windows up to the middle of ``x`` to ``y`` and those after it, by the string that the windows of a half share."""
    middle = F.floor((F.col("x") + F.col("y")) / 2)
    both = F.array(F.struct(F.col("x"), middle.alias("y")), F.struct((middle + 1).alias("x"), F.col("y")))
    cut = rows.withColumn("half", F.explode(both)).withColumns({"x": F.col("half.x"), "y": F.col("half.y")})
    last = F.col("s") + F.octet_length("content") - length
    cut = cut.withColumns({"from": F.greatest("x", "s"), "to": F.least(F.col("y"), last)}).where(F.col("from") <= F.col("to"))

    def piece(begin: Column, size: Column) -> Column:
        return F.substring(F.col("content"), (begin - F.col("s")).cast("int") + 1, size.cast("int"))

    shared = piece(F.col("y"), F.col("x") - F.col("y") + length)
    content = piece(F.col("from"), F.col("to") - F.col("from") + length)
    return cut.select(
        F.xxhash64("key", "x", shared).alias("key"), F.xxhash64("from", content, F.lit(1)).alias("seg"), "doc_id", "uid",
        (F.col("lo") + F.col("from") - F.col("s")).alias("lo"), "copies", content.alias("content"), F.col("from").alias("s"), "x", "y",
    )


def remove_repeats(df: DataFrame, keep: str = "none", length: int = LENGTH, k: int = K) -> DataFrame:
    """``doc_id, spans, n_bytes, kept`` for every row of ``df`` (``doc_id``, ``text``): the byte ranges that go and the
    bytes that stay, as binary, since a range may cut a character in two."""

    @F.arrow_udf("binary")
    def left(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for text, ranges in zip(texts, gone):
            raw, at, parts = (text.as_py() or "").encode("utf-8"), 0, []
            for r in ranges.as_py() or ():
                parts.append(raw[at : r["a"]])
                at = r["b"]
            out.append(b"".join([*parts, raw[at:]]))
        return pa.array(out, pa.binary())

    docs = df.select("doc_id", _uid(df).alias("uid"), "text")
    done = docs.join(spans(df, keep, length, k), "uid", "left")
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return done.select(
        "doc_id", F.coalesce("spans", none).alias("spans"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        left("text", "spans").alias("kept"),
    )
