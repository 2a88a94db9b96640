"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A text's fingerprint has 64 bits: a bit is set if more than half of the XXH64 hashes of its 3-word
shingles have it. Texts whose fingerprints differ in few bits are linked.

To find links, a fingerprint is cut into three segments of at most 23 bits. The binary Golay code
is perfect: every 23-bit word is within 3 bits of exactly one of 4096 codewords. The words within one
bit of a segment decode to a few codeword indices, and two segments that differ in up to two bits
have an index in common, that of a word between them. Two errors leave one of three segments as
it is, so each fingerprint gets the keys (segment i as it is, index of the next segment), about 17
of them, and every link has a common key. Candidates are verified by counting bits.

Equal fingerprints are one node from the start. Buckets of up to ``SMALL`` fingerprints are joined in
pairs. The fingerprints of larger buckets go another exact way: each joins the 65 balls of radius 1
that hold it; a ball holds 65 fingerprints at most, all linked to each other, and every link lies in
a ball. So no group, however large, is expanded into pairs.

Defined results: a text of fewer than three words is one shingle; a text without words, and null, has
fingerprint 0, linked like any other. Repeated rows are returned as often as they occur. A null
id counts only where no other id is in its component. Only ``doc_id`` and ``text`` are looked at.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.components import components
from pressloom.llm.rows import MARKS, marked, rows_of
from pressloom.operators.skew import first_per
from pressloom.sources.scratch import cut_lineage

SHINGLE = 3
SEED = 42
#: A link: this many differing bits or fewer. The keys below are made for it.
BITS = 2
SMALL = 32
#: Low bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fixed value: the generator polynomial of the binary Golay code.
GENERATOR = 0b110001110101


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text, as a signed number."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[:-1]]
    hashed = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [hashed(joined, SEED)]
    else:
        hashes = [hashed(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with ``out``, the fingerprint of ``text`` (long)."""

    @F.arrow_udf("long")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())

    return df.withColumn(out, made(F.col(f"`{text}`")))


class Golay:
    """Decoding of 23-bit words to the index of the nearest codeword."""

    def __init__(self) -> None:
        word = np.arange(1 << 12, dtype=np.int64)
        # The remainder by the generator is linear: that of a word is made from those of its halves.
        self.low, self.high = self._remainder(word), self._remainder(word << 12)
        self.error = np.zeros(1 << 11, np.int64)
        single = [1 << i for i in range(23)]
        for a in [0, *single]:
            for b in [0, *single]:
                for c in [0, *single]:
                    e = a | b | c
                    self.error[self.low[e & 4095] ^ self.high[e >> 12]] = e

    @staticmethod
    def _remainder(word: np.ndarray) -> np.ndarray:
        rest = word.copy()
        for bit in range(23, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
        return rest

    def index(self, word: np.ndarray) -> np.ndarray:
        return (word ^ self.error[self.low[word & 4095] ^ self.high[word >> 12]]) >> 11

    def near(self, word: np.ndarray) -> np.ndarray:
        """Indices of each word and of its 23 neighbours (words x 24, repeats included)."""
        return self.index(word[:, None] ^ np.r_[0, 1 << np.arange(23)])


def link_keys(prints: np.ndarray) -> list[np.ndarray]:
    """The keys of each fingerprint."""
    golay, bits = Golay(), prints.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [golay.near(p) for p in parts]
    keys = np.hstack([((i << 22 | parts[i]) << 12)[:, None] | near[(i + 1) % 3] for i in range(3)])
    return [np.unique(row) for row in keys]


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: links between the distinct fingerprints in column ``fingerprint`` of ``prints``; at
    least enough of them that everything linked is connected."""

    @F.arrow_udf("array<long>")
    def keys_of(column: pa.Array) -> pa.Array:
        return pa.array(link_keys(column.to_numpy(zero_copy_only=False)), pa.list_(pa.int64()))

    keyed = prints.select("fingerprint").distinct().select("fingerprint", F.explode(keys_of("fingerprint")).alias("key"))
    shared = cut_lineage(keyed).transform(lambda k: k.join(k.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    shared = cut_lineage(shared)
    small, large = shared.where(F.col("n") <= SMALL), shared.where(F.col("n") > SMALL)
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = small.select("key", F.col("fingerprint").alias("a")).join(
        small.select("key", F.col("fingerprint").alias("b")), "key"
    ).where((F.col("a") < F.col("b")) & (differ <= BITS)).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)])
    balls = large.select("fingerprint").distinct().select(
        "fingerprint", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fingerprint")))).alias("ball")
    )
    # A ball has 65 members at most, so this list is bounded.
    within = balls.groupBy("ball").agg(F.min("fingerprint").alias("a"), F.collect_set("fingerprint").alias("all"))
    within = within.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.union(within)


def near_duplicates(df: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``df`` (``doc_id``, ``text``): the
    fingerprint as a number and the smallest id that can be reached by links, its own included."""
    printed = cut_lineage(fingerprints(df.select("doc_id", "text")).select("doc_id", "fingerprint"))
    return _with_components(printed)


def _with_components(printed: DataFrame) -> DataFrame:
    nodes = printed.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    trees = components(links(printed)).select(F.col("node").alias("fingerprint"), "root")
    rooted = nodes.join(trees, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    rooted = cut_lineage(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return printed.join(named, "fingerprint").select(*[c for c in printed.columns if c != "fingerprint"], "fingerprint", "component_id")


def keep_one(df: DataFrame) -> DataFrame:
    """The rows of ``df`` of which one stays of each component: the smallest id (null last), then the
    smallest hash of id and text; one row of those that are equal in both."""
    narrow = marked(df).select("doc_id", *MARKS, "text")
    printed = cut_lineage(fingerprints(narrow).select("doc_id", *MARKS, "fingerprint"))
    first = first_per(_with_components(printed), ["component_id"], [F.col("doc_id").asc_nulls_last(), *MARKS])
    return rows_of(df, first.select(*MARKS)).drop(*MARKS)
