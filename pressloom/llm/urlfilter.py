"""URL filters with a Bloom filter cascade.

A rule is (action, host, path). It fits a url whose host is the rule's or a subdomain of it and whose
path starts with the rule's; of several the longest wins (then the longer host).

A url has few keys that a rule could be: a suffix of its host with a beginning of its path as long as
one of the rules' paths. All such keys of the corpus are the universe. The cascade's first Bloom
filter holds the rules' keys; the second the keys of the universe that the first lets through by
mistake; the third those rule keys that the second lets through, and so on until nothing passes by
mistake. Levels take turns, so for every key of the universe the first level that rejects it tells
whether it is listed: exactly, without a join and without the rules themselves.

A filter's size follows the rule list and the mistakes: the first level's error rate is ``1 / ERROR``, and smaller for a
universe of more than ``ERROR * MISTAKES`` keys, so that the second level holds about ``MISTAKES`` keys at most. That costs the first one
1.44 bits a rule for each doubling. The universe's distinct keys are found once and written; only bits come to the driver, as words
that hold at least one key each.

Defined results: null and a url without ``://`` have host and path ''. An empty host has no keys. A url
that no rule fits is not listed, and gets ``DEFAULT``. Repeated rows give equal rows; without rules
everything gets ``DEFAULT``. Other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.sources.scratch import cut_lineage

DEFAULT = "allow"
#: One in so many keys passes the first level by mistake, or fewer: about as many as MISTAKES at most; one in two passes each later one.
ERROR = 256
#: Keys that the second level is expected to hold at most, whatever the corpus: 180 KB of bits.
MISTAKES = 1_000_000
Rule = tuple[str, str, str]  # action, host, path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that a rule fitting the url could have, longest first: host and path with a space
    between them."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    begins = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    begins = F.array_compact(begins)
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(begins, lambda b: F.concat(s, F.lit(" "), b))))
    order = F.array_sort(
        F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), (-F.instr(k, " ")).alias("h"), k.alias("key")))
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(order, lambda s: s["key"]))


@dataclass
class Level:
    """One Bloom filter: its number of bits, of hashes and its words of 64 bits by place."""

    bits: int
    hashes: int
    words: dict[int, int]


def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def contains(key: Column, level: int, made: Level) -> Column:
    """Whether ``made`` lets ``key`` through."""
    if not made.words:
        return F.lit(False)
    filled = [made.words.get(i, 0) for i in range((made.bits + 63) // 64)]
    # One constant array; its text is parsed once, when the plan is made.
    words = F.from_json(F.lit(str(filled)), "array<bigint>")
    tests = [F.getbit(F.element_at(words, (p / 64).cast("int") + 1), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in _places(key, level, made.bits, made.hashes)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _filled(keys: DataFrame, level: int, error: float) -> Level:
    """A filter of the column ``key``; one in ``error`` keys passes by mistake. Bits are set by an aggregation over their words."""
    n = keys.count()
    if not n:
        return Level(64, 1, {})
    rate = 1 / error
    bits = 64 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64)
    hashes = max(1, round(bits / n * math.log(2))) if level == 0 else 1
    at = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits, hashes))).alias("at"))
    words = at.groupBy((F.col("at") / 64).cast("long").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("bits")
    )
    return Level(bits, hashes, {r.word: r.bits for r in words.collect()})


class Cascade:
    """Exact membership of the universe's keys in a list of keys."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """From tables with the column ``key``. ``universe`` holds every key that will be asked for and is read at each level.
        ``listed`` is broadcast: a list that was in memory before."""
        listed = listed.select("key").distinct()
        others = universe.select("key").distinct().join(F.broadcast(listed), "key", "left_anti")
        inside, outside, levels = listed, others, []
        first = max(ERROR, universe.count() / MISTAKES)
        while True:
            made = _filled(inside, len(levels), 2 if levels else first)
            levels.append(made)
            if not made.words:
                return cls(levels)
            passing = outside.where(contains(F.col("key"), len(levels) - 1, made))
            inside, outside = passing, inside

    def lists(self, key: Column) -> Column:
        """Whether ``key`` is listed: rejected by an odd level it is, by an even one it is not."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~contains(key, i, self.levels[i]), F.lit(i % 2 == 1)).otherwise(out)
        return out


def judge(df: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (host and path, or null) and ``verdict``.

    ``rules`` is a list in memory, as block lists are; its size bounds that of the first filter.
    """
    spark = df.sparkSession
    parsed = df.withColumns({"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))})
    lengths = sorted({len(p) for _, _, p in rules})
    keys = keys_of(F.col("host"), F.col("path"), lengths)
    universe = cut_lineage(parsed.select(F.explode(keys).alias("key")).distinct())
    cascades = {}
    for action in ("allow", "block"):
        own = [(f"{h} {p}",) for a, h, p in rules if a == action]
        cascades[action] = Cascade.build(spark.createDataFrame(own, "key string"), universe)
    # Longest first, so the first listed key is the rule.
    found = F.transform(
        keys,
        lambda k: F.struct(k.alias("key"), F.when(cascades["block"].lists(k), "block").when(cascades["allow"].lists(k), "allow").alias("action")),
    )
    done = parsed.withColumn("_found", F.get(F.filter(found, lambda f: f["action"].isNotNull()), F.lit(0)))
    return done.withColumns({
        "rule": F.translate(F.col("_found.key"), " ", ""),
        "verdict": F.coalesce(F.col("_found.action"), F.lit(DEFAULT)),
    }).drop("_found")
