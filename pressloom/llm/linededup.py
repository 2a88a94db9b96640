"""Line deduplication: lines within a few edits of an earlier line are removed.

Lines of at least ``shortest`` characters (ends trimmed; ``LEAST`` unless the caller says otherwise) take part; shorter
ones stay. The queries take part with all lines that are not blank. Two lines of at least ``LEAST`` characters are
linked if they differ in up to ``EDITS`` insertions, deletions and replacements of characters; of shorter ones two edits
would make another line, so only equal ones are alike. Linked lines form classes, and so do equal ones; the first line of a class, by id and place, stays where it is and all others go.

Lines are cut into ``EDITS + 1`` segments of (nearly) equal length. Up to ``EDITS`` edits leave one of them as it is,
so every line is indexed by (length, number, segment), and probes the index with the substrings of
itself that a segment of a line as long or up to ``EDITS`` characters shorter could have become: those
within as many places of it as edits before and after it allow.

* Keys are hashes and meet without any text. A key that only one line has is done with; the texts of the
  lines that share one are fetched afterwards.
* The lines of the other keys meet in a join. Its condition first compares 64-bit masks of their
  characters, pairs and triples, then the banded bit-parallel edit distance, so pairs that are not links do not
  leave the join.
* Equal lines are one line from the start; a line with more than a thousandth of all occurrences is
  keyed at its first one only.

Only DataFrame functions are used.

Defined results: null is the empty text. A text without lines to remove stays as it is, byte for byte; in
others the lines that stay are joined by line ends. Equal rows are treated alike: what one keeps, all
keep. Ids in order, null last. Texts and lines of any length are compared and rebuilt whole, in time that grows with them. Other columns
pass through; those called ``n_lines``, ``n_removed``, ``n_near`` or ``n_links`` are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.components import components
from pressloom.llm.rows import MARKS, marked
from pressloom.operators.skew import fits, only_keys_of
from pressloom.sources.scratch import cut_lineage

EDITS = 2
LEAST = 20
#: A line with more than this part of all occurrences is keyed once.
HOT = 1_000
#: Lengths of the runs of characters that lines are compared by before their distance is found.
RUNS = (1, 2, 3)
_ENDS = " \t\r\v\f"


def occurrences(df: DataFrame, shortest: int = LEAST) -> DataFrame:
    """``doc_id``, the marks of the row, ``pos, line, n`` and two hashes ``h1, h2`` of every line that takes part."""
    # Everything a line needs is made inside the list, so that it is made once and not in each use.
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_ENDS)))
    sized = F.transform(trimmed, lambda x, i: F.struct(i.alias("pos"), x.alias("line"), F.length(x).alias("n")))
    lines = marked(df).select("doc_id", *MARKS, F.explode(F.filter(sized, lambda s: s["n"] >= max(shortest, 1))).alias("_line"))
    lines = lines.select("doc_id", *MARKS, "_line.*")
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(1))})


def _tries(edits: int) -> list[tuple[bool, int, int, int]]:
    """(probe, segment, how much shorter the other line is, shift) of all keys of a line.

    A line of the same length meets an unmoved segment as its own segment, so that is no probe. Up to two edits
    move a segment of it by one only if one line has an insertion before and a deletion behind it; seen from
    that line the move is forward, so moves back need no probe.
    """
    out = [(False, i, 0, 0) for i in range(edits + 1)]
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            # Edits before the segment move it by i at most, edits behind it by edits - i.
            shifts = range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1)
            out += [(True, i, shorter, s) for s in shifts if shorter or s > 0 or (s < 0 and edits > 2)]
    return out


def keyed(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """``h1, key, probe`` for the segments of every line (``h1, line, n``) and the substrings it probes with: a row for each.
    Keys are hashes, of which a segment and a probe that meet have the same 63 bits.

    The tries are rows and not a function of the line, so that what makes a key is short and is compiled.
    """
    names = ("probe", "i", "shorter", "shift")
    tries = F.array(*[F.struct(*[F.lit(int(v)).alias(k) for k, v in zip(names, t)]) for t in _tries(edits)])
    rows = lines.select("h1", "line", "n", F.explode(tries).alias("t")).select("h1", "line", "n", "t.*")
    length, parts, least = F.col("n") - F.col("shorter"), edits + 1, lambda a, b: F.when(a < b, a).otherwise(b)
    rows = rows.select("h1", "line", "n", "probe", "i", "shift", length.alias("length"), F.call_function("div", length, F.lit(parts)).cast("int").alias("base"))
    # The last segments are one longer, as many as the length needs.
    spare = F.col("i") + F.col("length") - F.col("base") * parts - parts
    start = F.col("base") * F.col("i") + F.col("shift") - least(F.lit(0), -spare)
    size = F.col("base") + F.when(spare >= 0, 1).otherwise(0)
    rows = rows.select("h1", "line", "n", "probe", "i", "length", start.alias("start"), size.alias("size"))
    rows = rows.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
    hashed = F.xxhash64("length", "i", F.substring("line", F.col("start") + 1, F.col("size")))
    return rows.select("h1", F.call_function("shiftright", hashed, F.lit(1)).alias("key"), (F.col("probe") == 1).alias("probe"))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parity_mask(chars: Column, run: int) -> Column:
    """64 bits, each the parity of the number of runs of ``run`` characters hashed to it. One edit changes
    ``run`` runs into as many at most, so it flips ``2 * run`` bits at most."""

    def mask(chars: Column) -> Column:
        hashed = lambda i: F.xxhash64(*[F.get(chars, i - k) for k in range(run)])
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(hashed(i), F.lit(64)).cast("int"))
        places = F.sequence(F.lit(run - 1), F.size(chars) - 1)
        return F.aggregate(places, F.lit(0).cast("long"), lambda m, i: m.bitwiseXOR(bit(i)))

    return once(chars, mask)


def distance(short: Column, long: Column, edits: int = EDITS) -> Column:
    """Edit distance of two arrays of characters, right where it is at most ``edits``; more otherwise.
    ``long`` has as many characters or up to ``edits`` more, ``short`` more than ``edits``.

    A column of the dynamic programme is kept as its differences up and down, one bit for each row of a band
    of ``2 * edits + 1`` around the diagonal. The band's lowest row is followed to the last row, then along it.
    """
    both = F.struct(short.alias("short"), long.alias("long"))
    return once(both, lambda both: _distance(both["short"], both["long"], edits))


def _distance(short: Column, long: Column, edits: int) -> Column:
    width = 2 * edits + 1
    full = F.lit((1 << width) - 1).cast("long")
    m, n = F.size(short), F.size(long)
    bit = lambda c, i: F.call_function("shiftright", c, i).bitwiseAND(F.lit(1).cast("long"))
    flip = lambda c: c.bitwiseXOR(F.lit(-1).cast("long"))

    def step(state: Column, j: Column) -> Column:
        up, down, now = state["up"], state["down"], F.get(long, j - 1)
        bits = [F.when(F.get(short, j - 1 - edits + b) == now, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(width)]
        same = reduce(Column.bitwiseOR, bits).cast("long")
        level = once(same, lambda s: (s.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(s).bitwiseOR(down).bitwiseAND(full))

        def rest(level: Column) -> Column:
            more = down.bitwiseOR(flip(level.bitwiseOR(up))).bitwiseAND(full)
            less = level.bitwiseAND(up)
            row = m - j + edits
            along = bit(more, row.cast("int")) - bit(less, row.cast("int"))
            change = F.when(j <= m - edits, 1 - bit(level, F.lit(width - 1))).otherwise(along)
            moved = F.call_function("shiftright", level, F.lit(1))
            return F.struct(
                less.bitwiseOR(flip(moved.bitwiseOR(more))).bitwiseAND(full).alias("up"),
                moved.bitwiseAND(more).alias("down"),
                (state["d"] + change).alias("d"),
            )

        return once(level, rest)

    start = F.struct(
        F.lit(((1 << (edits + 1)) - 1) << edits).cast("long").alias("up"), F.lit(0).cast("long").alias("down"), F.lit(edits).cast("long").alias("d")
    )
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["d"])


def links(found: DataFrame, kinds: DataFrame, edits: int = EDITS) -> DataFrame:
    """``a, b``: pairs of different lines (their ``kind``) within ``edits`` edits, each once."""
    found = found.where(F.col("n") >= LEAST)
    total = kinds.agg(F.sum("copies")).first()[0] or 0
    hot = kinds.where(F.col("copies") > max(HOT, total // HOT)).select("h1", "h2", F.col("first").alias("_first"))
    # At most HOT lines can have so large a part.
    placed = found.join(F.broadcast(hot), ["h1", "h2"], "left")
    at_first = reduce(Column.__and__, [F.col(c) == F.col(f"_first.{c}") for c in (*MARKS, "pos")])
    tried = keyed(placed.where(F.col("_first").isNull() | at_first), edits)
    # Two numbers a row: what a segment and its probes have in common, and the line's hash, whose sign says which it is.
    sign, rest = F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1).cast("long")
    hash63 = F.col("h1").bitwiseAND(rest)
    tried = tried.select("key", F.when(F.col("probe"), hash63).otherwise(hash63.bitwiseOR(sign)).alias("h"))
    group = Window.partitionBy("key")
    met = tried.withColumns({"low": F.min("h").over(group), "high": F.max("h").over(group)})
    # Some segment is there, and something else.
    shared = met.where((F.col("low") < 0) & (F.col("low") < F.col("high"))).select("key", "h").distinct()
    shared = cut_lineage(shared.select("key", (F.col("h") >= 0).alias("probe"), F.col("h").bitwiseAND(rest).alias("h")))
    wanted = cut_lineage(shared.select("h").distinct())
    # From here on lines have both hashes: one that shares part of the first with another is told from it.
    lines = found.select("h1", "h2", "line", hash63.alias("h"))
    texts = only_keys_of(lines, wanted, ["h"], fits(wanted)).groupBy("h1", "h2").agg(F.first("line").alias("line"), F.first("h").alias("h"))
    masks = {f"mask{run}": parity_mask(F.split("line", ""), run) for run in RUNS}
    texts = texts.join(wanted, "h", "left_semi").join(kinds.select("h1", "h2", "kind"), ["h1", "h2"]).drop("h1", "h2")
    met = cut_lineage(shared.join(cut_lineage(texts.withColumns(masks)), "h"))
    side = lambda df, name: df.select("key", *[F.col(c).alias(f"{name}_{c}") for c in ("kind", "probe", "line", *masks)])
    near = reduce(Column.__and__, [F.bit_count(F.col(f"a_mask{r}").bitwiseXOR(F.col(f"b_mask{r}"))) <= 2 * r * edits for r in RUNS])
    # Two segments that are equal say the same of both lines; a probe comes from the line that is no shorter.
    once_each = (F.col("a_kind") < F.col("b_kind")) | (F.col("b_probe") & (F.col("a_kind") != F.col("b_kind")))
    close = distance(F.split("a_line", ""), F.split("b_line", ""), edits) <= edits
    pairs = side(met.where(~F.col("probe")), "a").join(side(met, "b"), "key").where(once_each & near & close)
    return pairs.select(F.least("a_kind", "b_kind").alias("a"), F.greatest("a_kind", "b_kind").alias("b")).distinct()


def judged(df: DataFrame, edits: int = EDITS, shortest: int = LEAST) -> DataFrame:
    """The marks and ``gone, near, links`` of each text with repeated or linked lines: the places of the lines that go, how
    many of them only resemble the line that stays, and how many links its lines have to different lines."""
    found = occurrences(df, shortest)
    placed = cut_lineage(found.select("doc_id", *MARKS, "pos", "h1", "h2"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *MARKS, "pos")
    kinds = placed.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min(order).alias("first"))
    # Written with their numbers: a line has the same one whenever they are read.
    kinds = cut_lineage(kinds.withColumn("kind", F.monotonically_increasing_id()))
    pairs = cut_lineage(links(found, kinds, edits))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("kind")).groupBy("kind").agg(F.count("*").alias("links"))
    trees = components(pairs).withColumnRenamed("node", "kind").join(degree, "kind")
    linked = kinds.join(trees, "kind")
    firsts = linked.groupBy("root").agg(F.min("first").alias("class_first"))
    linked = linked.join(firsts, "root").select("h1", "h2", "first", "class_first", "links")
    alone = kinds.where("copies > 1").join(trees, "kind", "left_anti").select("h1", "h2", "first", F.col("first").alias("class_first"), F.lit(0).cast("long").alias("links"))
    classes = cut_lineage(linked.unionByName(alone))
    stays = reduce(Column.__and__, [F.col(c) == F.col(f"class_first.{c}") for c in (*MARKS, "pos")])
    lines = placed.join(classes, ["h1", "h2"]).withColumns({"stays": stays, "near": ~stays & (F.col("first") != F.col("class_first"))})
    return lines.groupBy(*MARKS).agg(
        # No more than the lines of one text. Equal rows have the same places.
        F.sort_array(F.collect_set(F.when(~F.col("stays"), F.col("pos")))).alias("gone"),
        F.count_distinct(F.when(F.col("near"), F.col("pos"))).alias("near"),
        F.sum("links").alias("links"),
    )


def without(lines: Column, gone: Column) -> Column:
    """The array ``lines`` without the places ``gone``, in time that grows with its length alone."""
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    return once(lines, lambda held: F.transform(F.array_except(places, gone), lambda i: F.get(held, i)))


def dedup_lines(df: DataFrame, edits: int = EDITS, shortest: int = LEAST) -> DataFrame:
    """``df`` with ``text`` without the lines that go and ``n_lines``, ``n_removed``, ``n_near``, ``n_links``."""
    found = judged(df.select("doc_id", "text"), edits, shortest)
    joined = marked(df).join(found.select(*MARKS, F.struct("gone", "near", "links").alias("_judged")), MARKS, "left")
    gone = F.coalesce("_judged.gone", F.array().cast("array<int>"))
    left = F.array_join(without(F.split("text", "\n"), gone), "\n")
    counts = {
        "n_lines": F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long"), "n_removed": F.size(gone).cast("long"),
        "n_near": F.coalesce("_judged.near", F.lit(0)).cast("long"), "n_links": F.coalesce("_judged.links", F.lit(0)).cast("long"),
    }
    done = joined.withColumns({**counts, "_left": F.when(F.size(gone) > 0, left).otherwise(F.col("text"))})
    others = [F.col("_left").alias("text") if c == "text" else F.col(f"`{c}`") for c in df.columns if c not in counts]
    return done.select(*others, *counts)
