"""Mixing sources to target weights.

Sources are ordered by code point (null last) and weigh 5, 2, 1 and so on; together they get as many
words as there are. No source gets more than ``MOST`` times its own words: what is above goes to the
others by weight until none is above (the level is found in one pass over the sources sorted by the
level at which they fill up).

The documents of a source, in pseudorandom order, are packed into blocks of ``BLOCK`` words; a
document lies in one or more blocks and has a place in each. The output is a row of slots, each of
which takes one block, in shards of ``SHARD`` slots:

* A pseudorandom permutation deals all slots to the sources. The numbers that a shard draws from the
  sources are a multinomial draw under the condition that the targets are met over all shards.
  (Free draws would miss the target of a source with 60 blocks by 13 %.)
* The slots of a source run through its blocks again and again, each time in the order of another
  permutation of the block numbers, so no block is taken more than ``MOST`` times.
* Slots and the pieces of documents meet in a join on (source, block).

The permutations are "swap or not" shuffles: a few rounds of arithmetic on any range, no sort. The place
of a document is the sum of the sizes before it, over ``PARTS`` hashed parts of each source and within one
part, so a source with a third of all rows is spread over thousands of groups.

Only DataFrame functions are used. Everything follows from hashes of the rows, so reruns agree.

Defined results: null and blank texts have size 0 and are never taken; a source without words has
the target 0; equal rows are separate documents. A shorter last block is a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.rows import MARKS, marked, rows_of
from pressloom.sources.scratch import cut_lineage

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 128
SHARD = 8_192
PARTS = 4_096
ROUNDS = 24
#: Slots that are made from one row.
RUN = 1_024
WORD = r"[^\x20\x09-\x0D]+"


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 to ``n - 1``; ``key`` says which one."""

    def swap_or_not(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        swap = F.xxhash64(*key, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap_or_not)


def sized(df: DataFrame) -> DataFrame:
    """``doc_id, source, size`` and two hashes that tell rows apart. Written once, without texts."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return cut_lineage(marked(df).select("doc_id", "source", size.alias("size"), *MARKS))


def quotas(docs: DataFrame) -> DataFrame:
    """One row per source: ``sid``, ``source``, ``source_size``, ``target``, ``blocks``, ``slots`` and ``first``,
    the slots of the sources before it. The windows are over sources, whose weights are a setting."""
    total = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    named = total.withColumn("sid", F.row_number().over(by_name).cast("long") - 1)
    named = named.withColumn("weight", F.element_at(weights, (F.col("sid") % len(WEIGHTS) + 1).cast("int")))
    named = named.withColumn("cap", MOST * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("full_at", "sid")
    all_rows = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    named = named.withColumn("level", (F.sum("source_size").over(all_rows) - before) / rest)
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(all_rows)
    named = named.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level))
    named = named.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    mean = F.col("source_size") / F.col("blocks")
    slots = F.when(F.col("blocks") > 0, F.least(MOST * F.col("blocks"), F.round(F.col("target") / mean).cast("long"))).otherwise(F.lit(0))
    named = named.withColumn("slots", slots)
    first = F.sum("slots").over(by_name) - F.col("slots")
    named = named.withColumns({"first": first, "all_slots": F.sum("slots").over(by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return cut_lineage(named.select("sid", "source", "source_size", "target", "blocks", "slots", "first", "all_slots"))


def with_source(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` with ``sid``, ``source_size`` and ``target``."""
    return docs.join(
        plan.select("sid", F.col("source").alias("_source"), "source_size", "target"), docs["source"].eqNullSafe(F.col("_source"))
    ).drop("_source")


def placed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` with ``sid``, ``source_size``, ``target`` and ``start``, the words of the source before it."""
    named = with_source(docs, plan).withColumn("part", F.pmod(MARKS[0], F.lit(PARTS)))
    sums = named.groupBy("sid", "part").agg(F.sum("size").alias("in_part"))
    before = F.sum("in_part").over(Window.partitionBy("sid").orderBy("part")) - F.col("in_part")
    offsets = sums.select("sid", "part", before.alias("offset"))
    within = F.sum("size").over(Window.partitionBy("sid", "part").orderBy(*MARKS).rowsBetween(Window.unboundedPreceding, 0))
    return named.withColumn("within", within - F.col("size")).join(offsets, ["sid", "part"]).withColumn(
        "start", F.col("offset") + F.col("within")
    ).drop("part", "within", "offset")


def pieces(docs: DataFrame) -> DataFrame:
    """The placed documents with one row per block they lie in: ``block`` and the words ``from_word`` up to,
    not including, ``to_word`` of the document. A document without words has one row of nulls."""
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / BLOCK), last))
    cut = docs.withColumn("block", F.explode_outer(blocks))
    begin = F.greatest(F.col("block") * BLOCK, F.col("start")) - F.col("start")
    end = F.least((F.col("block") + 1) * BLOCK, F.col("start") + F.col("size")) - F.col("start")
    return cut.withColumns({"from_word": begin, "to_word": end})


def slots(plan: DataFrame) -> DataFrame:
    """``shard, slot, sid, block``: what every slot of the output takes."""
    n = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last_run = F.floor((F.col("slots") - 1) / RUN)
    # Two steps, so that no list of runs is longer than RUN.
    thousands = F.sequence(F.lit(0).cast("long"), F.floor(last_run / RUN))
    runs = plan.where("slots > 0").withColumn("thousand", F.explode(thousands))
    within = F.sequence(F.col("thousand") * RUN, F.least((F.col("thousand") + 1) * RUN - 1, last_run))
    # The rows are few but each becomes very many: with a number of its own the planner leaves them apart.
    runs = runs.withColumn("run", F.explode(within)).drop("thousand").repartition(n, "sid", "run")
    last = F.least((F.col("run") + 1) * RUN, F.col("slots")) - 1
    each = runs.withColumn("j", F.explode(F.sequence(F.col("run") * RUN, last)))
    turn = F.floor(F.col("j") / F.col("blocks"))
    block = permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.lit("block"), F.col("sid"), turn)
    slot = permuted(F.col("first") + F.col("j"), F.col("all_slots"), F.lit("slot"))
    out = each.select("sid", block.alias("block"), slot.alias("slot"))
    return out.withColumn("shard", F.floor(F.col("slot") / SHARD))


def taken(df: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``df`` (``doc_id``, ``text``, ``source``)."""
    docs = sized(df)
    plan = quotas(docs)
    uses = slots(plan).groupBy("sid", "block").agg(F.count("*").alias("uses"))
    # The planner takes the slots for as few as the sources they are made from; both sides grow with the data.
    cut = pieces(placed(docs.where("size > 0"), plan)).join(uses.hint("merge"), ["sid", "block"], "left")
    words = F.coalesce(F.sum((F.col("to_word") - F.col("from_word")) * F.col("uses")), F.lit(0)).cast("long")
    row = ["doc_id", "source", "size", "source_size", "target"]
    # Equal rows differ in their start, but only where they have words; the others are not grouped.
    some = cut.groupBy(*row, "sid", "start", *MARKS).agg(words.alias("taken")).select(*row, "taken")
    none = with_source(docs.where("size = 0"), plan).select(*row, F.lit(0).cast("long").alias("taken"))
    return some.union(none)


def mixed(df: DataFrame) -> DataFrame:
    """The mix itself: the columns of ``df`` for every piece of a document that a slot takes, ``text`` being the
    words of the piece with one space between them (``n_chars``, if there is one, their length), and ``shard, slot, from_word``, which give the order."""
    docs = sized(df)
    plan = quotas(docs)
    cut = pieces(placed(docs, plan)).where("block IS NOT NULL").select(*MARKS, "sid", "block", "from_word", "to_word")
    picked = slots(plan).hint("merge").join(cut, ["sid", "block"])
    # At most MOST times the blocks of a document, so this list is as bounded as its text.
    picked = picked.groupBy(*MARKS).agg(F.collect_list(F.struct("shard", "slot", "from_word", "to_word")).alias("_picked"))

    def cut_out(words: Column) -> Column:
        number = lambda c: c.cast("int")
        return F.transform("_picked", lambda p: p.withField(
            "text", F.array_join(F.slice(words, number(p["from_word"] + 1), number(p["to_word"] - p["from_word"])), " ")
        ))

    # The words are an element of an array, so that they are found once for all pieces.
    words = F.array(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    rows = rows_of(df, picked, "inner").withColumn("_piece", F.explode(F.flatten(F.transform(words, cut_out))))
    both = rows.withColumns({c: F.col(f"_piece.{c}") for c in ("text", "shard", "slot", "from_word")})
    if "n_chars" in df.columns:
        both = both.withColumn("n_chars", F.length("text").cast("long"))
    return both.select(*df.columns, "shard", "slot", "from_word")
