"""Joins and deduplication that keep working when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key with more probe rows than this is spread over several tasks.
HOT_ROWS = 100_000
# At most this many of the hottest keys are spread, found with a sketch of this many counters.
# A key that holds more than about a thousandth of the rows is never missed.
MAX_HOT_KEYS = 500
_COUNTERS = 2_000
# A probe of at most this many rows is broadcast as 8-byte key hashes to thin out a table.
BROADCAST_HASHES = 1_000_000


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    ``row_number() = 1`` is planned with a group limit before the shuffle: each
    task sends at most one row per key, whatever the size of the group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_pos", F.row_number().over(w)).where("_pos = 1").drop("_pos")


def hot_keys(probe: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``_key, _fan``: hashes of the hottest keys and over how many tasks to spread each.

    One pass with a fixed-size sketch per task; nothing is shuffled by key. A wrong count only
    changes how rows are spread, never a result.
    """
    counted = probe.select(F.xxhash64(*keys).alias("_key")).agg(
        F.expr(f"approx_top_k(_key, {MAX_HOT_KEYS}, {_COUNTERS})").alias("_top")
    )
    hot = counted.selectExpr("inline(_top)").where(F.col("count") > hot_rows)
    return hot.select(F.col("item").alias("_key"), F.ceil(F.col("count") / hot_rows).cast("int").alias("_fan"))


def lookup_join(
    probe: DataFrame,
    table: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Equi-join ``probe`` to ``table`` where probe keys may be hot.

    ``table`` should have few rows per key. Probe rows of a hot key get a salt from
    ``spread_by`` and the table rows of that key are repeated once per salt. All other rows
    join as usual (salt 0). The broadcast list of hot keys has at most ``MAX_HOT_KEYS`` rows.
    ``counted`` may name a cheaper table with the same key frequencies as ``probe``.
    """
    hot = F.broadcast(hot_keys(probe if counted is None else counted, keys, hot_rows))
    fan = F.coalesce("_fan", F.lit(1))
    keyed = lambda df: df.withColumn("_key", F.xxhash64(*keys)).join(hot, "_key", "left").drop("_key")
    salted = keyed(probe).withColumn("_salt", F.pmod(F.xxhash64(*spread_by), fan).cast("int")).drop("_fan")
    repeated = keyed(table).withColumn("_salt", F.explode(F.sequence(F.lit(0), fan - 1))).drop("_fan")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def fits(df: DataFrame, rows: int = BROADCAST_HASHES) -> bool:
    """Whether ``df`` has at most ``rows`` rows. Counted in each task, so only counts are moved."""
    return df.count() <= rows


def only_keys_of(table: DataFrame, probe: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Thin out a large table to (about) the keys of a probe that was found ``small``.

    The hashes of the probe keys are broadcast, so the table is filtered where it is read and
    neither shuffled nor hurt by hot keys. Equal hashes of unequal keys let a few rows more
    through; an exact join is still to follow. A probe that is not small leaves the table as it is.
    """
    if not small:
        return table
    wanted = F.broadcast(probe.select(F.xxhash64(*keys).alias("_key")).distinct())
    return table.withColumn("_key", F.xxhash64(*keys)).join(wanted, "_key", "left_semi").drop("_key")
