"""Telling rows apart without moving their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Two hashes of a row's id and text, 128 bits together, never null.
MARKS = ["_mark1", "_mark2"]


def marked(df: DataFrame) -> DataFrame:
    """``df`` with ``MARKS``."""
    return df.withColumns({m: F.xxhash64(F.lit(i), "doc_id", F.coalesce("text", F.lit(""))) for i, m in enumerate(MARKS)})


def rows_of(df: DataFrame, chosen: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose marks are in ``chosen``, one of those with equal id and text. Texts move once.

    ``chosen`` may be far larger than the planner can know, so it is never broadcast.
    """
    return marked(df).dropDuplicates(MARKS).join(chosen.hint("merge"), MARKS, how)
