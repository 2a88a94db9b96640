"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.sources.scratch import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``: long): the smallest node it can reach.

    Every round hooks each tree to the smallest tree it has a link to, flattens the trees by doubling
    and replaces links by links between roots. Rounds grow with the logarithm of a component's
    size. All steps are aggregations and joins on one row per node, whatever a node's degree, and
    every round is written to the shared folder, so lost executors cost one round at most.
    Links may be repeated, of either direction or from a node to itself; no links give no rows.
    """
    links = cut_lineage(
        links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.*").distinct()
    )
    trees = cut_lineage(links.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        links = links.where("a <> b")
        if links.isEmpty():
            return trees
        hooks = cut_lineage(
            links.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("root"), F.least("a", "least").alias("up"))
        )
        hooks = _flat(hooks)
        trees = cut_lineage(
            trees.join(hooks, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        )
        left = links.join(hooks.select(F.col("root").alias("a"), F.col("up").alias("a_up")), "a")
        both = left.join(hooks.select(F.col("root").alias("b"), F.col("up").alias("b_up")), "b")
        links = cut_lineage(both.select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).where("a <> b").distinct())


def _flat(hooks: DataFrame) -> DataFrame:
    """``root, up`` with every ``up`` replaced by the end of its chain of hooks."""
    while True:
        above = hooks.select(F.col("root").alias("up"), F.col("up").alias("higher"))
        hooks = cut_lineage(hooks.join(above, "up").select("root", F.col("higher").alias("up"), (F.col("higher") != F.col("up")).alias("moved")))
        if hooks.where("moved").isEmpty():
            return hooks.drop("moved")
        hooks = hooks.drop("moved")
