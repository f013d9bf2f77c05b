"""Ancestors over an edge table of any depth, by rounds that double the length of the paths.

After k rounds all paths of up to 2**k edges are known, so the rounds grow with the logarithm of the
depth.  Each round is an equi-join and a grouping, written to the shared folder: a lost executor
costs a re-read of the last round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.sources.tables import materialise

ROUNDS = 40  # enough for paths of 2**40 edges


def closure(edges: DataFrame, parent: str = "parent", child: str = "child", rounds: int = ROUNDS) -> DataFrame:
    """(ancestor, descendant, depth): each pair that a path joins, with the edges of the shortest path.

    Repeated edges count once and edges with a NULL end not at all.  A cycle is no error: its nodes are
    their own descendants, see :func:`cycle_members`.
    """
    pairs = (
        edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant"))
        .filter("ancestor IS NOT NULL AND descendant IS NOT NULL")
        .distinct()
        .withColumn("depth", F.lit(1))
    )
    known = materialise(pairs)
    size = known.count()
    for _ in range(rounds):
        upper = known.select("ancestor", F.col("descendant").alias("middle"), F.col("depth").alias("upper"))
        lower = known.select(F.col("ancestor").alias("middle"), "descendant", F.col("depth").alias("lower"))
        longer = upper.join(lower, "middle").select(
            "ancestor", "descendant", (F.col("upper") + F.col("lower")).alias("depth")
        )
        both = known.unionByName(longer).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth"))
        known = materialise(both)
        before, size = size, known.count()
        if size == before:
            return known
    raise RuntimeError(f"the closure did not end in {rounds} rounds")


def cycle_members(pairs: DataFrame) -> DataFrame:
    """(node, length): the nodes that are their own descendants, with the shortest way around."""
    return pairs.filter("ancestor = descendant").select(
        F.col("ancestor").alias("node"), F.col("depth").alias("length")
    )


def subtree_totals(pairs: DataFrame, facts: DataFrame, node: str, measure: str) -> DataFrame:
    """(node, total, members): ``measure`` summed over each node and all below it that have facts.

    The facts are summed by node first, so a node with many facts reaches the join as one row.
    """
    own = facts.groupBy(F.col(node).alias("descendant")).agg(F.sum(measure).alias("own"))
    itself = own.select(F.col("descendant").alias("node"), "own")
    below = (
        pairs.filter("ancestor <> descendant")
        .join(own, "descendant")
        .select(F.col("ancestor").alias("node"), "own")
    )
    return (
        itself.unionByName(below)
        .groupBy("node")
        .agg(F.sum("own").alias("total"), F.count(F.lit(1)).alias("members"))
        .filter("node IS NOT NULL")
    )
