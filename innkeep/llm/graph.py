"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import cut


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is its smallest node.

    Large stars link a node's greater neighbours to its smallest neighbour,
    small stars link the rest to it; each keeps connectivity, never adds
    edges, and they end in one star per component after about log n rounds.
    Each round is checkpointed.  Raises if ``rounds`` do not suffice (never a
    partial answer).  An empty table gives an empty table.
    """
    e = cut(
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    for _ in range(rounds):
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a != b")
            .distinct()
        )
        small = cut(small)
        # done when every node has one parent and no parent has a parent
        parents = small.select(F.col("b").alias("a")).distinct()
        many = small.groupBy("a").count().where("count > 1").select("a")
        if small.join(parents, "a", "left_semi").select("a").unionAll(many).isEmpty():
            roots = small.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return small.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
        e = small
    raise RuntimeError("components: not settled; raise `rounds`")
