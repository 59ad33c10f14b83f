"""Connected components of an edge table by repeated contraction, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component) for each end of ``edges(a, b)``; component is the smallest node reachable.

    Nodes have a priority that is hashed anew in each round. Each node hooks to its neighbour of
    least priority if that is less than its own, pointers are followed once more, edges become edges
    between the roots, and loops go. As priorities don't follow the ids, chains of hooks are short
    whatever the order of the ids, and a constant share of the nodes goes in each round: rounds grow
    with the logarithm of the nodes. The rounds' pointers are followed from the last round, the
    smallest, back to the first; at last the smallest node of each root's members names them.
    """
    edges = ws.table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    empty = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        ranked = lambda c, n=len(rounds): F.struct(F.xxhash64(c, F.lit(n)).alias("p"), c.alias("v"))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min(ranked(F.col("b"))).alias("low"))
        to: Column = F.least(F.col("low"), ranked(F.col("a")))["v"]
        hooks = hooks.select(F.col("a").alias("node"), to.alias("to"))
        one, two = hooks.alias("one"), hooks.alias("two")
        # a root's own pointer is itself
        jumped = one.join(two, F.col("one.to") == F.col("two.node")).select(F.col("one.node").alias("node"), F.col("two.to").alias("to"))
        jumped = ws.table(jumped, "jumped")
        rounds.append(jumped)
        left = jumped.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        right = jumped.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        joined = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = ws.table(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not rounds:
        return empty
    roots = rounds.pop()
    while rounds:
        further = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        roots = rounds.pop().join(further, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    roots = ws.table(roots, "roots")
    least = roots.groupBy("to").agg(F.min("node").alias("component"))
    return roots.join(least, "to").select("node", "component")
