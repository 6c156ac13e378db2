"""Connected components by contraction, in a logarithmic number of rounds over shrinking edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrum.llm.tables import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the smallest node of its component.

    In each round every node hooks onto its smallest neighbour if that is smaller than itself, and the edges are
    rewritten to the nodes hooked onto. A component of at least two nodes loses at least half of them, so the rounds
    are logarithmic whatever the diameter. Self loops and repeated edges do no harm.
    """
    edges = durable(edges.select("a", "b").where("a <> b").distinct())
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = durable(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
        if found is None:
            found = hooks
        else:
            moved = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = durable(found.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        left = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = durable(edges.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct())
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
