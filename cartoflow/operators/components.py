"""Connected components of an edge table by contraction.

In every round each node hooks to its least neighbour, pointers are doubled until every node points at the end of its
chain of hooks, and edges move to those ends.  Only nodes that are less than all their neighbours are left, at most half of
those that still have edges, so rounds are logarithmic; and so are the doublings, whatever the order of the ids.  Every
step is written to the shared folder; nothing but row counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.store.shared import spool


def _followed(hooks: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """From (node, root) to the root that a chain of hooks ends in."""
    while True:
        onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("next")).where("root <> next")
        moved = step(hooks.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        hooks, more = moved.select("node", "root"), moved.where("moved").take(1)
        if not more:
            return hooks


def components(edges: DataFrame, step: Callable[[DataFrame], DataFrame] = spool) -> DataFrame:
    """From edges (a, b): (node, root) for each node that has an edge to another; root is the least node reachable.

    ``step`` materialises what a step makes.
    """
    ways = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = step(edges.where("a <> b").select(F.inline(ways)).distinct())  # edges are made once
    roots = None
    while both.take(1):
        hooks = _followed(step(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root"))), step)
        if roots is None:
            roots = hooks
        else:
            onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = step(roots.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        ends = both.join(hooks.withColumnsRenamed({"node": "a", "root": "ra"}), "a").join(hooks.withColumnsRenamed({"node": "b", "root": "rb"}), "b")
        both = step(ends.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if roots is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
