"""Connected components by contraction: every round hooks each node to its least neighbour, halves the paths and relabels the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is the least node reachable.

    edges: columns a and b (long). Self loops and repeats are ignored; edges with a null end too. No edges: no rows.
    The edges at least halve with each round, as every node with an edge merges with another one.
    """
    left = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        # a star's centre is the least of its nodes, so one round settles it
        hooks = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("p"))
        hooks = scratch.save(hooks, "hooks")
        for _ in range(2):
            up = hooks.select(F.col("node").alias("p"), F.col("p").alias("q"))
            halved = scratch.save(hooks.join(up, "p").select("node", F.col("q").alias("p")), "hooks")
            scratch.drop(hooks)
            hooks = halved
        at = lambda end: hooks.select(F.col("node").alias(end), F.col("p").alias(f"p{end}"))
        rest = left.join(at("a"), "a").join(at("b"), "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        rest = scratch.save(rest, "edges")
        scratch.drop(left)
        left = rest
        if labels is None:
            labels = hooks.select("node", F.col("p").alias("component"))
            kept = hooks
        else:
            step = hooks.select(F.col("node").alias("component"), F.col("p").alias("q"))
            joined = scratch.save(labels.join(step, "component", "left").select("node", F.coalesce("q", "component").alias("component")), "labels")
            scratch.drop(kept, hooks)
            labels = kept = joined
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component"))
