"""Connected components over an edge table, by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    ``edges`` has long columns (a, b).  Each round every edge is lifted to its ends' roots, every root takes the
    smallest root beside it (a map-side combined minimum, so a hub costs one row per task), and pointer doubling
    follows the hooks to their ends.  Edges inside one tree are dropped, so the rounds shrink; their number grows with the
    logarithm of the longest path.  Each round is cut with a checkpoint in the shared folder.
    An empty edge table gives an empty result.
    """
    live = durable(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    both = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    labels = durable(both.select("node", F.col("node").alias("root")))
    for _ in range(rounds):
        if live.isEmpty():
            return labels
        hooks = live.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("parent"))
        # hooks go to smaller nodes, so they are a forest: double the steps until every hook ends at its root
        while True:
            up = hooks.select(F.col("child").alias("parent"), F.col("parent").alias("grand"))
            jumped = durable(hooks.join(up, "parent", "left").select(
                "child", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")
            ))
            hooks = jumped.select("child", "parent")
            if jumped.where("moved").isEmpty():
                break
        moved = labels.join(hooks, labels.root == hooks.child, "left")
        labels = durable(moved.select("node", F.coalesce("parent", "root").alias("root")))
        low = hooks.select(F.col("child").alias("a"), F.col("parent").alias("_pa"))
        high = hooks.select(F.col("child").alias("b"), F.col("parent").alias("_pb"))
        lifted = live.join(low, "a", "left").join(high, "b", "left").select(
            F.coalesce("_pa", "a").alias("a"), F.coalesce("_pb", "b").alias("b")
        )
        live = durable(
            lifted.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
    raise RuntimeError(f"components did not settle in {rounds} rounds")
