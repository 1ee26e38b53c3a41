"""Connected components by repeated contraction, all state in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import materialise


def _follow(up: DataFrame) -> DataFrame:
    over = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
    return up.select("a", "p").join(over, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Map every node that has an edge to the smallest node it can reach.

    ``edges`` holds two bigint columns; direction, repeats and self-loops do not
    matter, rows with a null end are no links.  Each round every node takes its
    smallest neighbour as parent, parents are followed to their roots, and the edges are
    rewritten between parents; two neighbours are never both roots, so the graph
    shrinks quickly, chains included.  Nothing is gathered on the driver, and a
    star's centre is only ever aggregated (partial minimum) or joined on, where
    adaptive execution splits it.  Returns (node, component).
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    live = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = None
    while not live.isEmpty():
        up = live.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        moved = True
        while moved:  # until each parent is a root; every pass halves the depth twice
            up = materialise(_follow(_follow(up.select("a", "p"))), "cc-parent")
            moved = not up.where("moved").isEmpty()
        up = up.select("a", "p")
        if labels is None:
            labels = up
        else:
            step = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            labels = materialise(labels.join(step, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "cc-labels")
        left = up.select("a", F.col("p").alias("pa"))
        right = up.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        live = materialise(
            live.join(left, "a").join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(),
            "cc-edges",
        )
    if labels is None:
        labels = live.select("a", F.col("b").alias("p"))
    return labels.select(F.col("a").alias("node"), F.col("p").alias("component"))
