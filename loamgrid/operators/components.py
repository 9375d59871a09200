"""Connected components of a distributed graph: hook to the least neighbour, jump, contract, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges(a, b)``; the label is the least node of its component.

    Each round every node takes its least neighbour as parent where that is
    smaller, parents are followed to their roots by doubling, and the edges are
    renamed to the roots. A round at least halves the components that still have
    edges, and doubling takes as many steps as the logarithm of a tree's depth.
    """
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while edges.take(1):
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        parents = materialise(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("parent")), "parents")
        moved = True
        while moved:
            # three doublings in one job: trees up to eight deep need no second
            jumped = parents
            for _ in range(3):
                above = jumped.select(F.col("node").alias("up"), F.col("parent").alias("top"))
                jumped = jumped.join(above, F.col("parent") == F.col("up")).select("node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved"))
            jumped = materialise(jumped, "parents")
            moved = bool(jumped.where("moved").take(1))
            parents = jumped.drop("moved")
        root_a, root_b = parents.toDF("a", "ra"), parents.toDF("b", "rb")
        renamed = edges.join(root_a, "a").join(root_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a != b")
        edges = materialise(renamed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if labels is None:
            labels = parents.toDF("node", "label")
        else:
            up = parents.toDF("label", "root")
            labels = materialise(labels.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
