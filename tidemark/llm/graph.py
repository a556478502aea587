"""Connected components by contraction, in joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import written


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of ``edges`` (columns a, b; nulls left out), root being the smallest node it reaches.

    Each round hooks every node to its smallest neighbour, follows these links to their ends, and
    replaces the edges' ends by what was found; edges inside a component vanish.  Nothing but
    "is it empty" and "did it change" goes to the driver.
    """
    edges = written(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
        while True:  # pointer jumping: the depth halves
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = written(parent.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            parent = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parent
        else:
            labels = written(labels.join(parent.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        a, b = parent.select(F.col("node").alias("a"), F.col("root").alias("ra")), parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = written(edges.join(a, "a").join(b, "b").filter(F.col("ra") != F.col("rb")).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
