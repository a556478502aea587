"""Relations between posts: contexts, bounded closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(edges: DataFrame, hops: int = 3, source: str = "source", target: str = "target") -> DataFrame:
    """source, target, hops: what each source reaches in at most ``hops`` steps, with the least number of them.

    Each step joins the frontier, not all paths; duplicates go at every step.
    """
    step = edges.filter(F.col(source) != F.col(target)).select(source, target).distinct()
    nexts = step.select(F.col(source).alias(target), F.col(target).alias("__next"))
    frontier = step.withColumn("hops", F.lit(1))
    out = frontier
    for n in range(2, hops + 1):
        frontier = frontier.join(nexts, target).filter(F.col("__next") != F.col(source)).select(source, F.col("__next").alias(target)).distinct()
        frontier = frontier.join(out, [source, target], "left_anti").withColumn("hops", F.lit(n))
        out = out.unionByName(frontier)
    return out


def relation_contexts(posts: DataFrame, relations: DataFrame, key: str = "post_id") -> DataFrame:
    """Each relation with the post that it names (resolved), a post never being its own context."""
    named = posts.select(F.col(key).alias("target"), F.struct(*[c for c in posts.columns if c != key]).alias("context"))
    joined = relations.filter(F.col("source") != F.col("target")).join(named, "target", "left")
    return joined.withColumn("resolved", F.col("context").isNotNull())
