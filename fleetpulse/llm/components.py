"""Connected components of an undirected link table, by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): equal roots for linked ids.

    In every round each vertex hooks to its neighbour of least hashed rank, if that is below its own, and links are
    re-labelled by the hooks; hashed ranks shorten any chain by a constant share a round. Links shrink with every round
    and are cut off from their lineage by a reliable checkpoint. No part of the graph reaches the driver.
    """
    links = links.select("a", "b").where(F.col("a") != F.col("b")).distinct().checkpoint()
    roots = None
    while True:
        both = links.union(links.select("b", "a"))
        least = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("least")
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v"))
        hooks = both.groupBy("a").agg(least).select(
            F.col("a").alias("id"), F.when(F.col("least") < own, F.col("least.v")).otherwise(F.col("a")).alias("up")
        )
        hooks = hooks.checkpoint()
        if roots is None:
            roots = hooks.select("id", F.col("up").alias("root"))
        else:
            step = hooks.select(F.col("id").alias("root"), "up")
            roots = roots.join(step, "root", "left").select("id", F.coalesce("up", "root").alias("root"))
        left = hooks.select(F.col("id").alias("a"), F.col("up").alias("ua"))
        right = hooks.select(F.col("id").alias("b"), F.col("up").alias("ub"))
        links = links.join(left, "a").join(right, "b").where(F.col("ua") != F.col("ub"))
        links = links.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct().checkpoint()
        if links.isEmpty():
            return roots.checkpoint()
