"""Connected components by repeated contraction, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitweave.llm.steps import drop, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the undirected edges (a, b); component is the smallest id reached.

    Each round sends a node to the first node of its closed neighbourhood:
    by id in even rounds, which folds a star at once, and by a hash in odd
    rounds, which halves chains. Edges follow their ends, so they soon vanish.
    Rounds end when no edge is left, whatever their number.
    """
    links = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    image, turn = None, 0
    while not links.isEmpty():
        first = F.col("u") if turn % 2 == 0 else F.xxhash64("u", F.lit(turn))
        ends = links.select(F.col("a").alias("id"), F.col("b").alias("u")).union(links.select(F.col("b").alias("id"), F.col("a").alias("u")))
        ends = ends.groupBy("id").agg(F.min(F.struct(first.alias("k"), "u")).alias("near"))
        own = F.struct((F.col("id") if turn % 2 == 0 else F.xxhash64("id", F.lit(turn))).alias("k"), F.col("id").alias("u"))
        step = stored(ends.select("id", F.least("near", own)["u"].alias("to")), "contract")
        moved = links.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        following = stored(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        drop(links)
        links = following
        if image is None:
            image = step
        else:
            later = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
            composed = stored(image.join(later, "to", "left").select("id", F.coalesce("next", "to").alias("to")), "image")
            drop(image, step)
            image = composed
        turn += 1
    drop(links)
    if image is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    least = image.groupBy("to").agg(F.least(F.min("id"), F.col("to")).alias("component"))
    return image.join(least, "to").select("id", "component")
