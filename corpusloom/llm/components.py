"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import staged


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) of 64-bit nodes -> (node, component), component being the least node reached.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each links nodes to the least neighbour, so that no
    step gathers a component in one task; the edges of a hub are a join key like any other. The rounds needed grow with
    the logarithm of the longest path.
    """
    now = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    now = staged(now, "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("hi")).where("lo <> hi").distinct()
        now = staged(small, "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first()
        if new == mark:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        mark = new
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
